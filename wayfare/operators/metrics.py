"""Trial measures and status."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import params as P
from wayfare.operators.events import kind_order
from wayfare.operators.timeline import KEY


def is_persistent(last_frame: Column, p: dict[str, Any]) -> Column:
    """An entry that lasts to the end of the video or at least the persist cutoff."""
    return (F.col("kind") == "escape_entry") & (
        (F.col("end_frame") >= last_frame)
        | (F.col("duration_s") >= float(p["escapeEntry"]["persistCutoff_s"]))
    )


def events_in_trial(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Events that begin inside the trial."""
    b = bounds.filter((F.col("variant") == "c") & F.col("end").isNotNull()).select(
        *KEY, F.col("from.t").alias("trial_start_t"), F.col("end.t").alias("trial_end_t")
    )
    return events.join(b, KEY).filter(F.col("start_t").between(F.col("trial_start_t"), F.col("trial_end_t")))


def errors_and_latency(in_trial: DataFrame) -> DataFrame:
    """Latency to the first target event and errors before it and altogether, in one aggregation."""
    hit = F.col("is_target") & (F.col("kind") != "tracking_failure")
    error = (F.col("kind") == "investigation") & ~F.col("is_target")
    order = F.when(hit, F.struct("start_frame", kind_order(F.col("kind")), "hole_index", "event_id"))
    agg = in_trial.groupBy(*KEY).agg(
        F.min(order)["start_frame"].alias("target_frame"),
        F.min_by("start_t", order).alias("target_t"),
        F.collect_list(F.when(error, F.col("start_frame"))).alias("error_frames"),
        F.first("trial_start_t").alias("trial_start_t"),
    )
    before = F.filter(
        "error_frames", lambda f: F.col("target_frame").isNull() | (f < F.col("target_frame"))
    )
    return agg.select(
        *KEY,
        (F.col("target_t") - F.col("trial_start_t")).alias("primary_latency_s"),
        F.size(before).alias("primary_errors"),
        F.size("error_frames").alias("total_errors"),
    )


def status(no_trial: Column, hard_flags: Column, probe: Column, escaped: Column, confirmed: Column) -> Column:
    missed = ~probe & ~F.coalesce(escaped, F.lit(False)) & ~F.coalesce(confirmed, F.lit(False))
    return F.when(no_trial, "unresolved").when((hard_flags > 0) | missed, "review").otherwise("ok")


def hard_flag_counts(flags: DataFrame) -> DataFrame:
    return flags.filter(~F.col("code").isin(*P.SOFT_FLAGS)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("hard_flags"))


def metrics(
    videos: DataFrame, bounds: DataFrame, events: DataFrame, flags: DataFrame, kin: DataFrame,
    scan_: DataFrame, strategy: DataFrame, no_escape: DataFrame, correction_counts: DataFrame, p: dict[str, Any],
) -> DataFrame:
    """One row of measures per video; null where a measure does not exist."""
    b = bounds.filter(F.col("variant") == "c").select(
        *KEY, F.col("from").alias("begin"), "end", "end_reason"
    )
    el = errors_and_latency(events_in_trial(events, bounds))
    df = (
        videos.select(*KEY, "trial_type")
        .join(b, KEY)
        .join(el, KEY, "left")
        .join(kin, KEY, "left")
        .join(scan_.select(*KEY, "tracked_in", "frames_in"), KEY, "left")
        .join(strategy.select(*KEY, "strategy", "strategy_source"), KEY, "left")
        .join(hard_flag_counts(flags), KEY, "left")
        .join(no_escape.select(*KEY, F.lit(True).alias("ne")), KEY, "left")
        .join(correction_counts, KEY, "left")
    )
    no_trial = F.col("end").isNull()
    probe = F.col("trial_type") == "probe"
    escaped = F.when(~(probe | no_trial), F.col("end_reason") == "escape")
    confirmed = F.when(~probe, F.coalesce("ne", F.lit(False)))
    total = F.when(~probe & escaped, F.col("end.t") - F.col("begin.t"))
    if p["trialCensoring"]["censorToCutoff"]:
        total = F.coalesce(total, F.when(~probe & ~no_trial, F.lit(float(p["trialCutoff_s"]))))
    in_window = lambda c: F.when(~no_trial, F.col(c))
    return df.select(
        *KEY,
        F.col("begin.t").alias("trial_start_s"),
        in_window("primary_latency_s").alias("primary_latency_s"),
        total.alias("total_latency_s"),
        F.when(~no_trial, F.coalesce("primary_errors", F.lit(0))).alias("primary_errors"),
        F.when(~no_trial, F.coalesce("total_errors", F.lit(0))).alias("total_errors"),
        in_window("path_cm").alias("path_length_cm"),
        in_window("path_smoothed_cm").alias("path_length_smoothed_cm"),
        in_window("mean_speed_cm_s").alias("mean_speed_cm_per_s"),
        in_window("sector_time_s").alias("target_quadrant_time_s"),
        "strategy",
        "strategy_source",
        escaped.alias("escaped"),
        confirmed.alias("no_escape_confirmed"),
        status(no_trial, F.coalesce("hard_flags", F.lit(0)), probe, escaped, confirmed).alias("status"),
        F.when(~no_trial, F.col("tracked_in") / F.col("frames_in")).alias("tracked_fraction"),
        F.coalesce("correction_count", F.lit(0)).alias("correction_count"),
    )
