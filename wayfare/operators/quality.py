"""Data quality of a track: state fractions, gaps, stamp anomalies, tier."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import params as P
from wayfare.functions import geometry as G
from wayfare.operators.clean import TRACK
from wayfare.operators.timeline import KEY, beside, spread


def quality_windows(bounds: DataFrame) -> DataFrame:
    """The trial per video, or the whole clip where there is no trial."""
    has = F.col("end").isNotNull()
    return bounds.filter(F.col("variant") == "c").select(
        *TRACK, "n",
        F.when(has, F.col("from.pos")).otherwise(0).alias("lo"),
        F.when(has, F.col("end.pos")).otherwise(F.col("n") - 1).alias("hi"),
        has.alias("has_trial"),
    )


def scan(clean: DataFrame, windows: DataFrame, p: dict[str, Any], chunk_frames: int) -> DataFrame:
    """Every per-video count of the report in one pass over the cleaned frames."""
    df = clean.join(spread(windows, TRACK, chunk_frames), [*TRACK, "chunk"])
    pos, lo, hi = F.col("pos"), F.col("lo"), F.col("hi")
    inside = pos.between(lo, hi)
    k = p["kinematics"]
    dup = F.coalesce(F.col("dt") < float(k["duplicateTimestampFactor"]) * F.col("nominal_dt"), F.lit(False))
    drop = F.coalesce(F.col("dt") > float(k["dropGapFactor"]) * F.col("nominal_dt"), F.lit(False))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("nose_conf")))
    bin_ = F.least(F.lit(P.NOSE_BINS - 1), F.floor(conf * P.NOSE_BINS))
    hand = inside & (F.col("reason") == "oversized_blob") & F.col("has_trial")
    return df.groupBy(*KEY).agg(
        F.first("variant").alias("variant"), F.first("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        F.first("has_trial").alias("has_trial"),
        F.first("nominal_dt").alias("nominal_dt"),
        F.count_if(inside).alias("frames_in"),
        *[F.count_if(inside & (F.col("state") == s)).alias(f"{s}_in") for s in P.STATES],
        *[F.count_if(F.col("state") == s).alias(f"{s}_all") for s in P.STATES],
        F.count_if(dup).alias("duplicates"),
        F.count_if(~dup & drop).alias("drops"),
        F.min("t").alias("t_first"), F.max("t").alias("t_last"),
        F.max(F.when(pos == lo - 1, F.col("t"))).alias("t_before"),
        F.max(F.when(pos == hi + 1, F.col("t"))).alias("t_after"),
        *[
            F.count_if(inside & F.col("c_valid") & (bin_ == i)).alias(f"nose_bin_{i}")
            for i in range(P.NOSE_BINS)
        ],
        F.count_if(hand).alias("oversized_in"),
        F.min(F.when(hand, pos)).alias("oversized_pos"),
        F.min_by("frame_index", F.when(hand, pos)).alias("oversized_frame"),
        F.min_by("t", F.when(hand, pos)).alias("oversized_t"),
        F.count_if("outlier").alias("outlier_frames"),
        F.count_if("filled").alias("filled_frames"),
    )


def gaps(clean: DataFrame, scan_: DataFrame, geo: DataFrame, chunk_frames: int) -> DataFrame:
    """Stretches without a position in the corrected, uncleaned track, clipped to the window."""
    w = scan_.select(*TRACK, "n", "lo", "hi", "t_before", "t_after", "t_first", "t_last")
    c = clean.filter(F.col("variant") == "c").withColumn("gap", F.coalesce(F.col("prev_ok.pos"), F.lit(-1)))
    lost = c.filter(~F.col("seen_raw")).join(
        beside(spread(w.select(*TRACK, "n", "lo", "hi"), TRACK, chunk_frames).drop("n"), TRACK), [*TRACK, "chunk"]
    ).filter(F.col("pos").between(F.col("lo"), F.col("hi")))
    runs = lost.groupBy(*KEY, "gap").agg(
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"),
        F.min_by("frame_index", "pos").alias("start_frame"), F.max_by("frame_index", "pos").alias("end_frame"),
        F.max("prev_ok.t").alias("bt"), F.max("prev_ok.x").alias("bx"), F.max("prev_ok.y").alias("by"),
    )
    closers = c.filter(F.col("seen_raw") & (F.col("gap") < F.col("pos") - 1)).select(
        *KEY, "gap", F.col("pos").alias("ap"), F.col("t").alias("at"), F.col("x").alias("ax"), F.col("y").alias("ay")
    )
    df = runs.join(closers, [*KEY, "gap"], "left").join(w.drop("variant"), KEY)
    before = F.when(F.col("start_pos") == 0, F.col("t_first")).when(
        F.col("start_pos") == F.col("gap") + 1, F.col("bt")
    ).otherwise(F.col("t_before"))
    after = F.when(F.col("end_pos") == F.col("n") - 1, F.col("t_last")).when(
        F.col("end_pos") + 1 == F.col("ap"), F.col("at")
    ).otherwise(F.col("t_after"))
    df = df.join(geo.select(*KEY, "holes", "inv_px", "ring_px", "pcx", "pcy"), KEY)
    rx, ry = F.coalesce("bx", "ax"), F.coalesce("by", "ay")
    near = F.when(rx.isNotNull(), G.nearest_hole(F.col("holes"), rx, ry))
    df = df.withColumn("near", near)
    at_hole = F.coalesce(F.sqrt(F.col("near.d2")) <= F.col("inv_px"), F.lit(False))
    rim = F.coalesce(G.length(rx - F.col("pcx"), ry - F.col("pcy")) > F.col("ring_px"), F.lit(False))
    return df.select(
        *KEY, "start_pos", "end_pos", "start_frame", "end_frame",
        (after - before).alias("duration_s"),
        F.when(at_hole, "hole").when(rim, "rim").otherwise("open_platform").alias("location_class"),
        F.when(at_hole, F.col("near.k")).alias("hole_index"),
    )


def tier(fraction: Column, p: dict[str, Any]) -> Column:
    q = p["quality"]
    return (
        F.when(fraction.isNull(), "POOR")
        .when(fraction >= float(q["goodMinPositionedFraction"]), "GOOD")
        .when(fraction < float(q["poorMaxPositionedFraction"]), "POOR")
        .otherwise("REVIEW")
    )


def report(
    scan_: DataFrame, gaps_: DataFrame, events: DataFrame, geo: DataFrame, p: dict[str, Any],
    index_drift: DataFrame | None = None,
) -> DataFrame:
    """The quality row of every video. ``index_drift`` (KEY, drift_s) overrides the drift where known."""
    g = gaps_.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("gap_count"), F.greatest(F.lit(0.0), F.max("duration_s")).alias("longest_gap_s")
    )
    judged = events.filter(F.col("kind") != "tracking_failure").groupBy(*KEY).agg(
        F.avg(F.when(F.col("point_used") == "nose", 1.0).otherwise(0.0)).alias("nose_judged_fraction")
    )
    df = scan_.join(g, KEY, "left").join(judged, KEY, "left").join(
        geo.select(*KEY, "platform_diameter_cm", "px_per_cm"), KEY
    )
    own = F.col("t_last") - F.col("t_first") - (F.col("n") - 1) * F.col("nominal_dt")
    drift = F.when((F.col("n") > 1) & F.col("nominal_dt").isNotNull(), own).otherwise(0.0)
    if index_drift is not None:
        df = df.join(index_drift.select(*KEY, F.col("drift_s").alias("index_drift")), KEY, "left")
        drift = F.coalesce("index_drift", drift)
    count = F.col("frames_in")
    share = lambda c: F.when(count > 0, F.col(c) / count)
    positioned = F.when(count > 0, (F.col("tracked_in") + F.col("low_confidence_in")) / count)
    whole = F.when(F.col("n") > 0, (F.col("tracked_all") + F.col("low_confidence_all")) / F.col("n"))
    return df.select(
        *KEY,
        *[share(f"{s}_in").alias(f"{s}_fraction") for s in P.STATES],
        positioned.alias("positioned_fraction"),
        whole.alias("whole_clip_positioned_fraction"),
        "nose_judged_fraction",
        F.coalesce("gap_count", F.lit(0)).alias("gap_count"),
        F.coalesce("longest_gap_s", F.lit(0.0)).alias("longest_gap_s"),
        F.col("duplicates").alias("duplicate_timestamp_count"),
        F.col("drops").alias("dropped_frame_gap_count"),
        drift.alias("drift_s"),
        "platform_diameter_cm",
        "px_per_cm",
        tier(positioned, p).alias("tier"),
    )


def nose_histogram(scan_: DataFrame) -> DataFrame:
    """Nose-confidence bins per video, empty bins included."""
    bins = F.array(
        *[
            F.struct(
                F.lit(i).alias("bin"), F.lit(i / P.NOSE_BINS).alias("bin_min"),
                F.lit((i + 1) / P.NOSE_BINS).alias("bin_max"), F.col(f"nose_bin_{i}").alias("frames"),
            )
            for i in range(P.NOSE_BINS)
        ]
    )
    return scan_.select(*KEY, F.inline(bins))
