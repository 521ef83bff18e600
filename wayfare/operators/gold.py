"""The three exported tables, with their column catalogue and rounding."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import params as P
from wayfare.functions.numbers import round_half_up
from wayfare.operators.corrections import latest
from wayfare.operators.timeline import KEY

EXPORT_SCHEMA_VERSION = 2

# Parameter behind each threshold column of the trial table.
THRESHOLDS = {
    "hole_investigation_radius_factor": "holeInvestigation.radiusFactor",
    "hole_investigation_min_duration_s": "holeInvestigation.minDuration_s",
    "hole_investigation_merge_gap_s": "holeInvestigation.mergeGap_s",
    "escape_entry_radius_factor": "escapeEntry.radiusFactor",
    "escape_entry_min_duration_s": "escapeEntry.minDuration_s",
    "escape_entry_persist_cutoff_s": "escapeEntry.persistCutoff_s",
    "trial_cutoff_s": "trialCutoff_s",
    "target_quadrant_hole_span": "targetQuadrant.holeSpan",
    "gap_fill_max_duration_s": "gapFilling.maxDuration_s",
    "nose_confidence_cutoff": "noseConfidenceCutoff",
    "outlier_velocity_threshold_cm_per_s": "outlierVelocityThreshold_cmPerS",
}

# The exported columns in order, each with its unit.
TRIAL_COLUMNS = [
    ("session_id", ""),
    ("session_name", ""),
    ("video_id", ""),
    ("animal", ""),
    ("day", ""),
    ("trial_label", ""),
    ("group", ""),
    ("trial_type", ""),
    ("target_hole", "hole index"),
    ("trial_start_s", "s"),
    ("primary_latency_s", "s"),
    ("total_latency_s", "s"),
    ("primary_errors", "count"),
    ("total_errors", "count"),
    ("path_length_cm", "cm"),
    ("path_length_smoothed_cm", "cm"),
    ("mean_speed_cm_per_s", "cm/s"),
    ("target_quadrant_time_s", "s"),
    ("strategy", ""),
    ("strategy_source", ""),
    ("escaped", "bool"),
    ("no_escape_confirmed", "bool"),
    ("no_escape_confirmed_by", ""),
    ("status", ""),
    ("review_flags", ""),
    ("tracked_fraction", "0–1"),
    ("correction_count", "count"),
    ("hole_investigation_radius_factor", "× hole radius"),
    ("hole_investigation_min_duration_s", "s"),
    ("hole_investigation_merge_gap_s", "s"),
    ("escape_entry_radius_factor", "× hole radius"),
    ("escape_entry_min_duration_s", "s"),
    ("escape_entry_persist_cutoff_s", "s"),
    ("trial_cutoff_s", "s"),
    ("target_quadrant_hole_span", "holes"),
    ("gap_fill_max_duration_s", "s"),
    ("nose_confidence_cutoff", "0–1"),
    ("outlier_velocity_threshold_cm_per_s", "cm/s"),
    ("tool_version", ""),
    ("schema_version", ""),
    ("parameters_hash", ""),
]
EVENT_COLUMNS = [
    ("session_id", ""),
    ("session_name", ""),
    ("video_id", ""),
    ("trial_label", ""),
    ("event_id", ""),
    ("kind", ""),
    ("hole_index", ""),
    ("is_target", "bool"),
    ("start_frame", ""),
    ("end_frame", ""),
    ("start_time_s", "s"),
    ("end_time_s", "s"),
    ("duration_s", "s"),
    ("point_used", ""),
    ("min_nose_distance_cm", "cm"),
    ("min_centroid_distance_cm", "cm"),
    ("evidence_summary", ""),
    ("source", ""),
    ("evidence_corrected", "bool"),
    ("correction_ids", ""),
    ("confirmed", "bool"),
    ("reviewer", ""),
    ("auto_hole_index", ""),
    ("auto_start_frame", ""),
    ("auto_end_frame", ""),
    ("tool_version", ""),
    ("schema_version", ""),
    ("parameters_hash", ""),
]
QUALITY_COLUMNS = [
    ("session_id", ""),
    ("session_name", ""),
    ("video_id", ""),
    ("tracked_fraction", "0–1"),
    ("not_detected_fraction", "0–1"),
    ("ambiguous_fraction", "0–1"),
    ("low_confidence_fraction", "0–1"),
    ("positioned_fraction", "0–1"),
    ("whole_clip_positioned_fraction", "0–1"),
    ("nose_judged_event_fraction", "0–1"),
    ("gap_count", "count"),
    ("longest_gap_s", "s"),
    ("duplicate_timestamp_count", "count"),
    ("dropped_frame_gap_count", "count"),
    ("drift_s", "s"),
    ("platform_diameter_cm", "cm"),
    ("px_per_cm", "px/cm"),
    ("tier", ""),
    ("tool_version", ""),
    ("schema_version", ""),
    ("parameters_hash", ""),
]
TABLES = {"trials": TRIAL_COLUMNS, "events": EVENT_COLUMNS, "quality": QUALITY_COLUMNS}


def headers(table: str) -> list[str]:
    return [header for header, _ in TABLES[table]]


def catalogue(spark: Any) -> DataFrame:
    """(table, position, header, unit) of every exported column."""
    rows = [(table, i, header, unit) for table, columns in TABLES.items() for i, (header, unit) in enumerate(columns)]
    return spark.createDataFrame(rows, "table_name string, position int, header string, unit string")


def _seconds(c: str) -> Column:
    return round_half_up(F.col(c), 3)


def _cm(c: str) -> Column:
    return round_half_up(F.col(c), 2)


def _named(videos: DataFrame, sessions: DataFrame, cols: list[str]) -> DataFrame:
    names = sessions.select("session_id", F.col("name").alias("session_name"), "tool_version")
    return videos.select(*KEY, *cols).join(names, "session_id")


def _stamp(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    return df.withColumn("schema_version", F.lit(EXPORT_SCHEMA_VERSION)).withColumn(
        "parameters_hash", F.lit(P.parameters_hash(p))
    )


def flag_codes(flags: DataFrame) -> DataFrame:
    return flags.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("code")), ";").alias("review_flags"))


def trial_rows(
    videos: DataFrame, sessions: DataFrame, geo: DataFrame, metrics: DataFrame, flags: DataFrame,
    corrections: DataFrame, p: dict[str, Any],
) -> DataFrame:
    """One row per analysed video, 41 columns."""
    by = latest(corrections, "no_escape").select(*KEY, F.col("reviewer").alias("claimed_by"))
    df = (
        _named(videos, sessions, ["animal", "day", F.col("trial").alias("trial_label"), "group", "trial_type"])
        .join(geo.select(*KEY, F.col("target").alias("target_hole")), KEY)
        .join(metrics.drop("trial_type"), KEY)
        .join(flag_codes(flags), KEY, "left")
        .join(by, KEY, "left")
    )
    df = df.withColumn("review_flags", F.coalesce("review_flags", F.lit(""))).withColumn(
        "no_escape_confirmed_by", F.when(F.col("no_escape_confirmed"), F.col("claimed_by"))
    )
    for c in ("trial_start_s", "primary_latency_s", "total_latency_s", "target_quadrant_time_s"):
        df = df.withColumn(c, _seconds(c))
    for c in ("path_length_cm", "path_length_smoothed_cm", "mean_speed_cm_per_s"):
        df = df.withColumn(c, _cm(c))
    for c, path in THRESHOLDS.items():
        df = df.withColumn(c, F.lit(float(P.get(p, path))))
    return _stamp(df, p).select(*headers("trials"))


def event_reviewers(events: DataFrame, corrections: DataFrame) -> DataFrame:
    """Who stands behind each event, each name once, in the order of their corrections."""
    named = events.select(*KEY, "event_id", F.explode("correction_ids").alias("id")).join(
        corrections.select(*KEY, "id", "timestamp", "reviewer"), [*KEY, "id"]
    ).withColumn("late", F.lit(0))
    about = corrections.filter(F.col("kind") == "event").withColumn(
        "event_id", F.when(F.col("action") == "add", F.concat(F.lit("user-"), F.col("id"))).otherwise(F.col("event_id"))
    )
    own = events.select(*KEY, "event_id").join(
        about.select(*KEY, "event_id", "id", "timestamp", "reviewer"), [*KEY, "event_id"]
    ).withColumn("late", F.lit(1))
    item = F.struct("late", "timestamp", "id", "reviewer")
    both = named.unionByName(own.select(named.columns)).filter(F.col("reviewer").isNotNull() & (F.col("reviewer") != ""))
    return both.groupBy(*KEY, "event_id").agg(
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(item)), lambda v: v["reviewer"])), ";").alias("reviewer")
    )


def event_rows(
    videos: DataFrame, sessions: DataFrame, events: DataFrame, corrections: DataFrame, p: dict[str, Any]
) -> DataFrame:
    """One row per event, 28 columns; the duration is the difference of the rounded times."""
    df = _named(videos, sessions, [F.col("trial").alias("trial_label")]).join(events, KEY).join(
        event_reviewers(events, corrections), [*KEY, "event_id"], "left"
    )
    start, end = _seconds("start_t"), _seconds("end_t")
    df = (
        df.withColumn("start_time_s", start)
        .withColumn("end_time_s", end)
        .withColumn("duration_s", round_half_up(end - start, 3))
        .withColumn("min_nose_distance_cm", _cm("min_nose_cm"))
        .withColumn("min_centroid_distance_cm", _cm("min_centroid_cm"))
        .withColumn("evidence_summary", F.col("evidence"))
        .withColumn("correction_ids", F.array_join("correction_ids", ";"))
        .withColumn("auto_hole_index", F.col("auto_shadow.hole_index"))
        .withColumn("auto_start_frame", F.col("auto_shadow.start_frame"))
        .withColumn("auto_end_frame", F.col("auto_shadow.end_frame"))
    )
    return _stamp(df, p).select(*headers("events"))


def quality_rows(videos: DataFrame, sessions: DataFrame, quality: DataFrame, p: dict[str, Any]) -> DataFrame:
    """One row per analysed video, 21 columns."""
    df = _named(videos, sessions, []).join(quality, KEY)
    df = (
        df.withColumn("nose_judged_event_fraction", F.col("nose_judged_fraction"))
        .withColumn("longest_gap_s", _seconds("longest_gap_s"))
        .withColumn("drift_s", _seconds("drift_s"))
        .withColumn("platform_diameter_cm", _cm("platform_diameter_cm"))
    )
    return _stamp(df, p).select(*headers("quality"))
