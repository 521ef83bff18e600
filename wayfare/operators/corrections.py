"""Reviewer edits applied on top of the automatic track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators.timeline import KEY
from wayfare.session import materialise_plain

WHEN = ["timestamp", "id"]


def flat_frames(frames: DataFrame, chunk_frames: int) -> DataFrame:
    """The frame table with its nested points as plain columns and the chunk each frame belongs to."""
    return frames.select(
        *KEY,
        (F.col("pos") / chunk_frames).cast("int").alias("chunk"),
        "pos",
        "frame_index",
        F.col("t_s").alias("t"),
        F.col("centroid.x").alias("x"),
        F.col("centroid.y").alias("y"),
        F.col("centroid.confidence").alias("c_conf"),
        F.col("centroid.valid").alias("c_valid"),
        F.col("centroid.source").alias("c_src"),
        F.col("nose.x").alias("nx"),
        F.col("nose.y").alias("ny"),
        F.col("nose.valid").alias("n_valid"),
        F.col("nose.source").alias("n_src"),
        F.col("detection_state").alias("state"),
        "reason",
        F.col("blob_area_px2").alias("area"),
        F.col("nose_heading_confidence").alias("nose_conf"),
    )


def track_spans(frames: DataFrame) -> DataFrame:
    """Per video: frames, first and last frame number, and whether numbers equal positions."""
    return frames.groupBy(*KEY).agg(
        (F.max("pos") + 1).alias("n"),
        F.bool_and(F.col("frame_index") == F.col("pos")).alias("identity"),
    )


def latest(corrections: DataFrame, kind: str) -> DataFrame:
    """The correction of a kind that stands per video: the last by timestamp text, then id."""
    rows = corrections.filter(F.col("kind") == kind)
    cols = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*cols), F.struct(*WHEN)).alias("c")).select(*KEY, "c.*")


def _positions(edits: DataFrame, frames: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Positions of the frames the columns name: arithmetic where numbers are positions, else a lookup."""
    named = F.explode(F.array(*columns))
    numbers = edits.filter(~F.col("identity")).select(*KEY, named.alias("frame_index")).filter(F.col("frame_index").isNotNull())
    # written first: its true size then decides whether the frames must move to meet it, and one pass finds all columns
    numbers = materialise_plain(numbers.distinct(), "numbers")
    found = frames.select(*KEY, "frame_index", "pos").join(numbers, [*KEY, "frame_index"])
    found = materialise_plain(found, "positions")
    for column, out in columns.items():
        at = found.select(*KEY, F.col("frame_index").alias(column), F.col("pos").alias(out))
        edits = edits.join(at, [*KEY, column], "left").withColumn(
            out, F.when(F.col("identity"), F.col(column)).otherwise(F.coalesce(F.col(out), F.lit(-1)))
        )
    return edits


def frame_edits(corrections: DataFrame, frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Point and range corrections with the positions they cover; ``in_range`` says whether they apply."""
    edits = corrections.filter(F.col("kind").isin("point", "range")).join(spans, KEY)
    edits = edits.withColumn("lo_no", F.coalesce("frame_index", "start_frame")).withColumn(
        "hi_no", F.coalesce("frame_index", "end_frame")
    )
    edits = _positions(edits, frames, {"lo_no": "lo", "hi_no": "hi"})
    n = F.col("n")
    point_ok = (F.col("lo") >= 0) & (F.col("lo") < n)
    range_ok = (F.col("lo_no") <= F.col("hi_no")) & (F.col("hi") >= 0) & (F.col("lo") < n)
    return edits.withColumn(
        "in_range", F.when(F.col("kind") == "point", point_ok).otherwise(range_ok)
    ).withColumn("lo", F.greatest(F.lit(0), "lo")).withColumn("hi", F.least(n - 1, F.col("hi")))


def out_of_range_flags(edits: DataFrame) -> DataFrame:
    """One flag per point or range correction that lies outside its track."""
    point = F.col("kind") == "point"
    message = F.when(
        point,
        F.format_string(
            "%s (point) skipped: frame %d is not among the track's %d frames.",
            "id", F.col("lo_no"), F.col("n"),
        ),
    ).otherwise(
        F.format_string(
            "%s (range) skipped: frames %d–%d miss the track's %d frames.",
            "id", F.col("lo_no"), F.col("hi_no"), F.col("n"),
        )
    )
    return edits.filter(~F.col("in_range")).select(
        *KEY,
        F.lit("correction_out_of_range").alias("code"),
        message.alias("message"),
        F.col("lo_no").alias("frame_index"),
        F.lit(None).cast("string").alias("event_id"),
        F.col("id").alias("correction_id"),
    )


def expand_edits(edits: DataFrame, chunk_frames: int) -> DataFrame:
    """One row per edited frame and point.

    A range is first cut at chunk edges and spread by chunk, so one range over a very long track is
    never expanded by one task.
    """
    cut = edits.filter("in_range").withColumn(
        "chunk",
        F.explode(
            F.sequence((F.col("lo") / chunk_frames).cast("int"), (F.col("hi") / chunk_frames).cast("int"))
        ),
    )
    lo = F.greatest(F.col("lo"), F.col("chunk") * chunk_frames)
    hi = F.least(F.col("hi"), (F.col("chunk") + 1) * chunk_frames - 1)
    return cut.repartition(*KEY, "chunk").withColumn("pos", F.explode(F.sequence(lo, hi)))


def edited_fields(edits: DataFrame, chunk_frames: int) -> DataFrame:
    """Per edited frame: what the last writer of the centroid and the last writer of the nose left."""
    e = expand_edits(edits, chunk_frames)
    is_range = F.col("kind") == "range"
    blank = F.lit(0.0)
    value = F.struct(
        F.when(is_range, blank).otherwise(F.col("x")).alias("x"),
        F.when(is_range, blank).otherwise(F.col("y")).alias("y"),
        F.when(is_range, blank).otherwise(F.col("confidence")).alias("conf"),
        F.when(is_range, F.lit(False)).otherwise(F.col("valid")).alias("valid"),
        F.when(is_range | ~F.col("valid"), "not_detected").otherwise("tracked").alias("state"),
        F.when(is_range, F.col("range_type")).otherwise("corrected").alias("reason"),
    )
    order = F.struct(*WHEN)

    def last(writes: Column) -> Column:
        return F.max_by(value, F.when(writes, order))

    return e.groupBy(*KEY, "chunk", "pos").agg(
        last(is_range | (F.col("point") == "centroid")).alias("c_edit"),
        last(is_range | (F.col("point") == "nose")).alias("n_edit"),
    )


def apply_frame_edits(flat: DataFrame, fields: DataFrame) -> DataFrame:
    """Corrected frames: each field takes the value its last writer left, all others stay automatic.

    Where both sides have a ``variant``, edits are those of the frames of their variant.
    """
    track = [*KEY, "variant"] if "variant" in fields.columns else KEY
    out = flat.join(fields, [*track, "chunk", "pos"], "left")
    c, n = F.col("c_edit"), F.col("n_edit")

    def over(edit: Column, field: str, own: str) -> Column:
        return F.when(edit.isNotNull(), edit[field]).otherwise(F.col(own))

    return out.select(
        *track, "chunk", "pos", "frame_index", "t",
        over(c, "x", "x").alias("x"),
        over(c, "y", "y").alias("y"),
        over(c, "conf", "c_conf").alias("c_conf"),
        over(c, "valid", "c_valid").alias("c_valid"),
        F.when(c.isNotNull(), "corrected").otherwise(F.col("c_src")).alias("c_src"),
        over(n, "x", "nx").alias("nx"),
        over(n, "y", "ny").alias("ny"),
        over(n, "valid", "n_valid").alias("n_valid"),
        F.when(n.isNotNull(), "corrected").otherwise(F.col("n_src")).alias("n_src"),
        over(c, "state", "state").alias("state"),
        over(c, "reason", "reason").alias("reason"),
        "area",
        "nose_conf",
    )


def correction_spans(corrections: DataFrame) -> DataFrame:
    """Frame spans of point and range corrections, by frame number."""
    a, z = F.coalesce("frame_index", "start_frame"), F.coalesce("frame_index", "end_frame")
    return corrections.filter(F.col("kind").isin("point", "range")).select(
        *KEY, "id", "timestamp", F.least(a, z).alias("span_start"), F.greatest(a, z).alias("span_end")
    )


def both_variants(flat: DataFrame, edits: DataFrame, fields: DataFrame, parts: int) -> DataFrame:
    """The corrected tracks (variant ``c``) and, for videos with frame edits, the automatic ones (``a``), in ``parts`` by chunk
    of a video. ``fields`` has the variant it edits. It is dealt like the frames and meets them there, however many edits there
    are, in the order of the windows that follow."""
    touched = edits.select(*KEY).distinct()
    auto = flat.join(touched, KEY, "left_semi").withColumn("variant", F.lit("a"))
    both = flat.withColumn("variant", F.lit("c")).unionByName(auto).repartition(parts, *KEY, "chunk")
    return apply_frame_edits(both, fields.repartition(parts, *KEY, "chunk"))
