"""The trial window: start, cutoff and end."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import params as P
from wayfare.operators.clean import TRACK
from wayfare.operators.corrections import latest
from wayfare.operators.timeline import KEY, beside, chunked, spread
from wayfare.session import chunk_frames, materialise_plain


def _row(pos: Column | str, t: str, number: str) -> Column:
    at = F.col(pos) if isinstance(pos, str) else pos
    return F.when(
        at.isNotNull(), F.struct(at.alias("pos"), F.col(t).alias("t"), F.col(number).alias("frame_index"))
    )


def auto_starts(clean: DataFrame) -> DataFrame:
    """Per track: its length and the first tracked frame on the platform."""
    hit = (F.col("state") == "tracked") & F.col("on_platform")
    at = F.when(hit, F.col("pos"))
    g = clean.groupBy(*TRACK).agg(
        (F.max("pos") + 1).alias("n"),
        F.min(at).alias("a_pos"),
        F.min_by("t", at).alias("a_t"),
        F.min_by("frame_index", at).alias("a_no"),
        F.max_by("t", "pos").alias("l_t"),
        F.max_by("frame_index", "pos").alias("l_no"),
        F.bool_and(F.col("frame_index") == F.col("pos")).alias("identity"),
    )
    return g.select(
        *TRACK, "n", "identity", _row("a_pos", "a_t", "a_no").alias("auto"),
        _row(F.col("n") - 1, "l_t", "l_no").alias("last"),
    )


def trial_starts(clean: DataFrame, corrections: DataFrame) -> DataFrame:
    """The start that stands per track: the reviewer's when there is one, clamped into the track."""
    auto = materialise_plain(auto_starts(clean), "auto-starts")
    edit = latest(corrections, "trial_start").select(
        *KEY, F.col("frame_index").alias("named"), F.col("id").alias("start_correction")
    )
    asked = materialise_plain(auto.join(edit, KEY), "asked-starts")
    size = chunk_frames(clean.sparkSession)
    named = spread(asked.select(*TRACK, "n", F.col("named").alias("frame_index")), TRACK, size).drop("n")
    numbers = clean.join(beside(named, TRACK), [*TRACK, "chunk", "frame_index"], "left_semi").select(*TRACK, F.col("frame_index").alias("named"), F.struct("pos", "t", "frame_index").alias("hit"))
    clamped = F.least(F.greatest(F.lit(0), F.col("named")), F.col("n") - 1)
    asked = materialise_plain(asked.join(numbers, [*TRACK, "named"], "left").withColumn("clamped", clamped), "asked-starts")
    fallback = asked.filter(F.col("hit").isNull()).select(*TRACK, F.col("clamped").alias("pos"))
    at = clean.join(beside(chunked(fallback, size), TRACK), [*TRACK, "chunk", "pos"], "left_semi").select(
        *TRACK, F.struct("pos", "t", "frame_index").alias("held")
    )
    asked = asked.join(at, TRACK, "left").select(
        *TRACK,
        F.coalesce("hit", "held").alias("fixed"),
        "start_correction",
        "named",
        F.col("hit").isNull().alias("start_clamped"),
        "clamped",
    )
    return (
        auto.join(asked, TRACK, "left")
        .withColumn("from", F.coalesce("fixed", "auto"))
        .withColumn("start_source", F.when(F.col("fixed").isNotNull(), "corrected").otherwise("auto"))
    )


def start_flags(starts: DataFrame) -> DataFrame:
    """A flag for every start correction that names a frame outside its track."""
    return starts.filter((F.col("variant") == "c") & F.col("start_clamped")).select(
        *KEY,
        F.lit("correction_out_of_range").alias("code"),
        F.format_string(
            "%s (trial start) asks for frame %d of a track of %d frames; frame %d is taken.",
            "start_correction", "named", "n", "clamped",
        ).alias("message"),
        F.col("named").alias("frame_index"),
        F.lit(None).cast("string").alias("event_id"),
        F.col("start_correction").alias("correction_id"),
    )


def cutoffs(clean: DataFrame, starts: DataFrame, p: dict[str, Any], chunk_frames: int) -> DataFrame:
    """Start, cutoff frame and last oversized frame before the automatic start, per track."""
    slim = starts.select(
        *TRACK, "n", F.col("from.pos").alias("from_pos"), F.col("from.t").alias("from_t"),
        F.col("auto.pos").alias("auto_pos"),
    )
    df = clean.select(*TRACK, "chunk", "pos", "t", "frame_index", "reason").join(
        spread(slim, TRACK, chunk_frames), [*TRACK, "chunk"]
    )
    limit = F.col("from_t") + float(p["trialCutoff_s"]) + P.CUTOFF_TOLERANCE_S
    inside = F.when(F.col("t") <= limit, F.col("pos"))
    past = F.when((F.col("pos") > F.col("from_pos")) & (F.col("t") > limit), F.col("pos"))
    early = F.col("pos") < F.coalesce(F.col("auto_pos"), F.col("n"))
    agg = df.groupBy(*TRACK).agg(
        F.max(inside).alias("c_pos"),
        F.max_by("t", inside).alias("c_t"),
        F.max_by("frame_index", inside).alias("c_no"),
        F.min(past).alias("past"),
        F.max(F.when(early & (F.col("reason") == "oversized_blob"), F.col("pos"))).alias("last_oversized"),
    )
    agg = materialise_plain(agg, "cutoffs")
    # the cutoff is the frame before the first one past the limit; where stamps go back, frames after it may be inside again
    back = agg.filter(F.col("past") < F.col("c_pos")).select(*TRACK, (F.col("past") - 1).alias("pos"))
    if not back.isEmpty():
        held = clean.join(beside(chunked(back, chunk_frames), TRACK), [*TRACK, "chunk", "pos"], "left_semi").select(*TRACK, F.struct("pos", "t", "frame_index").alias("held"))
        agg = agg.join(held, TRACK, "left").withColumns(
            {c: F.coalesce(F.col(f"held.{f}"), F.col(c)) for c, f in (("c_pos", "pos"), ("c_t", "t"), ("c_no", "frame_index"))}
        )
    return starts.join(
        agg.select(*TRACK, _row("c_pos", "c_t", "c_no").alias("cut"), "last_oversized"), TRACK
    )


def resolve_end(escape: Column) -> tuple[Column, Column]:
    """(end frame struct, reason) given the struct of the persistent entry's first frame, or null."""
    start, cut = F.col("from"), F.col("cut")
    inside = escape.isNotNull() & (escape["pos"] >= start["pos"]) & (escape["pos"] <= cut["pos"])
    end = F.when(start.isNotNull(), F.when(inside, escape).otherwise(cut))
    reason = (
        F.when(start.isNull(), "no_start")
        .when(inside, "escape")
        .when(cut["pos"] < F.col("n") - 1, "cutoff")
        .otherwise("end_of_video")
    )
    return end, reason
