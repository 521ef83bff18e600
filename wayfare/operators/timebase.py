"""The frame index of a video: presentation order, stamps, nominal rate and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators.timeline import KEY, Carry, carry, renumber


def nominal_ticks(samples: DataFrame) -> DataFrame:
    """Most common sample duration per video (the smaller one on a tie), and the nominal rate."""
    counts = samples.groupBy(*KEY, "timescale", "duration").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*KEY, "timescale").agg(
        F.max_by("duration", F.struct("c", (-F.col("duration")).alias("d"))).alias("tick"),
        (F.sum(F.col("c") * F.col("duration")) / F.first("timescale")).alias("duration_s"),
        F.sum("c").alias("n"),
    ).withColumn("nominal_fps", F.col("timescale") / F.col("tick"))


def presentation_order(samples: DataFrame, ticks: DataFrame, chunk_frames: int) -> DataFrame:
    """Frames in presentation order with their stamps.

    Chunks are ranges of composition time, so a long video is ordered in pieces.
    """
    df = samples.join(ticks.select(*KEY, "tick"), KEY).withColumn(
        "chunk", F.floor(F.col("cts") / (F.col("tick") * chunk_frames)).cast("int")
    )
    tie = F.struct(
        "cts", F.coalesce("gop", F.lit(0)).alias("g"), F.coalesce("poc", F.col("decode_index")).alias("p"), "decode_index"
    )
    df = renumber(df.withColumn("place", tie), chunk_frames, order="place", name="pos")
    t = F.greatest(F.lit(0), F.col("cts") - F.col("edit_offset_ticks")) / F.col("timescale")
    return df.withColumn("t_s", t).drop("place")


def anomalies(order: DataFrame, ticks: DataFrame, drop_factor: float) -> DataFrame:
    """Exact ties, gaps, drift, picture-order inversions and a first frame that is no keyframe."""
    df = carry(order, [Carry("before", F.struct("cts", "gop", "poc"))])
    df = df.join(ticks.select(*KEY, "duration_s", "nominal_fps", "n"), KEY)
    gap = F.col("cts") - F.col("before.cts")
    g, q = F.col("before.gop"), F.col("before.poc")
    back = (g > F.col("gop")) | ((g == F.col("gop")) & (q >= F.col("poc")))
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return df.groupBy(*KEY).agg(
        yes(gap == 0).alias("duplicate_pairs"),
        yes(gap > drop_factor * F.col("tick")).alias("dropped_gaps"),
        (F.first("duration_s") - F.first("n") / F.first("nominal_fps")).alias("drift_s"),
        yes(back).alias("order_inversions"),
        F.bool_or((F.col("pos") == 0) & ~F.col("is_sync")).alias("starts_without_keyframe"),
    )
