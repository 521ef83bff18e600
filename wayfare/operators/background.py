"""Background and threshold from pixel tables: (video, frame, pixel, value)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators.order_stats import lower_median
from wayfare.operators.timeline import KEY, renumber

# When a dark blob of the background is suspicious.
CONTAMINATION_AREA = 1.5
CONTAMINATION_ELONGATION = 1.8


def sample_frames(frames: DataFrame, excluded: DataFrame, count: int, chunk_frames: int) -> DataFrame:
    """Frames spread evenly over what is not excluded.

    ``frames``: KEY, chunk, pos; ``excluded``: KEY, start_frame, end_frame. Exclusions are cut at chunk
    edges and met by chunk.
    """
    cut = excluded.withColumn(
        "chunk",
        F.explode(F.sequence((F.col("start_frame") / chunk_frames).cast("int"), (F.col("end_frame") / chunk_frames).cast("int"))),
    )
    hit = (F.col("f.pos") >= F.col("e.start_frame")) & (F.col("f.pos") <= F.col("e.end_frame"))
    same = [F.col(f"f.{k}") == F.col(f"e.{k}") for k in (*KEY, "chunk")]
    cond = hit
    for s in same:
        cond = cond & s
    # what an explode makes is not in the planner's estimate: merge joins, so that no such side is broadcast
    free = frames.alias("f").join(cut.alias("e").hint("merge"), cond, "left_anti")
    numbered = renumber(free, chunk_frames)
    n = numbered.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    k = F.least(F.lit(count), F.col("n"))
    wanted = n.withColumn("k", F.explode(F.sequence(F.lit(0), k.cast("int") - 1))).select(
        *KEY, F.floor((F.col("k") + 0.5) * F.col("n") / k).alias("idx")
    ).withColumn("chunk", (F.col("idx") / chunk_frames).cast("int"))
    return numbered.join(wanted.hint("merge"), [*KEY, "chunk", "idx"]).select(*KEY, "pos")


def median_background(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Lower median of every pixel over the sample frames."""
    return lower_median(pixels, [*keys, "pixel"], F.col("value"), "background")


def difference_histogram(pixels: DataFrame, background: DataFrame, keys: list[str]) -> DataFrame:
    """How often each darkening max(0, background − value) occurs."""
    d = pixels.join(background, [*keys, "pixel"])
    return d.groupBy(*keys, F.greatest(F.lit(0), F.col("background") - F.col("value")).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("pixels")
    )


def otsu(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """The split of each histogram that separates its two sides best (lowest on a tie), and the threshold above it."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    c, b = F.col("pixels").cast("double"), F.col("bin")
    df = histogram.withColumns(
        {"below": F.sum(c).over(w), "sum_below": F.sum(c * b).over(w), "total": F.sum(c).over(all_), "sum": F.sum(c * b).over(all_)}
    )
    above = F.col("total") - F.col("below")
    gap = F.col("sum_below") / F.col("below") - (F.col("sum") - F.col("sum_below")) / above
    df = df.filter(above > 0).withColumn("between", F.col("below") * above * gap * gap)
    best = df.groupBy(*keys).agg(F.max_by("bin", F.struct("between", (-F.col("bin")).alias("low"))).alias("split"))
    some = histogram.select(*keys).distinct()
    return some.join(best, keys, "left").select(*keys, (F.coalesce("split", F.lit(0)) + 1).alias("threshold"))


def thresholds(histogram: DataFrame, keys: list[str], p: dict[str, Any]) -> DataFrame:
    """The manual threshold when one is set, else the split of the histogram."""
    t = p["tracking"]["threshold"]
    if t["mode"] == "manual":
        return histogram.select(*keys).distinct().withColumn("threshold", F.lit(int(t["manualValue"] + 0.5)))
    return otsu(histogram, keys)


def contamination(blobs: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Dark blobs of a background that are too large or too long to be a hole.

    ``blobs``: KEY, area (px²), elongation, rim (boolean), px_per_cm.
    """
    t = p["tracking"]
    scale = F.col("px_per_cm") * F.col("px_per_cm")
    kept = blobs.filter((F.col("area") >= float(t["minBlobArea_cm2"]) * scale) & ~F.col("rim"))
    med = lower_median(kept, KEY, F.col("area"), "typical")
    n = kept.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    df = kept.join(med, KEY).join(n, KEY).withColumn("ratio", F.col("area") / F.col("typical"))
    large = (F.col("n") >= 2) & (F.col("ratio") >= CONTAMINATION_AREA)
    long_ = (F.col("ratio") >= 1) & (F.col("area") <= float(t["maxBlobArea_cm2"]) * scale) & (F.col("elongation") >= CONTAMINATION_ELONGATION)
    return df.withColumn("flagged", large | long_)
