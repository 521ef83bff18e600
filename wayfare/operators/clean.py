"""Cleaning: velocity outliers, gap filling, and the per-frame event point and zones."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare import params as P
from wayfare.functions import geometry as G
from wayfare.operators.order_stats import midpoint_median
from wayfare.operators.timeline import Carry, beside, carry, spread
from wayfare.session import NO_DICTIONARY, materialise

TRACK = ["session_id", "video_id", "variant"]

# kinds of frame: a full-size detection, a partial blob at a hole, no position
FULL, PARTIAL, ABSENT = 0, 1, 2


def stamp_differences(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Each frame's stamp difference to the frame before it."""
    return carry(
        frames.select(*keys, "chunk", "pos", "t"), [Carry("prev_t", F.col("t"))], keys
    ).withColumn("dt", F.col("t") - F.col("prev_t"))


def nominal_dt(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Midpoint median of the positive stamp differences per track."""
    # read three times: for the counts, their totals and the ranks. Dictionaries would pack regular stamps so well that the
    # planner takes the counts of all videos for a few rows and has the driver collect them
    d = materialise(stamp_differences(frames, keys).select(*keys, "dt"), "stamp-differences", **NO_DICTIONARY)
    return midpoint_median(d, keys, F.when(F.col("dt") > 0, F.col("dt")), "nominal_dt")


def find_outliers(frames: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Mark implausible speeds against the previous positioned frame (``prev_ok``).

    An outlier stays the reference of the next frame; hand-placed points are never outliers.
    """
    ref = F.col("prev_ok")
    dt = F.col("t") - ref["t"]
    speed = G.length(F.col("x") - ref["x"], F.col("y") - ref["y"]) / dt
    limit = F.lit(float(p["outlierVelocityThreshold_cmPerS"])) * F.col("px_per_cm")
    tested = (
        F.col("c_valid")
        & ref.isNotNull()
        & (F.col("c_src") != "corrected")
        & (dt >= float(p["kinematics"]["duplicateTimestampFactor"]) * F.col("nominal_dt"))
        & (dt > 0)
    )
    return frames.withColumn("outlier", F.coalesce(tested & (speed > limit), F.lit(False)))


def _fill(frames: DataFrame, holes: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Linear filling in time of short bounded gaps, with the refusal rules.

    ``holes`` has the holes of each (track, chunk, row). They are many times as large as a frame, so they join behind the
    windows, and only gaps that no other rule refuses ask for the hole next to their edges.
    """
    edge = F.when(F.col("c_valid"), F.struct("pos", "t", "x", "y", "c_conf", "outlier"))
    hand = F.when(F.col("c_src") == "corrected", F.col("pos"))
    df = carry(
        frames,
        [
            Carry("left", edge),
            Carry("right", edge, following=True),
            Carry("hand_l", hand, inclusive=True),
            Carry("hand_r", hand, following=True, inclusive=True),
        ],
        TRACK,
    ).join(holes, [*TRACK, "chunk", "row"])
    a, z = F.col("left"), F.col("right")

    def near(e: Column) -> Column:
        return F.sqrt(G.nearest_hole(F.col("holes"), e["x"], e["y"])["d2"]) <= F.col("fill_px")

    reason = F.coalesce(
        F.when(a.isNull() | z.isNull(), F.lit("unbounded")),
        F.when(a["outlier"] | z["outlier"], F.lit("touches_outlier")),
        F.when((F.col("hand_l") > a["pos"]) | (F.col("hand_r") < z["pos"]), F.lit("corrected")),
        F.when(z["t"] - a["t"] > float(p["gapFilling"]["maxDuration_s"]), F.lit("too_long")),
        F.when(near(a) | near(z), F.lit("hole_adjacent")),
    )
    df = df.withColumn("unfilled", F.when(~F.col("c_valid"), reason))
    fill = ~F.col("c_valid") & F.col("unfilled").isNull()
    span = z["t"] - a["t"]
    s = F.when(span > 0, (F.col("t") - a["t"]) / span).otherwise(0.5)
    return df.select(
        *[c for c in frames.columns if c not in ("x", "y", "c_conf", "c_src")],
        "holes",
        "unfilled",
        fill.alias("filled"),
        F.when(fill, a["x"] + s * (z["x"] - a["x"])).otherwise(F.col("x")).alias("x"),
        F.when(fill, a["y"] + s * (z["y"] - a["y"])).otherwise(F.col("y")).alias("y"),
        F.when(fill, F.least(a["c_conf"], z["c_conf"])).otherwise(F.col("c_conf")).alias("c_conf"),
        F.when(fill, "filled").otherwise(F.col("c_src")).alias("c_src"),
    )


GEOMETRY = ["pcx", "pcy", "pr", "px_per_cm", "inv_px", "esc_px", "fill_px"]


def clean_tracks(frames: DataFrame, per_video: DataFrame, p: dict[str, Any], chunk_frames: int) -> DataFrame:
    """Cleaned frames with their event point and zones, and the ends of pieces of equal frames.

    ``frames`` carries ``variant``; ``per_video`` has the geometry, ``n``, ``nominal_dt`` and a ``row``
    of its own per row (a video may stand there twice). All windows share the partitioning by (track, chunk).
    """
    seen = F.struct("pos", "t", "x", "y")
    df = carry(
        frames,
        [Carry("prev_t", F.col("t")), Carry("prev_ok", F.when(F.col("c_valid"), seen))],
        TRACK,
    )
    per_track = per_video.withColumn("variant", F.explode(F.array(F.lit("c"), F.lit("a"))))

    def per_chunk(*columns: str) -> DataFrame:
        # the keys of the windows, so the join needs no exchange of its own, and keeps their order
        rows = spread(per_track.select(*TRACK, "n", *[c for c in columns if c != "n"]), TRACK, chunk_frames)
        return beside(rows.select(*TRACK, "chunk", *columns), TRACK).hint("shuffle_hash")

    df = df.join(per_chunk("row", "n", "nominal_dt", *GEOMETRY), [*TRACK, "chunk"])
    df = find_outliers(df, p).withColumn("seen_raw", F.col("c_valid"))
    holes = per_chunk("row", "holes")
    if p["gapFilling"]["enabled"]:
        df = _fill(df, holes, p)
    else:
        df = df.join(holes, [*TRACK, "chunk", "row"])
        df = df.withColumn("unfilled", F.when(~F.col("c_valid"), "disabled")).withColumn("filled", F.lit(False))
    out = F.col("outlier")
    ok = (F.col("c_valid") & ~out) | F.col("filled")
    df = (
        df.withColumn("c_valid", ok)
        .withColumn("n_valid", F.col("n_valid") & ~out)
        .withColumn("state", F.when(out, "ambiguous").otherwise(F.col("state")))
        .withColumn("reason", F.when(out, "outlier_velocity").otherwise(F.col("reason")))
    )
    use_nose = (
        F.col("c_valid")
        & F.col("n_valid")
        & ((F.col("n_src") == "corrected") | (F.col("nose_conf") >= float(p["noseConfidenceCutoff"])))
    )
    df = df.withColumn("use_nose", use_nose)
    ex = F.when(F.col("use_nose"), F.col("nx")).otherwise(F.col("x"))
    ey = F.when(F.col("use_nose"), F.col("ny")).otherwise(F.col("y"))
    df = df.withColumn("ex", F.when(F.col("c_valid"), ex)).withColumn("ey", F.when(F.col("c_valid"), ey))
    near = F.when(F.col("c_valid"), G.nearest_hole(F.col("holes"), F.col("ex"), F.col("ey")))
    df = df.withColumn("near", near)
    nd = F.sqrt(F.col("near.d2"))
    partial = (
        (nd <= F.col("esc_px"))
        & (F.col("state") == "low_confidence")
        & F.col("reason").isin(*P.ENTRY_PARTIAL_REASONS)
    )
    df = df.select(
        *TRACK, "chunk", "pos", "frame_index", "t", (F.col("t") - F.col("prev_t")).alias("dt"),
        "prev_ok", "seen_raw", "x", "y", "c_conf", "c_valid", "c_src", "nx", "ny", "n_valid", "state", "reason",
        "area", "nose_conf", "outlier", "filled", "unfilled", "use_nose", "ex", "ey",
        F.col("near.k").alias("nearest"),
        nd.alias("near_px"),
        F.when(nd <= F.col("inv_px"), F.col("near.k")).otherwise(-1).alias("hole_at"),
        F.when(partial, F.col("near.k")).otherwise(-1).alias("partial_at"),
        F.coalesce(
            F.col("c_valid") & (G.length(F.col("x") - F.col("pcx"), F.col("y") - F.col("pcy")) <= F.col("pr")),
            F.lit(False),
        ).alias("on_platform"),
        F.col("nominal_dt"),
    )
    return mark_pieces(df)


def mark_pieces(df: DataFrame) -> DataFrame:
    """Mark the last frame of every piece (equal kind and hole inside a chunk) and give it the first.

    Pieces are the run-length code of the track: everything about runs and visits works on them.
    """
    kind = F.when(~F.col("c_valid"), ABSENT).when(F.col("partial_at") >= 0, PARTIAL).otherwise(FULL)
    box = ~F.col("c_valid") & (F.col("reason") == "in_escape_box")
    df = df.withColumn("kind", kind).withColumn("box", box)
    w = Window.partitionBy("session_id", "video_id", "variant", "chunk").orderBy("pos")
    code = F.struct("kind", "partial_at", "hole_at", "box")
    before = F.lag(code).over(w)
    after = F.lead(code).over(w)
    df = df.withColumn("__starts", before.isNull() | (before != code)).withColumn(
        "piece_end", after.isNull() | (after != code)
    )
    first = F.struct("pos", "t", "frame_index", "ex", "ey", "nearest", "near_px", "partial_at", "hole_at")
    start = F.last(F.when(F.col("__starts"), first), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    return df.withColumn("piece_first", F.when(F.col("piece_end"), start)).drop("__starts")
