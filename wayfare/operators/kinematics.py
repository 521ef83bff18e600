"""Motion inside the trial: smoothed path, times, speed and heading change.

The trial cutoff bounds the frames of one video here, so windows run per video.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare import params as P
from wayfare.functions import geometry as G
from wayfare.operators.clean import TRACK
from wayfare.operators.timeline import KEY, spread


def trial_frames(clean: DataFrame, bounds: DataFrame, chunk_frames: int) -> DataFrame:
    """The corrected frames of each trial."""
    w = bounds.filter((F.col("variant") == "c") & F.col("end").isNotNull()).select(
        *TRACK, "n", F.col("from.pos").alias("lo"), F.col("end.pos").alias("hi")
    )
    return (
        clean.filter(F.col("variant") == "c")
        .join(spread(w, TRACK, chunk_frames).drop("n"), [*TRACK, "chunk"])
        .filter(F.col("pos").between(F.col("lo"), F.col("hi")))
    )


def smoothed(frames: DataFrame, window: int, keys: list[str] = KEY) -> DataFrame:
    """Median-filter the positioned frames inside each positioned run; run ends stay raw."""
    h = max(0, window // 2)
    ok = frames.filter("c_valid")
    if h == 0:
        return ok.withColumn("sx", F.col("x")).withColumn("sy", F.col("y"))
    if h == 1:
        # the usual window of three needs no arrays
        w = Window.partitionBy(*keys).orderBy("pos")
        whole = (F.lag("pos").over(w) == F.col("pos") - 1) & (F.lead("pos").over(w) == F.col("pos") + 1)

        def mid3(c: str) -> Column:
            a, b, z = F.lag(c).over(w), F.col(c), F.lead(c).over(w)
            return F.when(whole, F.greatest(F.least(a, b), F.least(F.greatest(a, b), z))).otherwise(b)

        return ok.withColumns({"sx": mid3("x"), "sy": mid3("y")})
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-h, h)
    ok = ok.withColumn("__a", F.collect_list(F.struct("pos", "x", "y")).over(w))
    a = F.col("__a")
    whole = (F.size(a) == 2 * h + 1) & (
        F.element_at(a, -1)["pos"] - F.element_at(a, 1)["pos"] == 2 * h
    )
    mid = lambda c: F.sort_array(F.transform(a, lambda v: v[c]))[h]
    return (
        ok.withColumn("sx", F.when(whole, mid("x")).otherwise(F.col("x")))
        .withColumn("sy", F.when(whole, mid("y")).otherwise(F.col("y")))
        .drop("__a")
    )


def motion(trial: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Per positioned frame of the trial: smoothed point, and the step to the next frame when that is positioned."""
    slim = trial.select(*KEY, "pos", "frame_index", "t", "x", "y", "c_valid", "nominal_dt")
    s = smoothed(slim, int(p["kinematicsSmoothingWindowFrames"]))
    w = Window.partitionBy(*KEY).orderBy("pos")
    cols = ("pos", "t", "x", "y", "sx", "sy")
    s = s.withColumns({f"__{c}": F.lead(c).over(w) for c in cols})
    n = {c: F.col(f"__{c}") for c in cols}
    beside = n["pos"] == F.col("pos") + 1
    return s.withColumns(
        {
            "step_dt": F.when(beside, n["t"] - F.col("t")),
            "step_px": F.when(beside, G.length(n["x"] - F.col("x"), n["y"] - F.col("y"))),
            "step_smooth_px": F.when(beside, G.length(n["sx"] - F.col("sx"), n["sy"] - F.col("sy"))),
        }
    ).drop(*[f"__{c}" for c in cols])


def kinematics(motion_: DataFrame, trial: DataFrame, bounds: DataFrame, geo: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Path, tracked time, sector time, gap time, speed and stamp anomalies of each trial."""
    g = geo.select(*KEY, "pcx", "pcy", "sector_deg", "sector_half", "px_per_cm")
    inside = G.in_sector(
        F.col("pcx"), F.col("pcy"), F.col("sector_deg"), F.col("sector_half"), F.col("x"), F.col("y")
    )
    steps = (
        motion_.join(g, KEY)
        .groupBy(*KEY)
        .agg(
            F.first("px_per_cm").alias("px_per_cm"),
            F.coalesce(F.sum("step_px"), F.lit(0.0)).alias("path_px"),
            F.coalesce(F.sum("step_smooth_px"), F.lit(0.0)).alias("smooth_px"),
            F.coalesce(F.sum("step_dt"), F.lit(0.0)).alias("tracked_time_s"),
            F.coalesce(F.sum(F.when(inside, F.col("step_dt"))), F.lit(0.0)).alias("sector_time_s"),
            F.min_by("x", "pos").alias("x0"), F.min_by("y", "pos").alias("y0"),
            F.max_by("x", "pos").alias("x1"), F.max_by("y", "pos").alias("y1"),
            F.count(F.lit(1)).alias("positioned"),
        )
    )
    k = p["kinematics"]
    dup = F.col("dt") < float(k["duplicateTimestampFactor"]) * F.col("nominal_dt")
    drop = F.col("dt") > float(k["dropGapFactor"]) * F.col("nominal_dt")
    pairs = trial.filter(F.col("pos") > F.col("lo")).groupBy(*KEY).agg(
        F.count_if(F.coalesce(dup, F.lit(False))).alias("duplicate_pairs"),
        F.count_if(F.coalesce(~dup & drop, F.lit(False))).alias("dropped_pairs"),
    )
    b = bounds.filter((F.col("variant") == "c") & F.col("end").isNotNull()).select(
        *KEY, (F.col("end.t") - F.col("from.t")).alias("trial_s")
    )
    df = b.join(steps, KEY, "left").join(pairs, KEY, "left").join(
        geo.select(*KEY, F.col("px_per_cm").alias("cm")), KEY
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    tracked = zero("tracked_time_s")
    gap = F.greatest(F.lit(0.0), F.col("trial_s") - tracked)
    straight = F.when(
        F.col("positioned") > 1, G.length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    ).when(F.col("positioned") == 1, 0.0)
    return df.select(
        *KEY,
        "trial_s",
        (zero("path_px") / F.col("cm")).alias("path_cm"),
        (zero("smooth_px") / F.col("cm")).alias("path_smoothed_cm"),
        tracked.alias("tracked_time_s"),
        gap.alias("gap_time_s"),
        F.when(F.col("trial_s") > 0, gap / F.col("trial_s")).alias("gap_fraction"),
        F.when(tracked > 0, zero("smooth_px") / F.col("cm") / tracked).alias("mean_speed_cm_s"),
        zero("sector_time_s").alias("sector_time_s"),
        F.when(tracked > 0, zero("sector_time_s") / tracked).alias("sector_fraction"),
        F.coalesce("duplicate_pairs", F.lit(0)).alias("duplicate_pairs"),
        F.coalesce("dropped_pairs", F.lit(0)).alias("dropped_pairs"),
        F.when(zero("smooth_px") > 0, straight / F.col("smooth_px")).alias("path_efficiency"),
    )


def frame_speed(motion_: DataFrame, geo: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Speed of each positioned frame over its neighbours in the run, skipping duplicate stamps."""
    w = int(p["kinematics"]["speedWindowFrames"])
    win = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(-w, w)
    df = motion_.withColumn("__a", F.collect_list(F.struct("pos", "t", "sx", "sy")).over(win))
    pos = F.col("pos")
    a = F.filter(F.col("__a"), lambda v: F.abs(v["pos"] - pos) <= w)
    df = df.withColumn("__a", a)
    # of the same run: as many rows away as positions
    run = F.filter(
        F.col("__a"),
        lambda v: F.size(
            F.filter(
                F.col("__a"),
                lambda u: (u["pos"] >= F.least(v["pos"], pos)) & (u["pos"] <= F.greatest(v["pos"], pos)),
            )
        )
        == F.abs(v["pos"] - pos) + 1,
    )
    df = df.withColumn("__a", run)
    first = F.element_at("__a", 1)
    dup = F.coalesce(
        F.lit(float(p["kinematics"]["duplicateTimestampFactor"])) * F.col("nominal_dt"), F.lit(0.0)
    )
    start = F.struct(
        F.lit(0.0).alias("path"), first["t"].alias("kt"), first["sx"].alias("kx"), first["sy"].alias("ky"),
        first["t"].alias("pt"), F.lit(1).alias("kept"),
    )

    def step(acc: Column, v: Column) -> Column:
        keep = v["t"] - acc["pt"] >= dup
        return F.struct(
            F.when(keep, acc["path"] + G.length(v["sx"] - acc["kx"], v["sy"] - acc["ky"])).otherwise(acc["path"]).alias("path"),
            F.when(keep, v["t"]).otherwise(acc["kt"]).alias("kt"),
            F.when(keep, v["sx"]).otherwise(acc["kx"]).alias("kx"),
            F.when(keep, v["sy"]).otherwise(acc["ky"]).alias("ky"),
            v["t"].alias("pt"),
            (acc["kept"] + F.when(keep, 1).otherwise(0)).alias("kept"),
        )

    rest = F.slice(F.col("__a"), 2, 2 * w)
    df = df.withColumn("__f", F.aggregate(rest, start, step))
    f = F.col("__f")
    span = f["kt"] - first["t"]
    return df.join(geo.select(*KEY, "px_per_cm"), KEY).select(
        *KEY, "pos", "t",
        F.when((f["kept"] >= 2) & (span > 0), f["path"] / F.col("px_per_cm") / span).alias("speed_cm_s"),
    )


def tortuosity(motion_: DataFrame, phase: DataFrame, geo: DataFrame) -> DataFrame:
    """Cumulative heading change over steps of at least 1 cm from a moving anchor, in the search phase.

    The anchor starts anew after a gap, the heading does not. The fold runs over one trial's frames.
    """
    rows = motion_.join(phase.select(*KEY, "phase_end"), KEY).filter(F.col("pos") <= F.col("phase_end"))
    arr = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "sx", "sy"))).alias("pts"))
    arr = arr.join(geo.select(*KEY, "px_per_cm"), KEY)
    least = F.lit(P.TORTUOSITY_STEP_CM) * F.col("px_per_cm")
    none = F.lit(None).cast("double")
    start = F.struct(
        none.alias("ax"), none.alias("ay"), none.alias("h"), F.lit(0.0).alias("total"), F.lit(-2).alias("last")
    )

    def step(acc: Column, v: Column) -> Column:
        fresh = acc["ax"].isNull() | (v["pos"] != acc["last"] + 1)
        dx, dy = v["sx"] - acc["ax"], v["sy"] - acc["ay"]
        far = ~fresh & (G.length(dx, dy) >= least)
        h = F.atan2(dy, dx)
        d = h - acc["h"]
        d = F.when(d > F.pi(), d - 2 * F.pi()).when(d < -F.pi(), d + 2 * F.pi()).otherwise(d)
        return F.struct(
            F.when(fresh | far, v["sx"]).otherwise(acc["ax"]).alias("ax"),
            F.when(fresh | far, v["sy"]).otherwise(acc["ay"]).alias("ay"),
            F.when(far, h).otherwise(acc["h"]).alias("h"),
            (acc["total"] + F.when(far, F.coalesce(F.abs(d), F.lit(0.0))).otherwise(0.0)).alias("total"),
            v["pos"].alias("last"),
        )

    return arr.select(*KEY, F.aggregate("pts", start, step, lambda a: a["total"]).alias("tortuosity_rad"))
