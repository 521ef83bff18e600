"""What has to be derived again: dependency hashes, stale videos, skip reasons and the export gate."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import params as P
from wayfare.operators.timeline import KEY


def _digest(*cols: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}), 256)


def row_hash_sum(df: DataFrame, name: str) -> DataFrame:
    """An order-free digest of each video's rows: count and sum of row hashes, combined before the shuffle."""
    h = F.xxhash64(*[F.col(c) for c in df.columns if c not in KEY])
    return df.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 16)).alias("s")
    ).select(*KEY, F.concat_ws(":", "c", "x", "s").alias(name))


def dependency_hashes(
    videos: DataFrame, maps: DataFrame, corrections: DataFrame, p: dict[str, Any], frames: DataFrame | None = None
) -> DataFrame:
    """One digest per video of everything its derived layer depends on."""
    m = maps.select("map_id", _digest(*[F.col(c) for c in maps.columns]).alias("map_hash"))
    c = row_hash_sum(corrections, "edits")
    df = videos.join(m, "map_id", "left").join(c, KEY, "left")
    parts = [F.col("map_hash"), F.col("edits"), F.col("transform"), F.col("target_hole"), F.col("trial_type"), F.lit(P.parameters_hash(p))]
    if frames is not None:
        df = df.join(row_hash_sum(frames, "track"), KEY, "left")
        parts.append(F.col("track"))
    return df.select(*KEY, _digest(*parts).alias("dependency_hash"))


def to_recompute(current: DataFrame, derived: DataFrame) -> DataFrame:
    """Videos whose derived layer is missing or was made from other inputs."""
    return current.join(derived.select(*KEY, "dependency_hash"), [*KEY, "dependency_hash"], "left_anti")


def stale(derived: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Derived videos whose parameter hash is not the one in force."""
    return derived.filter(F.col("parameters_hash") != P.parameters_hash(p)).select(*KEY)


#: What the derived layer of a video was made from. The automatic layer comes from the pixels and stays.
DERIVED_FROM = ("transform", "target_hole", "trial_type", "map_id", "map_digest", "parameters_hash")


def changed_inputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Videos with a changed input: the names of these inputs, and the layer that falls with them.

    ``map_digest`` (what the map of this name holds) and ``parameters_hash`` are compared where both sides have them. A
    video without a row before has all inputs changed that are not null.
    """
    cols = [c for c in DERIVED_FROM if c in before.columns and c in after.columns]
    b = before.select(*KEY, F.struct(*cols).alias("b"))
    df = after.select(*KEY, *cols).join(b, KEY, "left")
    what = F.concat_ws(";", *[F.when(~F.col(c).eqNullSafe(F.col("b")[c]), F.lit(c)) for c in cols])
    return df.select(*KEY, what.alias("changed"), F.lit("derived").alias("falls")).filter(F.col("changed") != "")


def skip_reasons(asked: DataFrame, videos: DataFrame, maps: DataFrame, tracked: DataFrame) -> DataFrame:
    """Why an asked video cannot be derived; null when it can."""
    v = videos.select(*KEY, "map_id", F.lit(True).alias("known"))
    t = tracked.select(*KEY).distinct().withColumn("tracked", F.lit(True))
    m = maps.select("map_id", F.lit(True).alias("mapped"))
    df = asked.select(*KEY).join(v, KEY, "left").join(m, "map_id", "left").join(t, KEY, "left")
    reason = (
        F.when(F.col("known").isNull(), "unknown video")
        .when(F.col("mapped").isNull(), "map missing")
        .when(F.col("tracked").isNull(), "track missing")
    )
    return df.select(*KEY, reason.alias("reason"))


def export_gate(videos: DataFrame, derived: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Per session, why an export is refused; null when it may go ahead. ``stale`` lists the videos."""
    old = F.col("parameters_hash") != P.parameters_hash(p)
    done = derived.groupBy("session_id").agg(F.count(F.lit(1)).alias("analysed"), F.count_if(old).alias("stale"))
    df = videos.select("session_id").distinct().join(done, "session_id", "left")
    blocked = F.when(F.col("analysed").isNull(), "nothing analysed").when(
        F.col("stale") > 0, F.format_string("%d videos analysed under other parameters", "stale")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return df.select("session_id", zero("analysed"), zero("stale"), blocked.alias("blocked"))


def invalid_parameters(values: DataFrame, keys: list[str]) -> DataFrame:
    """The numeric parameters of a table of sets (keys, path, value) that their rules do not allow, and what is allowed.

    A parameter that a set lacks is not a row here; ``params.problems`` names those of one set.
    """
    rules = values.sparkSession.createDataFrame(
        [(path, kind, low if low is None else float(low), high if high is None else float(high), P.allowed(kind, low, high)) for path, (kind, low, high) in P.RULES.items()],
        "path string, kind string, low double, high double, allowed string",
    )
    df, v, kind = values.join(rules, "path"), F.col("value"), F.col("kind")
    whole = ~kind.isin("int", "odd") | (v == F.floor(v))
    odd = (kind != "odd") | (F.abs(v) % 2 == 1)
    above = F.when(kind == "gt", v > F.col("low")).otherwise(v >= F.col("low"))
    below = F.when(kind == "lt", v < F.col("high")).otherwise(v <= F.col("high"))
    holds = v.isNotNull() & ~F.isnan(v) & whole & odd & F.coalesce(above, F.lit(True)) & F.coalesce(below, F.lit(True))
    return df.filter(~F.coalesce(holds, F.lit(False))).select(*keys, "path", "value", "allowed")


def clamp_parameters(values: DataFrame, bounds: DataFrame) -> DataFrame:
    """Values (path, value) held inside their documented bounds (path, low, high)."""
    df = values.join(bounds, "path", "left")
    v = F.greatest(F.col("value"), F.coalesce("low", "value"))
    return df.select("path", F.least(v, F.coalesce("high", v)).alias("value"))
