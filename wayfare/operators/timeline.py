"""Ordered operators over long tracks.

A track is cut into chunks of consecutive positions. Frame-level windows are partitioned by
(track, chunk), so no task ever holds a whole track; what has to cross a chunk edge travels through
a one-row-per-chunk summary (``carry``) or through the first and last rows of the neighbouring
chunks (``neighbours``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["session_id", "video_id"]


@dataclass(frozen=True)
class Carry:
    """One value carried along the order: the last non-null before a row, or the first after it.

    ``inclusive`` lets the row itself supply the value.
    """

    name: str
    value: Column
    following: bool = False
    inclusive: bool = False


def carry(
    df: DataFrame,
    specs: Sequence[Carry],
    keys: Sequence[str] = KEY,
    order: str = "pos",
    chunk: str = "chunk",
) -> DataFrame:
    """As-of values along each track, exact across chunk edges."""
    keys = list(keys)
    aggs, cols, far_cols, near = [], [*keys, chunk], [], {}
    types = df.select(*[s.value.alias(f"v{i}") for i, s in enumerate(specs)]).schema
    for i, s in enumerate(specs):
        direction = F.col(order).desc() if s.following else F.col(order).asc()
        w = (
            Window.partitionBy(*keys, chunk)
            .orderBy(direction)
            .rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
        )
        near[f"__near{i}"] = F.last(s.value, ignorenulls=True).over(w)
        rank = F.when(s.value.isNotNull(), F.col(order))
        pick = F.min_by if s.following else F.max_by
        # one primitive aggregate per leaf keeps the summary a hash aggregate
        leaves = _leaves(s.value, types[i].dataType)
        aggs.append((F.min if s.following else F.max)(rank).alias(f"__at{i}"))
        aggs += [pick(leaf, rank).alias(f"__leaf{i}_{j}") for j, leaf in enumerate(leaves)]
        edge = F.when(
            F.col(f"__at{i}").isNotNull(),
            _rebuild(types[i].dataType, iter([F.col(f"__leaf{i}_{j}") for j in range(len(leaves))])),
        )
        far_order = F.col(chunk).desc() if s.following else F.col(chunk).asc()
        across = Window.partitionBy(*keys).orderBy(far_order).rowsBetween(Window.unboundedPreceding, -1)
        cols.append(F.last(edge, ignorenulls=True).over(across).alias(f"__far{i}"))
        far_cols.append(f"__far{i}")
    far = df.groupBy(*keys, chunk).agg(*aggs).select(*cols)
    some = F.col(far_cols[0]).isNotNull()
    for c in far_cols[1:]:
        some = some | F.col(c).isNotNull()
    # a hash join keeps the order of the rows for the windows that follow; the summary is one row per chunk
    far = far.filter(some).hint("shuffle_hash")
    out = df.withColumns(near).join(far, [*keys, chunk], "left")
    names = {s.name for s in specs}
    return out.select(
        *[c for c in df.columns if c not in names],
        *[F.coalesce(F.col(f"__near{i}"), F.col(f"__far{i}")).alias(s.name) for i, s in enumerate(specs)],
    )


def _leaves(value: Column, data_type: T.DataType) -> list[Column]:
    if isinstance(data_type, T.StructType):
        return [leaf for f in data_type for leaf in _leaves(value[f.name], f.dataType)]
    return [value]


def _rebuild(data_type: T.DataType, leaves: Iterator[Column]) -> Column:
    if isinstance(data_type, T.StructType):
        return F.struct(*[_rebuild(f.dataType, leaves).alias(f.name) for f in data_type])
    return next(leaves)


def neighbours(
    df: DataFrame,
    value: Column,
    before: int,
    after: int,
    name: str,
    keys: Sequence[str] = KEY,
    order: str = "pos",
    chunk: str = "chunk",
) -> DataFrame:
    """Attach ``array<struct(order, v)>`` of the rows at most ``before``/``after`` positions away.

    Positions are consecutive within a track, so the chunk next door supplies at most ``before`` or
    ``after`` rows.
    """
    keys = list(keys)
    item = F.struct(F.col(order).alias("at"), value.alias("v"))
    w = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(-before, after)
    out = df.withColumn("__local", F.collect_list(item).over(w))
    span = Window.partitionBy(*keys, chunk)
    edges = (
        df.select(*keys, chunk, item.alias("__i"), F.col(order).alias("__o"))
        .withColumn("__lo", F.min("__o").over(span))
        .withColumn("__hi", F.max("__o").over(span))
        .filter((F.col("__o") < F.col("__lo") + after) | (F.col("__o") > F.col("__hi") - before))
    )
    head = edges.filter(F.col("__o") < F.col("__lo") + after).select(
        *keys, (F.col(chunk) - 1).alias(chunk), "__i"
    )
    tail = edges.filter(F.col("__o") > F.col("__hi") - before).select(
        *keys, (F.col(chunk) + 1).alias(chunk), "__i"
    )
    outside = (
        tail.unionByName(head).groupBy(*keys, chunk).agg(F.array_sort(F.collect_list("__i")).alias("__out"))
    )
    o = F.col(order)
    merged = F.array_sort(
        F.concat(
            F.col("__local"),
            F.filter(
                F.coalesce(F.col("__out"), F.array().cast(_array_type(df, item))),
                lambda i: (i["at"] >= o - before) & (i["at"] <= o + after),
            ),
        )
    )
    return (
        out.join(outside, [*keys, chunk], "left").withColumn(name, merged).drop("__local", "__out")
    )


def _array_type(df: DataFrame, item: Column):
    return T.ArrayType(df.select(item.alias("i")).schema["i"].dataType, True)


def spread(per_track: DataFrame, keys: Sequence[str], chunk_frames: int, length: str = "n") -> DataFrame:
    """One row per (track, chunk) of per-track values, to join without moving frames by track."""
    return per_track.withColumn(
        "chunk",
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col(length) - 1) / chunk_frames)).cast("int"))),
    )


def chunked(rows: DataFrame, chunk_frames: int, order: str = "pos") -> DataFrame:
    """Rows that name a position with the chunk it lies in."""
    return rows.withColumn("chunk", (F.col(order) / chunk_frames).cast("int"))


def in_chunks(spans: DataFrame, lo: str, hi: str, chunk_frames: int, bucket: int) -> DataFrame:
    """Spans of positions listed under every chunk and every bucket of positions they touch, to meet the frames there."""
    size = F.lit(bucket)
    listed = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(lo) / size).cast("int"), F.floor(F.col(hi) / size).cast("int"))))
    first, last = F.greatest(F.col(lo), F.col("bucket") * size), F.least(F.col(hi), (F.col("bucket") + 1) * size - 1)
    chunks = F.sequence(F.floor(first / chunk_frames).cast("int"), F.floor(last / chunk_frames).cast("int"))
    return listed.withColumn("chunk", F.explode(chunks))


def beside(rows: DataFrame, keys: Sequence[str], chunk: str = "chunk") -> DataFrame:
    """Rows dealt by chunk, to be joined to frames clustered so: the planner must not deal the frames by what ``rows`` had."""
    return rows.repartition(*keys, chunk)


def renumber(
    df: DataFrame, chunk_frames: int, keys: Sequence[str] = KEY, order: str = "pos", chunk: str = "chunk",
    name: str = "idx",
) -> DataFrame:
    """Number the rows of each track 0, 1, 2, … along the order, and chunk them by that number.

    A row's number is its rank inside its chunk plus the sizes of the chunks before.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, chunk, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__o"))
    local = F.row_number().over(Window.partitionBy(*keys, chunk).orderBy(order)) - 1
    numbered = df.withColumn("__r", local).join(offsets, [*keys, chunk])
    return (
        numbered.withColumn(name, F.col("__o") + F.col("__r"))
        .withColumn(chunk, (F.col(name) / chunk_frames).cast("int"))
        .drop("__o", "__r")
    )


def runs_of(
    df: DataFrame, code: Column, keys: Sequence[str] = KEY, order: str = "pos", broken: Column | None = None
) -> DataFrame:
    """Add ``run``: the position at which the current run of equal codes began.

    ``broken`` may compare ``prev`` (the struct of the row before) with the row to end a run early.
    """
    df = df.withColumn("__code", code)
    df = carry(df, [Carry("prev", F.struct(F.col("__code").alias("code"), F.col(order).alias("at")))], keys, order)
    starts = F.col("prev").isNull() | (F.col("prev.code") != F.col("__code"))
    if broken is not None:
        starts = starts | broken
    out = carry(df, [Carry("run", F.when(starts, F.col(order)), inclusive=True)], keys, order)
    return out.drop("__code", "prev")


def with_halo(
    df: DataFrame, size: int, chunk_frames: int, keys: Sequence[str] = KEY, order: str = "idx", chunk: str = "chunk"
) -> DataFrame:
    """Repeat the rows at most ``size`` from a chunk edge in the chunk next door, marked ``halo``.

    For windows of fixed width over consecutive numbers: compute per (track, chunk), then drop the halo.
    """
    place = F.col(order) - F.col(chunk) * chunk_frames
    copies = F.array_compact(
        F.array(
            F.struct(F.col(chunk).alias("c"), F.lit(False).alias("h")),
            F.when((place < size) & (F.col(chunk) > 0), F.struct((F.col(chunk) - 1).alias("c"), F.lit(True).alias("h"))),
            F.when(place >= chunk_frames - size, F.struct((F.col(chunk) + 1).alias("c"), F.lit(True).alias("h"))),
        )
    )
    out = df.withColumn("__x", F.explode(copies))
    return out.select(*[c for c in df.columns if c != chunk], F.col("__x.c").alias(chunk), F.col("__x.h").alias("halo"))


def overlaps(
    left: DataFrame, right: DataFrame, left_span: tuple[Column | str, Column | str], right_span: tuple[Column | str, Column | str],
    keys: Sequence[str] = KEY, width: int = 64,
) -> DataFrame:
    """Rows of the same track whose closed frame spans overlap, each pair once.

    Either span is listed under every bucket of ``width`` frames it touches, so rows meet on (track, bucket) and not
    on the track alone; a pair is taken in the first bucket both touch. The two sides share no column but the keys.
    """
    keys = list(keys)

    def listed(df: DataFrame, span: tuple[Column | str, Column | str], name: str) -> DataFrame:
        lo, hi = (F.col(c) if isinstance(c, str) else c for c in span)
        df = df.withColumns({f"__{name}_lo": lo, f"__{name}_hi": hi})
        first, last = F.least(f"__{name}_lo", f"__{name}_hi"), F.greatest(f"__{name}_lo", f"__{name}_hi")
        known = df.filter(F.col(f"__{name}_lo").isNotNull() & F.col(f"__{name}_hi").isNotNull())
        return known.withColumn("__bucket", F.explode(F.sequence(F.floor(first / width), F.floor(last / width))))

    met = listed(left, left_span, "l").join(listed(right, right_span, "r"), [*keys, "__bucket"])
    begin = F.greatest(F.least("__l_lo", "__l_hi"), F.least("__r_lo", "__r_hi"))
    met = met.filter(
        (F.col("__r_lo") <= F.col("__l_hi")) & (F.col("__l_lo") <= F.col("__r_hi")) & (F.col("__bucket") == F.floor(begin / width))
    )
    return met.drop("__bucket", "__l_lo", "__l_hi", "__r_lo", "__r_hi")
