"""Mixing sources to target weights by capped water-filling.

``targets`` clamps every source at its largest number of epochs and reshares the excess by weight until no
source is above its clamp; ``mix`` turns targets into whole repetitions plus a seeded share of the rows.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; sources without
words get target 0; rows that agree in id and text share one draw, so they are taken together; an empty table
gives an empty result. Only the columns named are read, so extra columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import free_name, n_words, numbered
from wayfare.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
#: Draws are 60-bit numbers, looked at 12 bits at a time.
DRAW_BITS, STEP_BITS = 60, 12


def draw(id_col: str, text_col: str, seed: str) -> Column:
    """A 60-bit number of each row, the same on every run."""
    said = F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("?")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))
    )
    return F.conv(F.substring(F.md5(said), 1, DRAW_BITS // 4), 16, 10).cast("long")


def weighted_sources(sized: DataFrame, weights=WEIGHTS) -> DataFrame:
    """One row per source: its size and the weight by its place in code point order, null last."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = numbered(sums, [F.col("source").asc_nulls_last()], "place", "mix-places")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    return placed.withColumn("weight", F.element_at(listed, (F.col("place") % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``.

    The level (words per unit of weight) only rises while sources reach their clamps, so a source is clamped
    exactly if its clamp lies below weight times level: each round is one aggregate over the sources, and two
    numbers reach the driver.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        clamped = cap < F.col("weight") * F.lit(level)
        held, free = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0))
        ).first()
        if not free:
            level = math.inf
            break
        risen = (share * total - held) / free
        if risen <= level:
            break
        level = risen
    poured = F.col("weight") * F.lit(level) if math.isfinite(level) else F.lit(math.inf)
    return sources.withColumn("target", F.when(cap < poured, cap).otherwise(poured))


def cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """The draw below which each source's rows are taken once more.

    ``rows``: source, size, draw; ``goals``: source, need (words still missing after whole repetitions). The
    words are summed per leading digits of the draw, the group of rows in which the running sum passes the need
    is opened, and so on, so that no task sorts the rows of a source. The last group is taken if that comes
    nearer to the need.
    """
    shift = DRAW_BITS
    at = goals.select("source", F.lit(0).cast("long").alias("lead"), F.col("need").alias("rest"), F.lit(None).cast("long").alias("cut"))
    while True:
        shift -= STEP_BITS
        at = materialise(at, "mix-cut")
        opened = at.where(F.col("cut").isNull()).select("source", "lead", "rest")
        inside = rows.join(opened, rows["source"].eqNullSafe(opened["source"])).where(
            F.shiftright(F.col("draw"), shift + STEP_BITS) == F.col("lead")
        ).drop(opened["source"])
        sums = inside.groupBy("source", F.shiftright("draw", shift).alias("digit")).agg(
            F.sum("size").alias("words"), F.min("draw").alias("first"), F.max("draw").alias("last"), F.first("rest").alias("rest")
        )
        listed = sums.groupBy("source").agg(
            F.first("rest").alias("rest"), F.sort_array(F.collect_list(F.struct("digit", "words", "first", "last"))).alias("digits")
        )  # at most 4096 digits of a source
        summed = F.aggregate(
            "digits",
            F.struct(F.col("rest").alias("rest"), F.lit(None).cast(sums_type(sums)).alias("hit")),
            lambda acc, d: F.when(acc["hit"].isNotNull(), acc)
            .when(d["words"] > acc["rest"], F.struct(acc["rest"].alias("rest"), d.alias("hit")))
            .otherwise(F.struct((acc["rest"] - d["words"]).alias("rest"), acc["hit"].alias("hit"))),
        )
        found = listed.select("source", summed.alias("s")).select("source", "s.rest", "s.hit")
        last = shift == 0
        alone = (F.col("hit.first") == F.col("hit.last")) if not last else F.lit(True)
        nearer = F.col("hit.words") - F.col("rest") < F.col("rest")
        cut = (
            F.when(F.col("hit").isNull(), F.lit(1 << DRAW_BITS))
            .when(alone & nearer, F.col("hit.last") + 1)
            .when(alone, F.col("hit.first"))
        )
        step = found.select("source", F.col("hit.digit").alias("lead"), "rest", cut.alias("cut"))
        done = at.where(F.col("cut").isNotNull())
        none = opened.join(step, opened["source"].eqNullSafe(step["source"]), "left_anti").withColumn("cut", F.lit(0).cast("long"))
        at = materialise(done.unionByName(step).unionByName(none), "mix-cut")
        if last or at.where(F.col("cut").isNull()).isEmpty():
            return at.select("source", "cut")


def sums_type(sums: DataFrame) -> str:
    kinds = dict(sums.dtypes)
    return "struct<" + ",".join(f"{c}:{kinds[c]}" for c in ("digit", "words", "first", "last")) + ">"


def plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """(narrow rows: id, source, size, draw; sources: source, source_size, target, whole, cut)."""
    rows = materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), draw(id_col, text_col, seed).alias("draw")),
        "mix-rows",
    )
    sources = materialise(weighted_sources(rows, weights), "mix-sources")
    filled = targets(sources, share, max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    )
    filled = materialise(filled.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    found = cuts(rows, filled)
    found = filled.join(found, filled["source"].eqNullSafe(found["source"])).drop(found["source"])
    return rows, materialise(found.select("source", "source_size", "target", "whole", "cut"), "mix-plan")


def repeats(rows: DataFrame, sources: DataFrame, source_col: str = "source", draw_col: str | Column = "draw") -> DataFrame:
    """``rows`` with their source's size and target and how often each row is taken."""
    own = sources.select(F.col("source").alias("_source"), "source_size", "target", "whole", "cut")
    d = F.col(draw_col) if isinstance(draw_col, str) else draw_col
    return (
        rows.join(own, rows[source_col].eqNullSafe(own["_source"]))
        .withColumn("times", F.col("whole") + F.when(d < F.col("cut"), 1).otherwise(0))
        .drop("_source", "whole", "cut")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, times and taken (words taken, repeats counted)."""
    rows, sources = plan(docs, **options)
    return repeats(rows, sources).select(
        "doc_id", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    _, sources = plan(docs, **options)
    mine, time = free_name(docs, "_mix"), free_name(docs, "_time")
    own = sources.select(F.struct("*").alias(mine))
    times = F.col(f"{mine}.whole") + F.when(draw(id_col, text_col, options.get("seed", SEED)) < F.col(f"{mine}.cut"), 1).otherwise(0)
    return (
        docs.join(own, docs[source_col].eqNullSafe(own[f"{mine}.source"]))
        .select(*docs.columns, F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias(time))
        .drop(time)
    )
