"""Preference formatting: a shared prompt and two masked completions for each pair of conversations.

``turns`` makes one ordered list of turns per conversation. ``formatted`` finds the longest common prefix of the
chosen and the rejected list, renders it once as the prompt, and renders what follows on either side as a
completion with the spans (character offsets) that a trainer counts: the assistant's content and end mark. All
other text of a completion is masked. Everything is column expressions.

A turn reads ``<|role|>``, line end, content, ``<|end|>``, line end. A conversation has to fit one row.

Defined cases: null roles read ``unknown`` and null texts as empty, and are equal to each other only; turns are
ordered by number, then role, then text, null first, and repeated turns stay; equal conversations share all
turns and have empty completions; a pair with a missing side has an empty prompt unless both are missing; an
empty table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"
END = "<|end|>\n"


def turns(table: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", out: str = "turns") -> DataFrame:
    """One row per conversation with its ordered turns: array of (turn, role, text)."""
    row = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return table.groupBy(F.col(key).alias(key)).agg(F.sort_array(F.collect_list(row)).alias(out))


def bare(ts: Column) -> Column:
    """Turns without their numbers, by which two conversations are compared."""
    return F.transform(ts, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def prefix_length(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share; null elements are equal to each other."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(same, F.lit(True))
    return F.when(first == 0, shorter).otherwise(first - 1).cast("int")


def head(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"))


def body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(END))


def rendered(ts: Column) -> Column:
    return F.array_join(F.transform(ts, lambda t: F.concat(head(t), body(t))), "")


def trained_spans(ts: Column, trained: str = TRAINED) -> Column:
    """(start, stop) of what is counted in a rendered list of turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        first = acc["at"] + F.length(head(t))
        stop = first + F.length(body(t))
        own = F.array(F.struct(first.cast("int").alias("start"), stop.cast("int").alias("stop")))
        spans = F.when(t["role"].eqNullSafe(F.lit(trained)), F.concat(acc["spans"], own)).otherwise(acc["spans"])
        return F.struct(stop.cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(ts, start, add, lambda acc: acc["spans"])


def formatted(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", trained: str = TRAINED) -> DataFrame:
    """``pairs`` with n_shared, prompt, and for either side completion and spans; the two lists are dropped."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    a, b = (F.coalesce(bare(F.col(c)), none) for c in (chosen, rejected))
    others = [c for c in pairs.columns if c not in (chosen, rejected)]
    held = pairs.select(*others, a.alias("_a"), b.alias("_b")).withColumn("n_shared", prefix_length(F.col("_a"), F.col("_b")))
    rest = {side: F.slice(F.col(c), F.col("n_shared") + 1, F.size(c)) for side, c in (("chosen", "_a"), ("rejected", "_b"))}
    held = held.withColumns({f"_{side}": ts for side, ts in rest.items()})
    return held.select(
        *others, "n_shared", rendered(F.slice("_a", F.lit(1), F.col("n_shared"))).alias("prompt"),
        rendered(F.col("_chosen")).alias("chosen"), trained_spans(F.col("_chosen"), trained).alias("chosen_spans"),
        rendered(F.col("_rejected")).alias("rejected"), trained_spans(F.col("_rejected"), trained).alias("rejected_spans"),
    )


def alternatives(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs made from conversations alone: each is the chosen side; the rejected side follows it up to its last
    assistant turn and takes that turn from the next conversation by number instead (no turn, if that has none).

    ``conversations``: result of ``turns``. The partner is joined on the identifier, which is unique here.
    """

    def last(ts: Column) -> Column:
        return F.size(ts) - F.array_position(F.reverse(F.transform(ts, lambda t: t["role"].eqNullSafe(F.lit(TRAINED)))), F.lit(True)) + 1

    n = F.size("turns")
    at = last(F.col("turns")).cast("int")  # size + 1 without assistant turn
    own = conversations.select(F.col(key), "turns", at.alias("_at"))
    other = conversations.select(
        (F.col(key) - 1).alias("_key"), F.when(at <= n, F.slice("turns", at, F.lit(1))).otherwise(F.slice("turns", F.lit(1), F.lit(0))).alias("_answer")
    )
    joined = own.join(other, own[key] == other["_key"], "left")
    kept = F.slice("turns", F.lit(1), F.col("_at") - 1)
    return joined.select(key, F.col("turns").alias("chosen"), F.when(F.col("_answer").isNotNull(), F.concat(kept, "_answer")).otherwise(kept).alias("rejected"))
