"""Repair of conversations by weighted parsing: the cheapest edits that give ``(system? (user assistant)+)?``.

The grammar is in Chomsky normal form over the pattern's states: a symbol [p, q] derives the turns that lead from
state p to state q, by [p, q] -> [p, r] [r, q], or as one turn by an edit. A turn may be kept (cost 0, if its
role's first letter fits), given the role user or assistant (2) or deleted (3); a truncated turn that stays costs
1 more, a blank or repeated one has to go. An empty turn of user or assistant may be inserted anywhere (2): a
span of one turn is closed under insertions before and after it, which closes all longer spans too.
A cell holds the least (cost, audit) of its span and symbol, the audit being the initials of the edits in order.
At equal cost no audit of a span begins with another (it would have more insertions and so cost more), hence
the least audit of a span is made of least audits of its parts, and cells may be combined.

Charts (``chart``) are filled bottom-up by span length with all cuts, for blocks of up to ``BLOCK`` turns.
Since [p, q] of a longer span has the same least cell by any cut, neighbouring blocks are joined to spans of twice the
length, and so on, which makes long conversations linear.

Scale: turns are dealt by ranges of (conversation, turn, ...) and read in order, so a conversation of any length
is spread over tasks. What touches the edge of a range or passes ``HELD`` bytes is handed on as cells of its
part; parts (at most a few per task) are folded per conversation, which tells each part its edits, and the turns of
a part meet its edits in one more ordered pass. What one task holds is a conversation's audits, 11 letters a turn.

Defined cases: null roles and texts are one space; turns are ordered by turn (nulls first), then role, the text's first
64 characters and a digest of the text; rows with a null conversation are one conversation; equal rows are repeats; a
blank turn has no character but ASCII white space; a role that begins with none of s, u, a can only be changed
or go; an empty table gives empty results; other columns are not read. Texts are passed on whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import partitions
from wayfare.session import materialise

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
BLOCK = 8
HELD = 16 << 20

#: States: before anything, after the system turn, after a user turn, after an assistant turn.
STATES = range(4)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
ROLE = {"u": "user", "a": "assistant"}

Cell = tuple[int, str]
Cells = dict[tuple[int, int], Cell]


def joined(left: Cells, right: Cells, into: Cells | None = None) -> Cells:
    """Cells of two neighbouring spans together; with ``into``, the better of these and those."""
    out = {} if into is None else into
    for (p, r), (c, a) in left.items():
        for q in STATES:
            more = right.get((r, q))
            if more is not None:
                cell = (c + more[0], a + more[1])
                if (p, q) not in out or cell < out[p, q]:
                    out[p, q] = cell
    return out


@lru_cache(maxsize=1)
def inserted() -> Cells:
    """Cells of the empty span: least insertions that lead from state to state."""
    once = {(p, q): (INSERT, "I") for (p, x), q in NEXT.items() if x in ROLE}
    cells: Cells = {(p, p): (0, "") for p in STATES}
    while True:
        more = joined(cells, once, dict(cells))
        if more == cells:
            return cells
        cells = more


@lru_cache(maxsize=64)
def one_turn(initial: str, fault: str | None) -> Cells:
    """Cells of a span of one turn, closed under insertion."""
    edits: Cells = {(p, p): (DELETE, "D") for p in STATES}
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        for (p, x), q in NEXT.items():
            options = [(KEEP + extra, "K")] if x == initial else []
            options += [(REROLE + extra, "R")] if x in ROLE else []
            if options:
                edits[p, q] = min(options)
    return joined(joined(inserted(), edits), inserted())


def chart(turns: tuple[tuple[str, str | None], ...]) -> Cells:
    """Cells of a block of turns, from those of all shorter spans within it."""
    n = len(turns)
    spans = {(i, i + 1): one_turn(*t) for i, t in enumerate(turns)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cells: Cells = {}
            for cut in range(i + 1, i + length):
                joined(spans[i, cut], spans[cut, i + length], cells)
            spans[i, i + length] = cells
    return spans[0, n]


block_cells = lru_cache(maxsize=1 << 14)(chart)


class Spans:
    """Cells of a growing run of turns; neighbours of equal length are joined."""

    def __init__(self):
        self.block: list[tuple[str, str | None]] = []
        self.held: list[tuple[int, Cells]] = []

    def add(self, initial: str, fault: str | None) -> None:
        self.block.append((initial, fault))
        if len(self.block) == BLOCK:
            self.close()

    def close(self) -> None:
        if self.block:
            now = (len(self.block), block_cells(tuple(self.block)))
            self.block = []
            while self.held and self.held[-1][0] <= now[0]:
                n, cells = self.held.pop()
                now = (n + now[0], joined(cells, now[1]))
            self.held.append(now)

    def cells(self) -> Cells:
        self.close()
        out = self.held[0][1]
        for _, cells in self.held[1:]:
            out = joined(out, cells)
        return out


def best(cells: Cells) -> Cell:
    """The least repair of a whole conversation."""
    return min(cells[0, q] for q in ENDS if (0, q) in cells)


def edited(state: int, audit: str, turns: Iterator[tuple]) -> Iterator[tuple[int, str, tuple | None, str]]:
    """(state after, role, turn, edit) of every turn that the edits leave, from ``state`` on; an inserted one has no turn.
    ``turns`` are tuples that begin with the role."""
    for edit in audit:
        turn = None if edit == "I" else next(turns)
        if edit != "D":
            x = turn[0][:1] if edit == "K" else next(x for x in ROLE if (state, x) in NEXT)
            state = NEXT[state, x]
            yield state, turn[0] if edit == "K" else ROLE[x], turn, edit


def marked(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, row (a number), fault (blank, duplicate, truncated or null): what is wrong with each turn first."""
    one = F.lit(" ")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, one).alias("role"), F.coalesce(text_col, one).alias("text")
    )
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    # of equal turns the first is found by aggregation, so that a turn repeated very often stays no hot key
    same = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("h")).agg(F.min(F.struct("turn", "row")).alias("first"))
    firsts = same.select(F.col("first.row").alias("row"), F.lit(True).alias("is_first"))
    text = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(text == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.right(text, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return rows.join(firsts, "row", "left").select("conv_id", "turn", "role", "text", "row", fault.alias("fault"))


@dataclass
class Repair:
    """``conversations``: conv_id, cost, audit, illegal, one row per conversation. ``turns``: conv_id, part, place, turn, role,
    text, edit, the repaired conversations in order of (part, place); inserted turns have no number."""

    conversations: DataFrame
    turns: DataFrame


def ddl(conv: str) -> str:
    return (
        f"kind string, conv_id {conv}, part int, place long, turn long, role string, text string, edit string, fault string, "
        "cost long, audit string, illegal long, first string, last string, state int, cells array<struct<p: int, q: int, cost: long, audit: string>>"
    )


NAMES = ["kind", "conv_id", "part", "place", "turn", "role", "text", "edit", "fault", "cost", "audit", "illegal", "first", "last", "state", "cells"]
TYPES = {
    "part": pa.int32(), "place": pa.int64(), "turn": pa.int64(), "cost": pa.int64(), "illegal": pa.int64(), "state": pa.int32(),
    "cells": pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])),
}


class Out:
    """Rows of the common schema, in batches of bounded size."""

    def __init__(self, conv_type: pa.DataType):
        self.schema = pa.schema([(n, conv_type if n == "conv_id" else TYPES.get(n, pa.string())) for n in NAMES])
        self.rows, self.size = [], 0

    def add(self, **row) -> None:
        self.rows.append(row)
        self.size += 200 + sum(len(row.get(n) or "") for n in ("text", "audit"))

    def take(self, least: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
            self.rows, self.size = [], 0


def ranges(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one range in order: those within it are repaired; of others, turns and the cells of their part."""
    out, part = None, TaskContext.get().partitionId()
    conv, spans, held, size, whole, n, last = None, None, [], 0, False, 0, ""
    first, illegal = "", 0

    def passed(rows) -> None:
        for place, turn, role, text, fault in rows:
            out.add(kind="row", conv_id=conv, part=part, place=place, turn=turn, role=role, text=text, fault=fault)

    def finished(edge: bool) -> None:
        cells = spans.cells()
        if edge or not whole:
            passed(held)
            flat = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cells.items()]
            out.add(kind="part", conv_id=conv, part=part, illegal=illegal, first=first, last=last, cells=flat)
            return
        cost, audit = best(cells)
        out.add(kind="done", conv_id=conv, cost=cost, audit=audit, illegal=illegal)
        turns = iter([(role, text, turn) for _, turn, role, text, _ in held])
        for k, (_, role, turn, edit) in enumerate(edited(0, audit, turns)):
            out.add(kind="turn", conv_id=conv, part=part, place=k, turn=turn and turn[2], role=role, text=turn[1] if turn else "", edit=edit)

    for batch in parts:
        out = out or Out(batch.schema.field(0).type)
        for c, turn, role, text, fault in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if spans is None or c != conv:
                if spans is not None:
                    finished(False)
                whole = spans is not None  # the first one may have begun in the range before
                conv, spans, held, size, n, last, illegal = c, Spans(), [], 0, 0, "", 0
                first = role[:1]
            if n and last + role[:1] not in ("su", "ua", "au"):
                illegal += 1
            last = role[:1]
            spans.add(last, fault)
            held.append((n, turn, role, text, fault))
            n += 1
            size += len(text) + 100
            if not whole or size > HELD:
                whole = False
                passed(held)
                held, size = [], 0
            yield from out.take()
    if spans is not None:
        finished(True)
        yield from out.take(0)


def folded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations in order: one row per conversation, and for every part its edits and the state before."""
    out, conv, some = None, None, []

    def finished() -> None:
        reached: dict[int, tuple[int, str, tuple]] = {0: (0, "", ())}
        illegal, last = 0, None
        for row in some:
            illegal += row["illegal"] + (last is not None and last + row["first"] not in ("su", "ua", "au"))
            last = row["last"]
            ahead: dict[int, tuple[int, str, tuple]] = {}
            for x in row["cells"]:
                if x["p"] in reached:
                    cost, audit, path = reached[x["p"]]
                    cell = (cost + x["cost"], audit + x["audit"], (path, row["part"], x["p"], x["audit"]))
                    if x["q"] not in ahead or cell[:2] < ahead[x["q"]][:2]:
                        ahead[x["q"]] = cell
            reached = ahead
        cost, audit, path = min((reached[q] for q in ENDS if q in reached), key=lambda t: t[:2])
        out.add(kind="done", conv_id=conv, cost=cost, audit=audit, illegal=illegal)
        while path:
            path, part, state, own = path
            out.add(kind="edits", conv_id=conv, part=part, place=-1, audit=own, state=state)

    for batch in parts:
        out = out or Out(batch.schema.field("conv_id").type)
        for row in batch.to_pylist():
            if some and row["conv_id"] != conv:
                finished()
                some = []
            conv = row["conv_id"]
            some.append(row)
            yield from out.take()
    if some:
        finished()
        yield from out.take(0)


def applied(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of parts in order, each part after its edits."""
    out, audit, at, state, place = None, "", 0, 0, 0
    conv, part = None, None

    def insertions() -> None:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            ((state, role, _, edit),) = edited(state, "I", iter(()))
            out.add(kind="turn", conv_id=conv, part=part, place=place, role=role, text="", edit=edit)
            at, place = at + 1, place + 1

    for batch in parts:
        out = out or Out(batch.schema.field("conv_id").type)
        names = ("conv_id", "part", "place", "turn", "role", "text", "audit", "state")
        for c, p, k, turn, role, text, edits, before in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if k == -1:
                conv, part, audit, state, at, place = c, p, edits, before, 0, 0
                insertions()
                continue
            for state, new_role, _, edit in edited(state, audit[at], iter([(role,)])):
                out.add(kind="turn", conv_id=conv, part=part, place=place, turn=turn, role=new_role, text=text, edit=edit)
                place += 1
            at += 1
            insertions()
            yield from out.take()
    if out is not None:
        yield from out.take(0)


def repair(rows: DataFrame) -> Repair:
    """Least repairs of all conversations in ``rows`` (of ``marked``)."""
    n, shape = partitions(rows), ddl(rows.schema["conv_id"].dataType.simpleString())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "head", "digest", "row"]
    keyed = rows.withColumn("head", F.substring("text", 1, 64)).withColumn("digest", F.sha2("text", 256))
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault")
    read = materialise(dealt.mapInArrow(ranges, shape), "repair-ranges")
    parts = read.where("kind = 'part'").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part")
    fold = materialise(parts.mapInArrow(folded, shape), "repair-parts")
    open_turns = read.where("kind = 'row'").unionByName(fold.where("kind = 'edits'"))
    ordered = open_turns.repartition(n, "conv_id", "part").sortWithinPartitions("conv_id", "part", "place")
    turn = ["conv_id", "part", "place", "turn", "role", "text", "edit"]
    return Repair(
        read.where("kind = 'done'").unionByName(fold.where("kind = 'done'")).select("conv_id", "cost", "audit", "illegal"),
        read.where("kind = 'turn'").unionByName(ordered.mapInArrow(applied, shape).where("kind = 'turn'")).select(*turn),
    )


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of ``role:text`` of all repaired turns in order, joined by newlines. Turns are streamed: a digest
    can only be taken front to back, but no text has to be held."""
    conv = turns.schema["conv_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv_id, rows, kind = None, None, [], None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows])], names=["conv_id", "repaired_sha256"])

        for part in parts:
            kind = part.schema.field(0).type
            for c, role, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if now is None or c != conv_id:
                    if now is not None:
                        rows.append((conv_id, now.hexdigest()))
                    now, conv_id = hashlib.sha256(), c
                else:
                    now.update(b"\n")
                now.update(role.encode() + b":")
                now.update(text.encode())
            if len(rows) >= 4096:
                yield batch()
                rows = []
        if now is not None:
            rows.append((conv_id, now.hexdigest()))
            yield batch()

    ordered = turns.repartition(partitions(turns), "conv_id").sortWithinPartitions("conv_id", "part", "place")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {conv}, repaired_sha256 string")


def summary(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256; ``turns`` are its turns, of which there may be none."""
    rows = materialise(marked(turns), "marked-turns")
    done = repair(rows)
    faults = {f: F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")}
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counted = rows.groupBy("conv_id").agg(gaps.alias("gaps"), *faults.values())
    tables = [conversations.select("conv_id").distinct(), counted, done.conversations, digests(done.turns)]
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    none = hashlib.sha256().hexdigest()
    numbers = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.groupBy("conv_id").agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(none)).alias("repaired_sha256"))
