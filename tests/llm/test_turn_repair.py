import hashlib
import itertools
import random
import re

import pytest

from tests.llm.helpers import plain
from wayfare.llm import turn_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, row int, part int, head string, digest string, fault string, audit string"
WORD = re.compile(r"[^\x20\x09-\x0d]")


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, 1, 2, "h", "d", "f", "a") for r in rows], SCHEMA).repartition(partitions)


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        words = WORD.findall(text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(turns):
    """Least (cost, audit, output) by search over positions, with the grammar as a plain expression."""
    marks = faults(turns)
    best = {}
    frontier = [(0, "", 0, ())]
    while frontier:  # plain uniform-cost search over (turns read, initials written)
        cost, audit, at, out = frontier.pop(frontier.index(min(frontier, key=lambda t: (t[0], t[1]))))
        initials = "".join(r[:1] or "-" for r, _ in out)
        if not re.fullmatch("s?(ua)*u?", initials):
            continue
        state = 0 if not out else 1 if initials == "s" else 2 if initials[-1] == "u" else 3
        if (at, state) in best:
            continue
        best[at, state] = cost, audit, out
        frontier += [(cost + 2, audit + "I", at, (*out, (r, ""))) for r in ("user", "assistant")]
        if at < len(turns):
            role, text = turns[at]
            frontier.append((cost + 3, audit + "D", at + 1, out))
            if marks[at] not in ("blank", "duplicate"):
                more = marks[at] == "truncated"
                frontier.append((cost + more, audit + "K", at + 1, (*out, (role, text))))
                frontier += [(cost + 2 + more, audit + "R", at + 1, (*out, (r, text))) for r in ("user", "assistant")]
    return min((best[len(turns), q] for q in (0, 3) if (len(turns), q) in best), key=lambda t: t[:2])


def brute(rows, ids):
    out = []
    for conv in ids:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        turns = [t[1:] for t in mine]
        numbers = [t for t, *_ in mine if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        marks = faults(turns)
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(turns)]
        cost, audit, left = cheapest(turns)
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest()
        counts = [marks.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return out


def drawn(rng, conv, n):
    roles, texts = ("user", "assistant", "system", "tool", "", None), ("Yes.", "No", "why?", "", " \t", "Yes. ", None, "é!\n")
    return [(conv, rng.choice([None, k, k // 2]), rng.choice(roles[: rng.choice((3, 6))]), rng.choice(texts)) for k in range(n)]


def test_cells_of_all_cuts_and_of_blocks_agree():
    rng = random.Random(3)
    for _ in range(60):
        turns = tuple((rng.choice("suat"), rng.choice((None, "blank", "duplicate", "truncated"))) for _ in range(rng.randint(1, 40)))
        spans = R.Spans()
        for t in turns:
            spans.add(*t)
        assert spans.cells() == R.chart(turns)


@pytest.mark.parametrize("held", [R.HELD, 0])
def test_against_search(spark, monkeypatch, held):
    rng = random.Random(5)
    rows = [r for conv in range(1, 80) for r in drawn(rng, conv, rng.randint(1, 9))] + drawn(rng, None, 6)
    monkeypatch.setattr(R, "HELD", held)  # 0: every conversation of a range is handed on in parts
    ids = [*range(0, 80), None]
    turns = table(spark, rows)
    given = spark.createDataFrame([(i,) for i in ids] + [(3,)], "conv_id long")
    got = R.summary(turns, given)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = sorted(brute(rows, ids), key=lambda t: tuple((x is None, str(x)) for x in t))
    assert plain(got) == want
    assert (0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in want


def test_a_conversation_over_many_ranges(spark):
    rng = random.Random(7)
    long = [(9, k, "user" if rng.random() < 0.6 else "assistant", f"turn {k} {'x' * 50}{rng.choice('.?x')}") for k in range(6000)]
    rows = long + [(c, k, "user", "Same.") for c in (1, 20) for k in range(300)]
    marked = R.marked(table(spark, rows, 5))
    done = R.repair(marked)
    got = {r["conv_id"]: r for r in done.conversations.collect()}
    turns = [(r, x) for _, _, r, x in long]
    marks = faults(turns)
    spans = R.Spans()
    for (role, _), fault in zip(turns, marks, strict=True):
        spans.add(role[0], fault)
    assert (got[9]["cost"], got[9]["audit"]) == R.best(spans.cells())
    assert got[9]["illegal"] == sum(a[0] == b[0] for a, b in itertools.pairwise(turns))
    assert got[1]["cost"] == got[20]["cost"] == 2 + 299 * 3
    left = done.turns.where("conv_id = 9").orderBy("part", "place").collect()
    want = [(role, turn[1] if turn else "") for _, role, turn, _ in R.edited(0, got[9]["audit"], iter(turns))]
    assert [(r["role"], r["text"]) for r in left] == want
    assert {r["role"] for r in left[::2]} == {"user"} and {r["role"] for r in left[1::2]} == {"assistant"}
    assert done.turns.where("conv_id = 9").select("part").distinct().count() > 2
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in want).encode()).hexdigest()
    assert R.digests(done.turns).where("conv_id = 9").first()["repaired_sha256"] == digest


def test_empty_tables(spark):
    none = table(spark, [(1, 1, "user", "a")]).limit(0)
    assert R.summary(none, none).count() == 0
    assert R.repair(R.marked(none)).turns.count() == 0
