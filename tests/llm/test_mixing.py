import hashlib
import re

import pytest

from tests.llm.helpers import AWKWARD, documents, plain, sentence
from wayfare.llm import mixing as M


def fill(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Targets by resharing until none is above its clamp."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if cap * sizes[s] < w[s] * unit}
        if not over:
            out |= {s: w[s] * unit for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def brute(rows):
    sized = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), int(hashlib.md5(f"mix-1:{'?' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)) for d, t, _, s in rows]
    sizes = {}
    for _, s, n, _ in sized:
        sizes[s] = sizes.get(s, 0) + n
    goals, out = fill(sizes), []
    for s, goal in goals.items():
        own = [x for x in sized if x[1] == s]
        whole = int(goal // sizes[s]) if sizes[s] else 0
        need, total, taken = goal - whole * sizes[s], 0, set()
        for at in sorted({x[3] for x in own}):
            words = sum(x[2] for x in own if x[3] == at)
            if total + words <= need or (total <= need and total + words - need < need - total):
                taken.add(at)
            total += words
        out += [(d, n, sizes[s], round(goal, 6), n * (whole + (at in taken))) for d, _, n, at in own]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("more", [0, 300])
def test_against_brute_force(spark, more):
    rows = AWKWARD + [(1000 + i, sentence(1 + i % 40, i), "en", f"s{i % 4}") for i in range(more)]
    got = M.mix(documents(spark, rows))
    got = [(*r[:3], round(r[3], 6), r[4]) for r in plain(got, "doc_id", "size", "source_size", "target", "taken")]
    assert got == brute(rows)


def test_taken_is_near_target_and_bounded(spark):
    rows = [(i, sentence(20 + i % 30, i), "en", ("hot" if i % 3 else f"s{i % 5}")) for i in range(900)]
    got = M.mix(documents(spark, rows))
    by = {}
    for r in got.join(documents(spark, rows).select("doc_id", "source"), "doc_id").collect():
        assert r.taken <= 2 * r["size"]
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(goal - taken) <= 50 for goal, taken in by.values())


def test_mixed_repeats_rows_as_often_as_taken(spark):
    rows = AWKWARD + [(1000 + i, sentence(1 + i % 40, i), "en", f"s{i % 4}") for i in range(100)]
    docs = documents(spark, rows)
    out = M.mixed(docs)
    assert out.columns == docs.columns
    times = {}
    for r in out.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    wanted = {}
    for r in M.mix(docs).collect():
        wanted[r.doc_id] = wanted.get(r.doc_id, 0) + r.times
    assert times == {k: v for k, v in wanted.items() if v}


def test_empty_table(spark):
    assert M.mix(documents(spark, [])).count() == 0
    assert M.mixed(documents(spark, [])).count() == 0


def test_only_empty_texts(spark):
    assert plain(M.mix(documents(spark, [(1, None, "en", "a"), (2, " ", "en", "b")])), "doc_id", "target", "taken") == [(1, 0.0, 0), (2, 0.0, 0)]
