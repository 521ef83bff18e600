import collections
import gc
import random
import re
import weakref

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import AWKWARD, documents, plain, sentence
from wayfare.llm import collocations as C


def brute(rows, least=30, most=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        candidates = [p for p, a in c.items() if len(p) > 1 and a >= least]
        longer = collections.Counter()
        for q in candidates:
            for i in range(len(q)):
                for j in range(i + 2, len(q) + 1):
                    if j - i < len(q):
                        longer[q[i:j]] = max(longer[q[i:j]], c[q])
        scores = []
        for p in candidates:
            if p not in longer or 100 * longer[p] < 80 * c[p]:
                score, k = min((2_000_000 * c[p] // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                scores.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scores)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out, key=str)


def corpus(seed, n=300):
    """Texts in which some words follow each other more often than others; both cases, all separators."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "BCdfg" for b in ("a", "É", "o", "u")]
    fixed = ["New York", "united States of", "in spite of all", "a b a b", "x\tx x", "x  x"]
    rows = []
    for k in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else words[int(rng.random() ** 2 * len(words))] for _ in range(rng.randint(0, 60))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", " ;", "\x0b", "?!"]) for p in parts)
        rows.append((k, text, rng.choice(["en", "en", "de", None, "und"]), "a"))
    return rows


@pytest.mark.parametrize(("least", "most", "lead"), [(30, 2000, None), (3, 40, 5), (2, 10, 10), (8, 1, 1)])
def test_against_counting_everything(spark, least, most, lead):
    rows = corpus(1) + AWKWARD + [(1000 + i, "The Same text, in spite of all.", "fr", "a") for i in range(40)]
    got = C.collocations(documents(spark, rows), least=least, most=most, lead=lead)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(plain(got), key=str) == brute(rows, least, most)


def test_short_runs_and_blocks_count_the_same(spark, monkeypatch):
    rows = [(1, sentence(4000, 1), "en", "a"), (2, sentence(3000, 2).replace("of", "OF."), "en", "a"), (3, "q " * 1000, "de", "a"), *corpus(2, 60)]
    batches = documents(spark, rows, 1).select("lang", "text").toArrow().to_batches()
    batches = [b.set_column(0, "lang", b.column(0).fill_null("und")) for b in batches]

    def total(find, size):
        seen = collections.Counter()
        for b in C.counting(find, size)(iter(batches)):
            for lang, phrase, m, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen[lang, phrase, m] += f
        return seen

    class Sent:
        value = (b"\xff" * C.MAP_BYTES,) * 3

    finds = [C.single_words, C.selected_pairs(Sent), C.growth(Sent, 2), C.growth(Sent, 3)]
    whole = [total(f, C.RUN) for f in finds]
    monkeypatch.setattr(C.blocks, "__defaults__", (64,))
    for size in (5, 17, 100):
        assert [total(f, size) for f in finds] == whole
    assert [whole[k]["de", " ".join("q" * (k + 1)), k + 1] for k in range(4)] == [1000, 999, 998, 997]


def test_map_has_the_bits_the_tasks_ask_for(spark):
    rows = [("en", f"a{i} b{i * 7} ü") for i in range(500)] + [("", "x y z")]
    bits = np.frombuffer(C.bit_map(C.checksums(spark.createDataFrame(rows, "lang string, phrase string"), 3)), np.uint8)
    run = C.Run()
    for lang, phrase in rows:
        run.add(lang, phrase.encode().split())
        run.end()
    run.closed()
    sums = {m: at for m, _, at in run.levels(3)}
    assert C.has(bits, sums[3]).all() and len(sums[3]) == len(rows)
    assert not C.has(bits, sums[2]).any()
    assert np.unpackbits(bits).sum() <= len(rows)


def test_scores_beyond_64_bits(spark):
    cases = [(1, 1, 1), (3, 4, 5), ((1 << 63) // 2_000_000, 1 << 50, 3), (1 << 61, (1 << 61) + 5, 1 << 62), (10**18, 10**18, 10**18)]
    got = spark.createDataFrame(cases, "a long, l long, r long").select("*", C.share("a", "l", "r").alias("s")).collect()
    assert {tuple(r[:3]): r["s"] for r in got} == {(a, le, r): 2_000_000 * a // (le + r) for a, le, r in cases}


def test_no_phrases(spark):
    assert C.collocations(documents(spark, AWKWARD).limit(0)).count() == 0
    assert C.collocations(documents(spark, [(1, "one. two, three", "en", "a"), (2, None, None, None)]), least=1).count() == 0


def test_a_run_that_has_ended_is_freed_at_once():
    """Runs lay in a cycle with their words, so a task held those of all its texts until Python looked for cycles."""
    alive, seen = weakref.WeakSet(), []

    def find(run):
        alive.add(run)
        seen.append(len(alive))
        yield from C.single_words(run)

    parts = [pa.record_batch([pa.array(["en"] * 20), pa.array([f"word{i} of {k} and more words" for k in range(20)])], names=["lang", "text"]) for i in range(5)]
    gc.disable()
    try:
        made = [r for b in C.counting(find, size=60)(iter(parts)) for r in b.to_pylist()]
    finally:
        gc.enable()
    assert len(seen) > 5 and set(seen) == {1}
    assert sum(r["f"] for r in made if r["phrase"] == "words") == 100
