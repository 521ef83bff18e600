from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, documents, plain, sentence
from wayfare.llm import chosen_path as C
from wayfare.llm import shingles as S


def brute(rows, threshold=Fraction(4, 5)):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i]] + [root[j] for j in near[i]]) for i in range(n)]
        if new == root:
            break
        root = new
    out = []
    for i, (doc, *_) in enumerate(rows):
        members = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        out.append((doc, (min(members) if members else None) if sets[i] else doc, len(near[i]), len(sets[i])))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def near_copies(base, count, every):
    """Copies of a text with one word in ``every`` replaced, at another place in each."""
    w = base.split()
    out = []
    for c in range(count):
        x = list(w)
        for at in range(c % every, len(x), every):
            x[at] = f"w{c}x{at}"
        out.append(" ".join(x))
    return out


def found(docs, **options):
    return plain(C.join(docs, **options), "doc_id", "class_id", "n_links", "n_shingles")


def test_against_brute_force(spark):
    rows = list(AWKWARD)
    for g in range(12):
        base = sentence(120 + 10 * g, 50 + g, tuple(f"v{k}" for k in range(60)))
        rows += [(1000 + 50 * g + i, t, "en", "a") for i, t in enumerate([base, base, *near_copies(base, 6, 30 + 12 * g)])]
    assert found(documents(spark, rows)) == brute(rows)


@pytest.mark.parametrize("bucket, depth", [(8, 1), (8, 3), (3, 2)])
def test_blocks_and_deep_paths_count_every_pair_once(spark, bucket, depth):
    base = sentence(300, 3, tuple(f"v{k}" for k in range(200)))
    rows = [(i, t, "en", "a") for i, t in enumerate(near_copies(base, 40, 300))] + [(500 + i, sentence(80, i), "en", "a") for i in range(30)]
    assert found(documents(spark, rows), bucket=bucket, depth=depth, recall=0.99999) == brute(rows)


def test_common_passage_is_no_link(spark):
    passage = sentence(60, 9, tuple(f"p{k}" for k in range(50)))
    rows = [(i, sentence(100, i, tuple(f"u{i}x{k}" for k in range(90))) + " " + passage, "en", "a") for i in range(60)]
    got = found(documents(spark, rows), bucket=5)
    assert all(doc == cls and links == 0 for doc, cls, links, _ in got)


def test_kept_has_one_of_each_class(spark):
    base = sentence(100, 4)
    rows = [(3, base, "en", "a"), (2, base + " more", "en", "a"), (9, sentence(100, 5), "en", "a"), (8, None, "en", "a"), (7, "", "en", "a")]
    docs = documents(spark, rows)
    out = C.kept(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 7, 8, 9]


def test_repeated_and_null_identifiers(spark):
    a = sentence(60, 1)
    rows = [(1, a, "en", "a"), (5, a + " tail", "en", "a"), (5, sentence(70, 2, ("q", "w", "e", "r", "t", "z")), "en", "a")]
    rows += [(9, sentence(80, 3, ("y", "x", "c", "v")), "en", s) for s in ("a", "b")] + [(None, sentence(90, 4, ("k", "l", "m", "n", "o")), "en", "a")] * 2
    rows += [(None, sentence(90, 4, ("k", "l", "m", "n", "o")) + " end", "en", "a"), (None, None, "en", "a"), (None, None, "en", "a"), (None, a + " other", None, None)]
    docs = documents(spark, rows)
    assert plain(C.join(docs), "doc_id", "class_id", "n_links", "n_shingles") == brute(rows)
    left = plain(C.kept(docs), "doc_id", "text")
    texts = [t for _, t in left]
    assert len(left) == 6 and texts.count(None) == 2
    assert {(1, rows[0][1]), (5, rows[2][1]), (9, rows[3][1])} <= set(left)
    assert left == plain(C.kept(docs.repartition(7)), "doc_id", "text")
    assert plain(C.kept(docs), "source", "text") == plain(C.kept(docs.repartition(7)), "source", "text")


def test_empty_table(spark):
    assert C.join(documents(spark, [])).count() == 0


def test_runs_follow_from_recall():
    assert C.found_by(0.8, 0.8, 1) == pytest.approx(1 - (0.75 * 0.2 + 0.25 * 0.04))
    r = C.runs_for(0.995, 0.8, 3)
    missed = 1 - C.found_by(0.8, 0.8, 3)
    assert missed**r <= 0.005 < missed ** (r - 1)


def test_shingles_of_long_text_do_not_depend_on_chunks(monkeypatch):
    text = sentence(5000, 1, tuple(f"v{k}" for k in range(500))).encode()
    one = S.shingles([text])[0]
    monkeypatch.setattr(S, "CHUNK", 100)
    assert (S.shingles([text])[0] == one).all()
    assert len(one) == len({tuple(text.split()[i : i + 5]) for i in range(4996)})


def test_drawn_is_what_spark_draws(spark):
    minima = spark.range(40).select(F.col("id").alias("path"), F.array(*[F.lit(k) for k in range(64)]).alias("minima"))
    got = minima.select("path", F.size(C.children(F.col("path"), F.col("minima"), 0.8, 64)).alias("n")).collect()
    assert {r.path: r.n for r in got} == {p: len(C.drawn(p, 0.8, 64)) for p in range(40)}
    keys = minima.select("path", C.children(F.col("path"), F.col("minima"), 0.8, 64)[0].alias("key"))
    own = spark.createDataFrame([(p, C.drawn(p, 0.8, 64)[0]) for p in range(40)], "path long, j int")
    assert keys.join(own, "path").where(F.col("key") == F.xxhash64("path", F.lit(0), "j", "j")).count() == 40


@pytest.mark.parametrize("similarity", [0.8, 0.82])
def test_recall_at_depth_three(spark, similarity):
    """Pairs whose minima agree with this chance, of four values each, so that every bucket is split to the end."""
    rng, pairs = np.random.default_rng(5), 4000
    one = rng.integers(0, 4, (pairs, C.COORDINATES))
    two = np.where(rng.random(one.shape) < similarity, one, (one + rng.integers(1, 4, one.shape)) % 4)
    rows = [(f"{side}{i}".encode(), 50, m[i].tolist()) for side, m in (("a", one), ("b", two)) for i in range(pairs)]
    sets = spark.createDataFrame(rows, "set_id binary, n long, minima array<int>")
    runs = C.runs_needed(C.RECALL, 0.8, C.DEPTH, C.COORDINATES)
    met = C.leaves(sets, 0.8, runs, C.DEPTH, 1, C.COORDINATES).select("path", F.col("set_id").cast("string").alias("s"))
    both = met.groupBy("path", F.substring("s", 2, 9).cast("int").alias("pair")).agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    together = {r.pair for r in both.select("pair").distinct().collect()}
    compared = (one == two).sum(1) >= C.least_agreeing(C.RECALL, 0.8, C.COORDINATES)
    assert sum(compared[i] for i in together) >= C.RECALL * pairs
