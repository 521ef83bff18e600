"""Severity grades by cumulative-link ordinal regression on sparse word features.

``P(grade >= k) = sigmoid(w . x - cut_k)`` with one weight vector for all grades and ordered cuts; the expected
severity is the sum of these chances. Features are the letter words of a text in lower case, valued
``log2(1 + occurrences)``. An L1 penalty leaves weights on few words.

Fitting uses a bounded, documented sample: at most ``SAMPLE`` labelled rows of each label, those with the least
hashes, and its words that occur in at least ``MIN_DOCS`` of them; the model therefore has a fixed bound too.
Scoring covers every row where it lies.

The labels at hand say toxic or not. ``graded`` makes grades from them: 0 for rows that are not toxic, and 1 to
``TOP`` for toxic rows, by how often they use words that mark toxic rows of the sample (used by a share of toxic
rows at least ``MARK_RATIO`` times that of the others), cut at the sample's quantiles.

Defined cases: a null text has no features; of rows with one identifier the one with the least hash of its text is
sampled; an identifier labelled both ways counts once for each; labels of identifiers that are null or without a row are not used;
without toxic labels, without others or without a telling word every severity is 0; repeated rows get equal results; an empty table gives
an empty result. Only the columns named are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 4000
MIN_DOCS = 3
TOP = 3
MARK_RATIO = 20.0
#: Words whose shares of toxic and other rows differ by less than this many standard errors are no features.
LEAST_Z = 4.0
PENALTY = 0.0002
ROUNDS = 400
LEVEL = 0.5

words = re.compile(r"[^\W\d_]+").findall


@dataclass
class Model:
    weights: dict[str, float]
    cuts: list[float]

    def chances(self, text: str | None) -> list[float]:
        """P(grade >= k) for k = 1, 2, …"""
        known = self.weights
        seen = Counter(w for w in words((text or "").lower()) if w in known)
        s = sum(known[w] * math.log2(1 + n) for w, n in sorted(seen.items()))
        return [0.0 if c == math.inf else 1 / (1 + math.exp(min(700.0, c - s))) for c in self.cuts]


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = SAMPLE) -> list[tuple[int, dict[str, int]]]:
    """(label, word counts) of the sampled rows: at most ``most`` per label reach the driver."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("id", F.lit("fit")), "id").limit(most) for k in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * most rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")  # where identifiers repeat
    rows = rows.groupBy("id", "label").agg(one).select("id", "label", "one.text")

    def count(parts):
        for part in parts:
            for label, text in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                c = Counter(words((text.as_py() or "").lower()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label], pa.int32()), pa.array([list(c)], pa.list_(pa.string())), pa.array([list(c.values())], pa.list_(pa.int32()))], names=["label", "words", "counts"]
                )

    got = rows.mapInArrow(count, "label int, words array<string>, counts array<int>").toArrow()
    out = []
    for label, ws, ns in zip(got.column("label").to_pylist(), got.column("words"), got.column("counts"), strict=True):
        out.append((label, dict(zip(ws.as_py(), ns.as_py(), strict=True))))
    return sorted(out, key=lambda r: (r[0], sorted(r[1].items())))


def graded(rows: list[tuple[int, dict[str, int]]], top: int = TOP, ratio: float = MARK_RATIO) -> np.ndarray:
    """Grades of the sampled rows."""
    size = Counter(label for label, _ in rows)
    used = {k: Counter() for k in (0, 1)}
    for label, c in rows:
        used[label].update(c.keys())
    marks = {w for w, n in used[1].items() if n >= MIN_DOCS and n / size[1] >= ratio * (used[0][w] + 0.5) / max(size[0], 1)}
    hits = np.array([sum(n for w, n in c.items() if w in marks) for _, c in rows], float)
    toxic = np.array([label for label, _ in rows]) == 1
    limits = np.quantile(hits[toxic], [k / top for k in range(1, top)]) if toxic.any() else []
    return np.where(toxic, 1 + sum((hits > x).astype(int) for x in limits), 0)


def fit(rows: list[tuple[int, dict[str, int]]], grades: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS, min_docs: int = MIN_DOCS) -> Model:
    """Accelerated proximal gradient on the mean negative log likelihood with an L1 penalty on the weights."""
    top = int(grades.max()) if len(grades) else 0
    if top == 0 or (grades > 0).all():
        return Model({}, [math.inf])
    bad = Counter(w for (_, c), g in zip(rows, grades, strict=True) if g for w in c)
    good = Counter(w for (_, c), g in zip(rows, grades, strict=True) if not g for w in c)
    n_bad, n_good = int((grades > 0).sum()), int((grades == 0).sum())

    def tells(w: str) -> bool:
        a, b = bad[w], good[w]
        share = (a + b) / (n_bad + n_good)
        return a + b >= min_docs and abs(a / n_bad - b / n_good) >= LEAST_Z * math.sqrt(share * (1 - share) * (1 / n_bad + 1 / n_good) + 1e-12)

    vocabulary = sorted(w for w in bad.keys() | good.keys() if tells(w))
    if not vocabulary:
        return Model({}, [math.inf])
    place = {w: i for i, w in enumerate(vocabulary)}
    row = np.concatenate([np.full(sum(w in place for w in c), i, np.int32) for i, (_, c) in enumerate(rows)] or [np.zeros(0, np.int32)])
    col = np.array([place[w] for _, c in rows for w in c if w in place], np.int32)
    val = np.log2(1 + np.array([n for _, c in rows for w, n in c.items() if w in place], float))
    n, m = len(rows), len(vocabulary)
    above = grades[:, None] >= np.arange(1, top + 1)[None, :]

    def slopes(w, cuts):
        """Gradients of the loss; the grade's chance is the difference of two neighbouring sigmoids."""
        s = np.bincount(row, weights=val * w[col], minlength=n)
        p = 1 / (1 + np.exp(np.clip(cuts[None, :] - s[:, None], -60, 60)))
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
        chance = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-12)
        d = p * (1 - p)
        g_s, g_c = np.zeros(n), np.zeros((n, top))
        for k in range(top):
            up, down = grades == k + 1, grades == k  # the cut is the lower or the upper end of the grade
            change = (d[:, k] / chance) * (up.astype(float) - down)
            g_s -= change
            g_c[:, k] += change
        return np.bincount(col, weights=val * g_s[row], minlength=m) / n, g_c.sum(0) / n

    w, cuts = np.zeros(m), np.linspace(0.5, 2.0, top) if top > 1 else np.array([0.5])
    base = above.mean(0)
    cuts = np.maximum.accumulate(np.log((1 - base + 1e-6) / (base + 1e-6)) + 1e-3 * np.arange(top))
    seen_w, seen_c, t = w.copy(), cuts.copy(), 1.0
    # per-coordinate steps: the curvature along a word is at most a fourth of its mean square, times the words of a row
    step = 4.0 / np.maximum(np.bincount(col, weights=val * val, minlength=m), 1.0) * n / 8.0
    step = np.minimum(step, 50.0)
    for _ in range(rounds):
        g, gc = slopes(seen_w, seen_c)
        new_w = seen_w - step * g
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0.0)
        new_c = np.maximum.accumulate(seen_c - 1.0 * gc + 1e-9 * np.arange(top))
        if np.dot(seen_w - new_w, new_w - w) > 0:  # momentum has overshot
            t = 1.0
        ahead = (1 + math.sqrt(1 + 4 * t * t)) / 2
        seen_w, seen_c = new_w + (t - 1) / ahead * (new_w - w), np.maximum.accumulate(new_c + (t - 1) / ahead * (new_c - cuts))
        w, cuts, t = new_w, new_c, ahead
    kept = np.flatnonzero(w)
    return Model({vocabulary[i]: float(w[i]) for i in kept}, [float(c) for c in cuts])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Model:
    rows = sample(docs, labels, id_col, text_col, label_col, options.pop("most", SAMPLE))
    if {label for label, _ in rows} != {0, 1}:
        return Model({}, [math.inf])
    return fit(rows, graded(rows), **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """doc_id, toxic (P(grade >= 1) at least ``level``), severity (likeliest grade), expected_severity, p_toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.bool_()), ("severity", pa.int32()), ("expected_severity", pa.float64()), ("p_toxic", pa.float64())])

    def run(parts):
        own = sent.value
        for part in parts:
            got = []
            for text in part.column(1):
                p = own.chances(text.as_py())
                ends = [1.0, *p, 0.0]
                grade = max(range(len(ends) - 1), key=lambda k: (ends[k] - ends[k + 1], -k))
                got.append((p[0] >= level, grade, sum(p), p[0]))
            cols = zip(*got, strict=True) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, toxic boolean, severity int, expected_severity double, p_toxic double")
