"""Small document tables with the awkward cases, and rows for comparison."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, size long, n int, kept boolean, draw string, digest string, "
    "_mix int, _time int, _own int, _gone int, _known int, text_sha256 string, owner long, `set_id` string, path long"
)
EXTRA = (7, 1, False, "x", "y", 1, 2, 3, 4, 5, "z", 9, "s", 11)


def documents(spark, rows, partitions=3):
    """``rows``: (doc_id, text, lang, source). Further columns have names that operators use within."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(partitions)


def plain(df, *names):
    names = names or tuple(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.select(*names).collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


def sentence(n, seed, vocabulary=("ab", "the", "cde", "of", "fghi", "and", "jk", "lmno", "to", "pq", "rst", "in", "uvw", "xyz")):
    """``n`` words by a fixed rule."""
    rng = random.Random(seed)
    return " ".join(rng.choice(vocabulary) for _ in range(n))


AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "one", None, None), (4, sentence(60, 1), "en", "b"), (5, sentence(60, 1), "en", None),
    (5, sentence(60, 1), "en", None), (6, sentence(60, 1) + " tail", "fr", "b"), (None, "no id", "en", "c"), (None, None, None, None),
    (7, "été \U0001f600 中文 á \x1c\x85 x\r\ny\t z", "fr", "c"), (8, sentence(30_000, 2), "zz", "a"), (9, "   \n\t ", "de", "a"),
]
