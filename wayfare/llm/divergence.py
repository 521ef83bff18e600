"""Quality rules by distribution divergence.

Two histograms of a document are held against those of its language: character classes, and the language's
commonest short words with one bin for all others. The measure is the Jensen-Shannon distance (base 2, 0 to 1).
Small texts differ by chance, so a limit falls with the text's length (``base + slack / sqrt(words)``) and each
comparison has a minimum length below which it says nothing.

With ``labels`` the word test is set from labelled good documents (``fitted``): it then runs from ``min_short_words``
letter words on, with the least slack that all labelled good documents need, and some room.

References are counted over all documents of a language. A language with fewer than ``min_reference_words``
letter words has none. Documents of such a language, or of none given, are measured against the nearest reference, but
judged by the base rules alone: distances to another language say nothing of quality. Junk that passes the base rules
stays there.

Defined cases: a null text has no words and fails the base rules; without any reference only the base rules
count; repeated rows get equal results; an empty table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import materialise

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
CLASSES = ("lower", "upper", "number", "space", "mark", "other")
MARKS = ".,;:?!'\"-()"
#: A word that can be a common one: letters only, at most this many.
COMMON_LETTERS = 6
COMMON_WORDS = 50
#: Labelled good documents of a length that set a slack of the word test; room above what they need.
LEAST_SAMPLE = 100
ROOM = 0.05
#: Languages are a closed list of codes; more than this many is an error in the column.
MOST_LANGUAGES = 1000

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    most_repeated: float = 0.5
    min_chars_words: int = 50
    char_base: float = 0.15
    char_slack: float = 0.75
    min_common_words: int = 100
    common_base: float = 0.2
    common_slack: float = 2.5
    #: From here to ``min_common_words`` letter words the word test has a slack of its own, if one is set.
    min_short_words: int = 50
    short_slack: float | None = None
    min_reference_words: int = 1000


@cache
def class_table() -> np.ndarray:
    """The class of each code point of the basic plane; beyond it letters count as lower case."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        if chr(c) in SPACES or kind[0] == "Z":
            out[c] = 3
        elif kind in ("Lu", "Lt"):
            out[c] = 1
        elif kind[0] in "LM":
            out[c] = 0
        elif kind[0] == "N":
            out[c] = 2
        else:
            out[c] = 4 if chr(c) in MARKS else 5
    return out


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(class_table()[np.minimum(points, 0xFFFF)], minlength=len(CLASSES))


letter_words = re.compile(r"[^\W\d_]+").findall


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def part(a):
        some = a > 0
        return float(np.sum(a[some] * np.log2(a[some] / m[some])))

    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of three words found at least twice."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    key = ids
    for k in range(1, width):  # windows of k + 1 words, numbered anew so that numbers stay small
        key = key[:-1] * len(seen) + ids[k:]
        _, key, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[key] > 1)
    mark = np.zeros(len(words), bool)
    for k in range(width):
        mark[hit + k] = True
    return int(mark.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def class_counts(parts):
    """Character classes per language, one row per language and batch."""
    for part in parts:
        sums: dict[str | None, np.ndarray] = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            counts = char_classes(text.as_py() or "")
            sums[lang] = sums[lang] + counts if lang in sums else counts
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "counts"]
        )


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", limits: Limits = Limits()) -> dict[str, tuple[np.ndarray, list[str], np.ndarray]]:
    """For each language: character classes, its common words, and their counts with those of all other words.

    What reaches the driver is 6 sums and at most 51 counts per language.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = rows.mapInArrow(class_counts, "lang string, counts array<long>").groupBy("lang").agg(
        *[F.sum(F.col("counts")[k]).alias(c) for k, c in enumerate(CLASSES)]
    )
    chars = {r[0]: np.array(r[1:], float) for r in sums.limit(MOST_LANGUAGES + 1).collect()}
    if len(chars) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has over {MOST_LANGUAGES} values")
    # the empty word stands for all letter words of a text, so that one exchange counts both
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)
    split = rows.select("lang", found.alias("found")).select(
        "lang", F.explode(F.concat(F.transform(F.filter("found", lambda w: F.length(w) <= COMMON_LETTERS), lambda w: F.struct(w.alias("word"), F.lit(1).alias("n"))), F.array(F.struct(F.lit("").alias("word"), F.size("found").alias("n"))))).alias("x")
    )
    counted = split.groupBy("lang", "x.word").agg(F.sum("x.n").alias("n"))
    best = Window.partitionBy("lang").orderBy((F.col("word") != ""), F.desc("n"), "word")
    top = counted.withColumn("r", F.row_number().over(best)).where(F.col("r") <= COMMON_WORDS + 1)
    common: dict[str, list[tuple[str, int]]] = {}
    totals: dict[str, int] = {}
    for lang, word, n in top.orderBy("lang", "r").select("lang", "word", "n").collect():
        if word:
            common.setdefault(lang, []).append((word, n))
        else:
            totals[lang] = n
    out = {}
    for lang in sorted(chars):
        total, words = totals.get(lang) or 0, common.get(lang, [])
        if total >= limits.min_reference_words and words:
            known = np.array([n for _, n in words] + [total - sum(n for _, n in words)], float)
            out[lang] = (chars[lang], [w for w, _ in words], known)
    return out


class Judge:
    """Measures of one text against the references."""

    def __init__(self, refs, limits: Limits):
        self.refs, self.limits = refs, limits
        self.places = {lang: {w: i for i, w in enumerate(words)} for lang, (_, words, _) in refs.items()}

    def distances(self, lang: str, classes: np.ndarray, words: list[str]) -> tuple[float, float]:
        chars, listed, known = self.refs[lang]
        place = self.places[lang]
        hits = np.bincount([place[w] for w in words if w in place], minlength=len(listed) + 1) if words else np.zeros(len(listed) + 1)
        hits = hits.astype(float)
        hits[-1] = len(words) - hits[:-1].sum()
        return js_distance(classes, chars), js_distance(hits, known) if words else 0.0

    def measure(self, lang: str | None, text: str | None) -> tuple:
        """Words, their characters, symbols, repeated lines and words, whether a base rule fails, distances, letter words."""
        own, text = self.limits, text or ""
        words = text.encode("utf-8", "surrogatepass").split()
        n = len(words)
        repeats = repeated_words(words)
        failed = n < own.min_words or repeats > own.most_repeated * n
        char_d = word_d = letters = None
        if not failed and self.refs:
            classes, found = char_classes(text), letter_words(text.lower())
            letters = len(found)
            if lang in self.refs:
                char_d, word_d = self.distances(lang, classes, found)
            else:
                char_d, word_d = min((self.distances(x, classes, found) for x in self.refs), key=sum)
        return (
            n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, failed, char_d, word_d, letters,
        )

    def verdict(self, lang: str | None, n: int, failed: bool, char_d: float | None, word_d: float | None, letters: int | None) -> bool:
        """Whether a text of these measures is kept."""
        own = self.limits
        if failed or lang not in self.refs:
            return not failed
        far_chars = n >= own.min_chars_words and char_d > own.char_base + own.char_slack / n**0.5
        slack = own.common_slack if letters >= own.min_common_words else own.short_slack if letters >= own.min_short_words else None
        far_words = slack is not None and word_d > own.common_base + slack / letters**0.5
        return not (far_chars or far_words)

    def __call__(self, lang: str | None, text: str | None) -> tuple:
        *got, letters = self.measure(lang, text)
        return (*got, self.verdict(lang, got[0], *got[5:], letters))


def good_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame | None:
    """Identifiers labelled good and never bad; nothing if no label is 0 or 1."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").alias("q")).where(F.col("id").isNotNull() & F.col("q").isin(0, 1))
    return None if known.isEmpty() else known.groupBy("id").agg(F.min("q").alias("q")).where("q = 1").select("id")


def with_slacks(found: DataFrame, good: DataFrame, limits: Limits) -> Limits:
    """``limits`` with the slacks that the rows of ``found`` (id, letters, word_distance) labelled good need."""
    need = (F.col("word_distance") - limits.common_base) * F.sqrt(F.col("letters").cast("double"))
    rows = found.where(F.col("id").isNotNull()).join(good, "id").groupBy(F.col("letters") >= limits.min_common_words).agg(F.count(F.lit(1)), F.max(need))
    slacks = {long: max(0.0, most) + ROOM for long, count, most in rows.collect() if count >= LEAST_SAMPLE}
    return replace(limits, common_slack=min(limits.common_slack, slacks.get(True, limits.common_slack)), short_slack=slacks.get(False, limits.short_slack))


def fitted(docs: DataFrame, labels: DataFrame, refs, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> Limits:
    """``limits`` with the slack that labelled good documents need, for short and long ones.

    ``labels``: the identifier and quality (0 or 1). All are used but for identifiers labelled both ways. A slack is the
    largest that a good document with a reference of its own needs, plus ``ROOM``, and for long ones never above ``common_slack``; with under ``LEAST_SAMPLE`` documents
    of a length, ``limits`` stay as they are there. Two counts and two largest values reach the driver. Texts are measured
    where they lie, so that only two numbers a document meet the labels.
    """
    good = good_labels(labels, id_col) if refs else None
    if good is None:
        return limits

    def needs(parts):
        rule = Judge(refs, limits)
        for part in parts:
            rows = []
            for i, lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                if i is not None and lang in refs:
                    *_, failed, _, far, letters = rule.measure(lang, text.as_py())
                    if not failed and letters >= limits.min_short_words:
                        rows.append((i, letters, far))
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["id", "letters", "word_distance"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return with_slacks(rows.mapInArrow(needs, "id long, letters long, word_distance double"), good, limits)


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits(), labels: DataFrame | None = None,
) -> DataFrame:
    """One row per document with its measures, whether a base rule failed and whether it is kept.

    With ``labels`` the measures are written first: each text is then read once for the limits and the verdict.
    """
    refs = references(docs, lang_col, text_col, limits)
    good = good_labels(labels, id_col) if labels is not None and refs else None
    types = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
    schema = pa.schema(list(zip([c.split()[0] for c in MEASURES.split(", ")], types, strict=True)))
    rows = docs.select(F.col(id_col).cast("long"), F.col(lang_col), F.col(text_col))

    def batch(ids, got):
        cols = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), types[1:], strict=True)] if got else [pa.array([], t) for t in types[1:]]
        return pa.RecordBatch.from_arrays([ids, *cols], schema=schema)

    def run(parts):
        rule = Judge(refs, limits)
        for part in parts:
            yield batch(part.column(0), [rule(lang, text.as_py()) for lang, text in zip(part.column(1).to_pylist(), part.column(2), strict=True)])

    if good is None:
        return rows.mapInArrow(run, MEASURES)
    measures = MEASURES.removesuffix("kept boolean") + "letters long, lang string"
    names = [c.split()[0] for c in measures.split(", ")]

    def measure(parts):
        rule = Judge(refs, limits)
        kinds = [*types[1:-1], pa.int64()]
        for part in parts:
            got = [rule.measure(lang, text.as_py()) for lang, text in zip(part.column(1).to_pylist(), part.column(2), strict=True)]
            cols = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)] if got else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols, part.column(1)], names=names)

    measured = materialise(rows.mapInArrow(measure, measures), "measures")
    known = measured.where(F.col("lang").isin(list(refs)) & ~F.col("base_failed") & (F.col("letters") >= limits.min_short_words))
    fit = with_slacks(known.select(F.col("doc_id").alias("id"), "letters", "word_distance"), good, limits)

    def decide(parts):
        rule = Judge(refs, fit)
        for part in parts:
            rows = [c.to_pylist() for c in part.columns[1:]]
            yield batch(part.column(0), [(*r[:8], rule.verdict(r[9], r[0], *r[5:9])) for r in zip(*rows, strict=True)])

    return measured.mapInArrow(decide, MEASURES)


def kept(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits(), labels: DataFrame | None = None,
) -> DataFrame:
    """The documents that pass, with the columns of ``docs``; each row is judged where it lies."""
    refs = references(docs, lang_col, text_col, limits)
    if labels is not None:
        limits = fitted(docs, labels, refs, id_col, text_col, lang_col, limits)
    names = docs.columns
    lang_at, text_at = names.index(lang_col), names.index(text_col)

    def run(parts):
        rule = Judge(refs, limits)
        for part in parts:
            stay = [rule(lang, text.as_py())[-1] for lang, text in zip(part.column(lang_at).to_pylist(), part.column(text_at), strict=True)]
            yield part.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
