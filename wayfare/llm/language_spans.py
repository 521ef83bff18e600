"""Languages of mixed texts: scripts narrow the candidates, Viterbi over per-word scores labels spans.

Training counts, per language, hashed letter n-grams (one to three letters, word ends marked) and scripts over
all training texts. A word's score for a language is the sum of the log odds of its n-grams against the mean of
the languages, bounded per word; a language whose training letters hardly ever use the word's script is no
candidate. Viterbi finds the best sequence of languages with a fixed penalty for every switch between words;
runs of words with one language are spans. Scores are whole numbers, so that ties are exact and go to the first
language by code point.

The model has ``SLOTS`` numbers per language whatever the input. Viterbi is exact for texts of any length and
works on blocks of words of many texts at once.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and no spans; training rows need a
text and a language; without any training row everything is ``und``; repeated rows get equal results; an empty
table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import prepare

SLOTS = 1 << 15
#: Scores are in units of 1/64 nat; a word counts at most this much for or against a language.
UNIT, MOST = 64, 8 * 64
SWITCH = 10 * 64
#: A language is a candidate for a script that has at least this share of its training letters.
SCRIPT_SHARE = 0.001
FAR = 1 << 30
MOST_LANGUAGES = 500
UND = "und"
#: Code points handled at a time.
BLOCK = 1 << 19

#: First and last code point of the letters of a script, from the Unicode charts.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)],
}
OTHER = len(SCRIPTS)


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For code points of the basic plane: lower case (0 for what is no letter or mark), and script."""
    lower, script = np.zeros(1 << 16, np.uint32), np.full(1 << 16, OTHER, np.uint8)
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            lower[c] = ord(low) if len(low) == 1 else c
    for k, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            script[first : last + 1] = k
    return lower, script


MARKS = re.compile("[^\x00-\u02ff]").search


@dataclass
class Words:
    """The letter words of a run of texts: code points, and first and last place of each word."""

    low: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray
    first: np.ndarray


def words_of(texts: list[str]) -> Words:
    lower, _ = letters()
    joined = " ".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(points < 1 << 16, lower[np.minimum(points, 0xFFFF)], 0)
    beyond = np.flatnonzero(points >= 1 << 16)
    low[beyond] = [c if unicodedata.category(chr(c))[0] in "LM" else 0 for c in points[beyond].tolist()]
    inside = low > 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    bare = np.array([not any(map(str.isalpha, joined[a:b])) for a, b in zip(start, stop, strict=True)], bool) if MARKS(joined) else None
    if bare is not None:  # marks alone make no word
        for a, b in zip(start[bare], stop[bare], strict=True):
            low[a:b] = 0
        start, stop = start[~bare], stop[~bare]
    first = 1 + np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    return Words(low, start, stop, np.searchsorted(first, start, "right") - 1, first)


def gram_slots(w: Words, slots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, slot) of the n-grams that begin at each place; a word's n-grams may begin at the gap before it."""
    p = w.low.astype(np.uint64)
    out = []
    inside = p > 0
    at = np.flatnonzero(inside)
    key = p[at]
    out.append((at, key))
    two = np.flatnonzero(inside[:-1] | inside[1:])
    out.append((two, (p[two] << np.uint64(21)) | p[two + 1] | np.uint64(1 << 62)))
    three = np.flatnonzero(inside[1:-1])
    out.append((three, (p[three] << np.uint64(42)) | (p[three + 1] << np.uint64(21)) | p[three + 2] | np.uint64(1 << 63)))
    return [(at, ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % slots) for at, key in out]


def script_of(w: Words) -> np.ndarray:
    """The script of each word's first letter."""
    _, script = letters()
    return script[np.minimum(w.low[w.start], 0xFFFF)] if len(w.start) else np.zeros(0, np.uint8)


def runs(column: pa.Array, size: int = BLOCK):
    held, used = [], 0
    for x in column:
        t = x.as_py() or ""
        held.append(t)
        used += len(t)
        if used >= size:
            yield held
            held, used = [], 0
    if held:
        yield held


# ---- training --------------------------------------------------------------------------------------------------


def counted(slots: int):
    """Counts of n-gram slots and, after those, of scripts per language: a task's rows where they are not 0."""
    schema = pa.schema([("lang", pa.string()), ("pos", pa.int32()), ("n", pa.int64())])

    def run(parts):
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            langs = np.array(part.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = sums.setdefault(lang, np.zeros(slots + OTHER + 1, np.int64))
                for texts in runs(part.column(1).filter(pa.array(langs == lang))):
                    w = words_of(texts)
                    for _, slot in gram_slots(w, slots):
                        own[:slots] += np.bincount(slot, minlength=slots)
                    own[slots:] += np.bincount(script_of(w), weights=w.stop - w.start, minlength=OTHER + 1).astype(np.int64)
        for lang, own in sorted(sums.items()):
            pos = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pos), pa.string()), pa.array(pos.astype(np.int32)), pa.array(own[pos])], schema=schema)

    return run


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # slots x languages, whole numbers
    candidate: np.ndarray  # scripts x languages


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", slots: int = SLOTS, script_share: float = SCRIPT_SHARE) -> Model:
    """Counts over all rows with a language and a text. The driver gets ``slots`` sums per language."""
    given = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    prepare(rows.sparkSession)
    parts = given.mapInArrow(counted(slots), "lang string, pos int, n long")
    listed = parts.groupBy("lang", "pos").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    langs = sorted(set(listed["lang"]))
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has over {MOST_LANGUAGES} values")
    counts = np.zeros((slots + OTHER + 1, len(langs)))
    place = {x: k for k, x in enumerate(langs)}
    counts[listed["pos"], [place[x] for x in listed["lang"]]] = listed["n"]
    grams, scripts = counts[:slots], counts[slots:]
    logs = np.log(grams + 1.0) - np.log(grams.sum(0) + slots)
    odds = logs - logs.mean(1, keepdims=True) if langs else logs
    return Model(langs, np.rint(odds * UNIT).astype(np.int32), scripts >= np.maximum(1, scripts.sum(0) * script_share))


# ---- labelling -------------------------------------------------------------------------------------------------


def word_scores(w: Words, model: Model, slots: int) -> np.ndarray:
    """Score of each word in each language."""
    k = len(model.langs)
    sums = np.zeros((len(w.low) + 1, k), np.int64)
    at_place = np.zeros((len(w.low), k), np.int32)
    for place, slot in gram_slots(w, slots):
        at_place[place] += model.scores[slot]
    np.cumsum(at_place, axis=0, out=sums[1:])
    found = sums[w.stop] - sums[np.maximum(w.start - 1, 0)]
    found = np.clip(found, -MOST, MOST)
    allowed = model.candidate[script_of(w)]
    none = ~allowed.any(1)
    found[~allowed & ~none[:, None]] = -FAR
    found[none] = 0
    return found


def forward(scores: np.ndarray, begins: np.ndarray, switch: int, block: int = 64) -> np.ndarray:
    """Best sums of sequences that end at each word in each language; ``begins`` marks first words of texts.

    Blocks of words advance in step: first each block by itself from every language it may be entered in, then
    the values at the blocks' ends one block after the other, then the blocks again from their true entries.
    """
    n, k = scores.shape
    if not n:
        return scores
    count = -(-n // block)
    padded = np.zeros((count * block, k), np.int64)
    padded[:n] = scores
    fresh = np.zeros(count * block, bool)
    fresh[:n] = begins
    padded, fresh = padded.reshape(count, block, k), fresh.reshape(count, block)

    def step(v: np.ndarray, s: np.ndarray, new: np.ndarray) -> np.ndarray:
        best = v.max(-1, keepdims=True)
        moved = np.maximum(v, best - switch)
        return np.where(new, 0, moved) + s

    # low: sums from entry in language e, the others out of reach
    by_entry = np.where(np.eye(k, dtype=bool), 0, -FAR * 64)[None].repeat(count, 0)
    for t in range(block):
        by_entry = step(by_entry, padded[:, t, None, :], fresh[:, t, None, None])
    entry = np.zeros((count, k), np.int64)
    anew = fresh.any(1)  # where a text begins, the block's end does not depend on its entry
    for b in range(1, count):
        entry[b] = by_entry[b - 1, 0] if anew[b - 1] else (entry[b - 1][:, None] + by_entry[b - 1]).max(0)
    out = np.empty_like(padded)
    v = entry
    for t in range(block):
        v = step(v, padded[:, t], fresh[:, t, None])
        out[:, t] = v
    return out.reshape(-1, k)[:n]


def traced(there: np.ndarray, begins: np.ndarray, switch: int, block: int = 64) -> np.ndarray:
    """One best sequence per text, read back from the sums of ``forward``; ties stay in the language, else the first.

    A step back is a map from the next word's language to this word's. Blocks of words advance in step, as in ``forward``:
    their maps are composed, then the blocks' entries follow one by one, then all words.
    """
    n, k = there.shape
    count = -(-n // block)
    top = there.argmax(1)
    stays = there >= there.max(1, keepdims=True) - switch
    stays[:-1] &= ~begins[1:, None]
    stays[-1:] = False
    back = np.tile(np.arange(k), (count * block, 1))
    back[:n] = np.where(stays, np.arange(k), top[:, None])
    back = back.reshape(count, block, k)
    whole = np.tile(np.arange(k), (count, 1))
    for t in reversed(range(block)):
        whole = np.take_along_axis(back[:, t], whole, 1)
    after = np.zeros(count, np.int64)
    for b in reversed(range(count - 1)):
        after[b] = whole[b + 1, after[b + 1]]
    out, at = np.empty((count, block), np.int64), np.arange(count)
    for t in reversed(range(block)):
        after = back[at, t, after]
        out[:, t] = after
    return out.reshape(-1)[:n]


def labelled(w: Words, model: Model, slots: int, switch: int) -> np.ndarray:
    """The language number of each word along one best sequence of its text."""
    scores = word_scores(w, model, slots)
    if not len(scores):
        return np.zeros(0, np.int64)
    begins = np.ones(len(scores), bool)
    begins[1:] = w.text[1:] != w.text[:-1]
    return traced(forward(scores, begins, switch), begins, switch)


def per_text(model: Model, slots: int, switch: int):
    """(lang_pred, score, spans) for runs of texts."""

    def label(texts: list[str]):
        w = words_of(texts)
        lang = labelled(w, model, slots, switch) if model.langs else np.zeros(len(w.start), np.int64)
        k = max(1, len(model.langs))
        size = np.bincount(w.text * k + lang, weights=w.stop - w.start, minlength=len(texts) * k).reshape(len(texts), k)
        total = size.sum(1)
        best = size.argmax(1)
        score = np.where(total > 0, size.max(1) / np.maximum(total, 1), 0.0)
        names = [model.langs[b] if n and model.langs else UND for b, n in zip(best, total, strict=True)]
        cut = np.ones(len(lang), bool)
        cut[1:] = (lang[1:] != lang[:-1]) | (w.text[1:] != w.text[:-1])
        at = np.flatnonzero(cut) if model.langs else np.zeros(0, np.int64)
        return names, [s if m != UND else 0.0 for s, m in zip(score.tolist(), names, strict=True)], w, lang, at

    return label


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: int = SWITCH, slots: int = SLOTS) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters in that language) and n_spans of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int64())])

    def run(parts):
        label = per_text(sent.value, slots, switch)
        for part in parts:
            at = 0
            for texts in runs(part.column(1)):
                names, scores, w, _, spans = label(texts)
                n = np.bincount(w.text[spans], minlength=len(texts)) if len(spans) else np.zeros(len(texts), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(texts)), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(n, pa.int64())], schema=schema)
                at += len(texts)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans long")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: int = SWITCH, slots: int = SLOTS) -> DataFrame:
    """One row per span: doc_id, first and end place in the text (code points), language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())])

    def run(parts):
        label = per_text(sent.value, slots, switch)
        for part in parts:
            ids, at = part.column(0).to_pylist(), 0
            for texts in runs(part.column(1)):
                _, _, w, lang, first = label(texts)
                if sent.value.langs and len(first):
                    last = np.append(first[1:], len(lang)) - 1
                    own = w.text[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[at + i] for i in own], pa.int64()), pa.array(w.start[first] - w.first[own]), pa.array(w.stop[last] - w.first[own]), pa.array([sent.value.langs[x] for x in lang[first]])], schema=schema
                    )
                at += len(texts)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, start long, stop long, lang string")


def held_out(id_col: Column | str) -> Column:
    """Documents kept from training: a fourth, by checksum of the identifier."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(4)) == 2, F.lit(False))
