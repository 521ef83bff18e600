"""Phrases whose words belong together, per language, by best-first growth with admissible bounds.

A phrase of two to four words is cut once into a first part and a rest; the worst cut's share
2 f(phrase) / (f(first) + f(rest)) is its score. Reported are the best phrases of each language that are not
nearly always part of a longer one.

**Bound.** Any phrase that begins with p (p itself too) is cut after its first word w at worst: its rest is at
least as frequent as the phrase, and the phrase at most as frequent as p, so its score is at most
2 f(p) / (f(w) + f(p)). Words alone have the bound 1, so the first step counts all words and pairs. After that a
round takes, per language, a level (the score of its ``lead``-th pair), and grows only prefixes whose bound reaches it:
first pairs to three words, then those to four, each to the right and to the left (what drops a phrase may
begin earlier). All phrases that reach the level, the counts of their parts and what would drop them are
then exact. A language with 2000 survivors at its level is settled: its 2000th score with all ties is
known. The others go on with the next level, ``WIDEN`` times as many pairs, until no pair is left.

**Counting.** A pass reads whole texts in Python and counts phrases in runs of about ``RUN`` words before the
exchange, so a very frequent phrase is a few rows per task. The prefixes to grow reach the tasks as a bit map of
fixed size (``MAP_BYTES``, by checksum). A phrase whose bit is set by another one is counted too, and
exactly, so the map needs no size limit on the prefixes: with very many it only selects less.
Only phrases that occur ``least`` times are kept after the exchange.

Scores use 64-bit products while they fit and decimals of 38 digits beyond, so they are exact.

Defined cases: a null text is empty; null languages count as ``und``, with those that say so; empty texts and
pieces have no words; very long texts are read in blocks; copies count as often as they occur; a language
with fewer phrases gives them all, one without any has no row; an empty table gives an empty result. Only the
columns named are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import materialise

LEAST = 30
MOST = 2000
SCALE = 2_000_000
#: Words counted together in a task before they are handed on.
RUN = 1 << 21
BLOCK = 1 << 20
WORDS = 4
#: The bit map of prefixes has 8 MB, whatever their number; a phrase's place is the sum of its checksums by these
#: factors (below 2^62, so it never overflows) modulo a prime.
MAP_BYTES = 1 << 23
PLACES = 67_108_859
FACTORS = (110_503_979, 200_560_493, 86_028_157, 49_979_693, 179_424_691)
#: How many times more pairs the next round of an unsettled language looks at.
WIDEN = 8

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Every separator becomes a full stop.
PLAIN = bytes(ord(".") if c in SEPARATORS else c for c in range(256))
GAP = re.compile(rb"[ \t.,;:!?\n-\r]")

COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("m", pa.int32()), ("f", pa.int64())])
COUNTED_DDL = "lang string, phrase string, m int, f long"


class Words(dict):
    """Numbers of the words of one language; what is known of each word stands in lists that all languages share.

    It holds the lists and not the run: in a cycle, runs that have ended would stay until Python looks for cycles.
    """

    def __init__(self, lang: str, run: Run):
        super().__init__({b".": 0})
        self.lang, self.sum = lang, zlib.crc32(lang.encode())
        self.words, self.langs, self.sums, self.lang_sums = run.words, run.langs, run.sums, run.lang_sums

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        self.sums.append(zlib.crc32(word))
        self.lang_sums.append(self.sum)
        return k


def blocks(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """A text cut at white space or separators into parts of about ``size`` bytes."""
    at = 0
    while len(text) - at > size:
        gap = GAP.search(text, at + size)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def word_list(text: bytes) -> list[bytes]:
    """Lower-case words, and a full stop where a piece ends."""
    return text.lower().translate(PLAIN).replace(b".", b" . ").split()


class Run:
    """Words of texts as numbers; 0 parts pieces and texts. Phrases that start at ``own`` or later count in the next run."""

    def __init__(self):
        self.words, self.langs, self.sums, self.lang_sums = [b"."], [""], [0], [0]
        self.known, self.parts, self.n, self.own = {}, [np.zeros(1, np.int32)], 1, None

    def add(self, lang: str, block: list[bytes]) -> None:
        number = self.known.get(lang)
        if number is None:
            number = self.known[lang] = Words(lang, self)
        some = np.fromiter(map(number.__getitem__, block), np.int32)
        self.parts.append(some)
        self.n += len(some)

    def end(self) -> None:
        self.parts.append(np.zeros(1, np.int32))
        self.n += 1

    def cut(self, most: int) -> list[bytes]:
        """End the run within a text; the last words, fewer than ``most``, are seen here and belong to the next run."""
        ids, tail = np.concatenate(self.parts), []
        while len(tail) < most - 1 and ids[len(ids) - 1 - len(tail)]:
            tail.append(self.words[ids[len(ids) - 1 - len(tail)]])
        self.own = len(ids) - len(tail)
        self.end()
        return tail[::-1]

    def closed(self) -> None:
        """Lay the numbers and what belongs to them side by side; no words may follow."""
        self.ids = np.concatenate(self.parts)
        self.parts, self.known = [], {}
        self.stop = len(self.ids) if self.own is None else self.own
        self.sum, self.lang_sum = np.array(self.sums, np.int64), np.array(self.lang_sums, np.int64)

    def levels(self, most: int):
        """For m = 1, 2, ...: the starts of phrases of m words, and their checksums."""
        ids = self.ids
        starts = np.flatnonzero(ids).astype(np.int32)
        at = self.lang_sum[ids[starts]] * FACTORS[0]
        for m in range(1, most + 1):
            last = ids[starts + m - 1]  # a piece ends before the array does
            if m > 1:
                on = last != 0
                starts, at, last = starts[on], at[on], last[on]
            at += self.sum[last] * FACTORS[m]
            yield m, starts, at

    def rows(self, m: int, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The distinct phrases of m words among those that start at ``starts`` and their number."""
        starts = starts[starts < self.stop]
        number = self.ids[starts].astype(np.int64)
        for k in range(1, m):
            if k > 1:
                number = np.unique(number, return_inverse=True)[1]
            number = number * np.int64(len(self.words)) + self.ids[starts + k]
        _, first, counts = np.unique(number, return_index=True, return_counts=True)
        places = starts[first]
        for k in range(0, len(places), 1 << 14):
            some = [self.ids[at : at + m].tolist() for at in places[k : k + (1 << 14)].tolist()]
            langs = pa.array([self.langs[x[0]] for x in some], pa.string())
            phrases = pa.array([b" ".join([self.words[i] for i in x]) for x in some], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs, phrases, pa.array([m] * len(some), pa.int32()), pa.array(counts[k : k + (1 << 14)], pa.int64())], schema=COUNTED)


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the map has the bits of these checksums."""
    place = at % PLACES
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def counting(find, size: int = RUN):
    """A pass over (lang, text) that hands runs of words to ``find``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Run()
        for part in parts:
            for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                for block in blocks(text.as_buffer().to_pybytes() if text.is_valid else b""):
                    now.add(lang, word_list(block))
                    if now.n >= size:
                        tail = now.cut(WORDS)
                        now.closed()
                        yield from find(now)
                        now = Run()
                        now.add(lang, tail)
                now.end()
        now.closed()
        yield from find(now)

    return run


def single_words(run: Run) -> Iterator[pa.RecordBatch]:
    counts = np.bincount(run.ids[: run.stop], minlength=len(run.words))[1:]
    for k in range(0, len(counts), 1 << 15):
        n = counts[k : k + (1 << 15)]
        kept = np.flatnonzero(n)  # words only seen in the part that the next run counts are left to it
        langs, phrases = ([held[1 + k + i] for i in kept.tolist()] for held in (run.langs, run.words))
        columns = [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array([1] * len(kept), pa.int32()), pa.array(n[kept], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=COUNTED)


def pair_sums(sent):
    """Checksums of the pairs of two selected words, and how often each occurs."""

    def find(run: Run) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value[0], np.uint8)
        good = has(bits, run.lang_sum * FACTORS[0] + run.sum * FACTORS[1])
        for m, starts, at in run.levels(2):
            if m == 2:
                both = good[run.ids[starts]] & good[run.ids[starts + 1]] & (starts < run.stop)
                sums, n = np.unique(at[both], return_counts=True)
                for k in range(0, len(sums), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(sums[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)], pa.int64())], names=["at", "f"])

    return find


def selected_pairs(sent):
    def find(run: Run) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value[0], np.uint8)
        for m, starts, at in run.levels(2):
            if m == 2:
                yield from run.rows(m, starts[has(bits, at)])

    return find


def growth(sent, m: int):
    """Counts of the phrases of ``m`` + 1 words that begin or end with a selected phrase of ``m`` words, and, if ``m``
    is 3, of the phrases of 3 words that begin with a selected pair. Phrases with a pair that is not frequent are left out."""

    def find(run: Run) -> Iterator[pa.RecordBatch]:
        grown, begin, frequent = (np.frombuffer(b, np.uint8) for b in sent.value)

        def hits(starts, at, bits):
            out = np.zeros(len(run.ids) + 1, bool)
            out[starts[has(bits, at)]] = True
            return out

        for k, starts, at in run.levels(m + 1):
            if k == 2:
                often = hits(starts, at, frequent)
                begins = hits(starts, at, begin) & often
            if k > 2:
                good = np.all([often[starts + i] for i in range(k - 1)], axis=0)
            if k == 3 and m == 3:
                yield from run.rows(k, starts[good & begins[starts]])
            if k == m:
                part = hits(starts, at, grown)
            if k == m + 1:
                yield from run.rows(k, starts[good & (part[starts] | part[starts + 1])])

    return find


def counts(docs: DataFrame, find) -> DataFrame:
    """Phrases with their occurrences in all texts."""
    return docs.mapInArrow(counting(find), COUNTED_DDL).groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f"))


def share(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(SCALE * a / (l + r)) of three columns of longs, exactly: by longs where the product fits, else by decimals."""
    return F.expr(
        f"CASE WHEN {a} <= {((1 << 63) - 1) // SCALE} THEN ({a} * {SCALE}L) div ({l} + {r}) "
        f"ELSE (CAST({a} AS decimal(19,0)) * {SCALE}) div (CAST({l} AS decimal(19,0)) + CAST({r} AS decimal(19,0))) END"
    )


def bit_map(checksums: DataFrame) -> bytes:
    """The map of a column ``at``: parts of 4 KB are made by the executors, at most 2,048 come to the driver."""
    rows = checksums.select((F.pmod("at", F.lit(PLACES)) + 1).alias("at"))  # Spark's buckets and places in them count from 1
    parts = rows.groupBy(F.expr("bitmap_bucket_number(at)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("map"))
    out = bytearray(MAP_BYTES)
    for r in parts.collect():
        out[(r["part"] - 1) << 12 : r["part"] << 12] = r["map"]
    return bytes(out)


def checksums(phrases: DataFrame, m: int) -> DataFrame:
    """The checksums of (lang, phrase) of ``m`` words, as the tasks have them."""
    words = F.split("phrase", " ")
    at = F.crc32(F.encode("lang", "UTF-8")) * F.lit(FACTORS[0])
    for k in range(m):
        at = at + F.crc32(F.encode(words[k], "UTF-8")) * F.lit(FACTORS[k + 1])
    return phrases.select(at.alias("at"))


def sent_maps(docs: DataFrame, *some: DataFrame | bytes | None):
    """The maps of checksums, sent to every executor; none gives an empty map."""
    maps = (bytes(MAP_BYTES) if x is None else x if isinstance(x, bytes) else bit_map(x) for x in some)
    return docs.sparkSession.sparkContext.broadcast(tuple(maps))


def words_and_pairs(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """All words, and the frequent pairs. Pairs of frequent words are first counted by checksum, so that only those that
    may be frequent are spelled out; pairs that share a checksum are counted together there and so never missed."""
    words = materialise(counts(texts, single_words), "phrases-1")
    sums = texts.mapInArrow(counting(pair_sums(sent_maps(texts, checksums(words.where(F.col("f") >= least), 1)))), "at long, f long")
    often = sums.groupBy("at").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    pairs = counts(texts, selected_pairs(sent_maps(texts, often))).where(F.col("f") >= least)
    return words, materialise(pairs, "phrases-2")


def grow(texts: DataFrame, frequent: bytes, prefixes: DataFrame, pairs: DataFrame | None, m: int, least: int, name: str) -> DataFrame:
    """Frequent phrases of ``m`` + 1 words around the prefixes, and of three words that begin with ``pairs``."""
    sent = sent_maps(texts, checksums(prefixes, m), pairs if pairs is None else checksums(pairs, 2), frequent)
    return materialise(counts(texts, growth(sent, m)).where(F.col("f") >= least), name)


def distinct(*some: DataFrame) -> DataFrame:
    """All phrases once; one counted in several rounds has the same count in each."""
    out = some[0]
    for x in some[1:]:
        out = out.unionByName(x)
    return out.groupBy("lang", "phrase", "m").agg(F.max("f").alias("f"))


def scored(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """lang, phrase, m, a, l, r, score of phrases (lang, phrase, m, f) by their worst cut; phrases with a part that
    ``known`` lacks are left out."""
    words, k = F.split("phrase", " "), F.col("k")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).select(
        "*", F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(words, k + 1, F.col("m") - k), " ").alias("rest")
    )
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    each = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", share("f", "l", "r"))
    return (
        each.groupBy("lang", "phrase", "m", F.col("f").alias("a"))
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("w"), F.count(F.lit(1)).alias("cuts"))
        .where(F.col("cuts") == F.col("m") - 1)
        .select("lang", "phrase", "m", "a", "w.l", "w.r", "w.score")
    )


def bounded(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` with the bound of all that begin with them."""
    head = words.select("lang", F.col("phrase").alias("_w"), F.col("f").alias("_f"))
    return phrases.withColumn("_w", F.substring_index("phrase", " ", 1)).join(head, ["lang", "_w"]).withColumn("bound", share("f", "_f", "f")).drop("_w", "_f")


def around(phrases: DataFrame) -> DataFrame:
    """For every phrase that is all but one end word of a given one: how often the most frequent such one occurs.
    Longer ones still occur at most as often as one of these, so these decide."""
    words, n = F.split("phrase", " "), F.col("m") - 1
    both = F.array(F.array_join(F.slice(words, F.lit(1), n), " "), F.array_join(F.slice(words, F.lit(2), n), " "))
    return phrases.where("m > 2").select("lang", F.explode(both).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most: int = MOST, lead: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best ``most`` phrases (see the module)."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words, two = words_and_pairs(texts, least)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.where(F.col("f") >= least)
    known, frequent = words.unionByName(two), bit_map(checksums(two, 2))
    pairs = materialise(scored(two, words).join(bounded(two, words).select("lang", "phrase", "bound"), ["lang", "phrase"]), "pairs")

    lead = lead or 2 * most
    # languages that are not settled; what is at or above ``above`` has been searched
    unsettled = materialise(pairs.select("lang", F.lit(SCALE + 1).cast("long").alias("above")).distinct(), "unsettled")
    done = []
    while not unsettled.isEmpty():
        order = Window.partitionBy("lang").orderBy(F.col("score").desc(), "phrase")
        leading = pairs.join(unsettled, "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= lead)
        level = F.when(F.count(F.lit(1)) < lead, 0).otherwise(F.min("score")).cast("long").alias("level")
        levels = materialise(leading.groupBy("lang", "above").agg(level), "levels")
        reached = "bound >= level AND bound < above"

        prefixes = pairs.join(levels, "lang").where(reached).select("lang", "phrase")
        threes = distinct(known, grow(texts, frequent, prefixes, None, 2, least, "phrases-3")).where("m = 3")
        longer_prefixes = materialise(bounded(threes, words).join(levels, "lang").where(reached).select("lang", "phrase"), "prefixes-3")
        rests = longer_prefixes.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase")).distinct()
        known = materialise(distinct(known, threes, grow(texts, frequent, longer_prefixes, rests, 3, least, "phrases-4")), "phrases")

        long = known.where("m > 2")
        best = pairs.drop("bound").unionByName(scored(long, known)).join(levels, "lang").where("score >= level")
        inside = F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * 80
        alive = best.join(around(long), ["lang", "phrase"], "left").where(~F.coalesce(inside, F.lit(False)))
        by = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        top = alive.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= most)
        top = materialise(top.select("lang", "rank", "phrase", "a", "l", "r", "score"), "best")
        found = levels.join(top.groupBy("lang").agg(F.count(F.lit(1)).alias("found")), "lang", "left")
        settled = (F.col("level") == 0) | (F.coalesce("found", F.lit(0)) >= most)
        done.append(top.join(found.where(settled), "lang", "left_semi"))
        unsettled = materialise(found.where(~settled).select("lang", F.col("level").alias("above")), "unsettled")
        lead *= WIDEN
    result = done[0] if done else docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, score long")
    for more in done[1:]:
        result = result.unionByName(more)
    return result.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
