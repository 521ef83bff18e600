"""Byte-level BPE with two tiers: a minimal perfect hash over the vocabulary, and a heap over linked bytes.

A pre-token that is in the vocabulary is one id, found in the perfect hash; any other is merged pair by pair,
lowest rank first, with a heap of pairs over a linked list of its bytes. The tables are built once on the driver
from a rank file (their size is the vocabulary's, a few MB whatever the input) and sent to the executors; texts
never leave their task, and nothing is shuffled.

Defined cases: a null text counts as empty and has no ids; text that looks like a special token is ordinary
text; unknown ids cannot be decoded and raise; repeated rows give repeated results; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoded pre-tokens that a task remembers; it starts afresh when full.
MEMO = 250_000
#: Below this code point pre-tokens are split with spelled-out character classes.
LATIN = 0x250
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def members(prop: str) -> str:
    """The characters of a property below ``LATIN``, as the inside of a character class."""
    has = regex.compile(prop).fullmatch
    return "".join(f"\\u{c:04x}" for c in range(LATIN) if has(chr(c)))


def spelled(pattern: str, classes: dict[str, str]) -> str:
    """``pattern`` with property escapes replaced; \\S stands for the negated white space class."""
    out, inside, i = [], False, 0
    names = sorted(classes, key=len, reverse=True)
    while i < len(pattern):
        name = next((n for n in names if pattern.startswith(n, i)), None)
        if name:
            body = classes[name]
            out.append(body if inside or body.startswith("\\p") or body.startswith("\\P") else f"[{body}]")
            i += len(name)
        elif pattern.startswith(r"\S", i) and r"\s" in classes and not inside:
            out.append(f"[^{classes[chr(92) + 's']}]")
            i += 2
        else:
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
    return "".join(out)


def place(h: int, d: int, n: int) -> int:
    """The slot of a 64-bit hash under a displacement."""
    return ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 >> 31) % n


@dataclass
class PerfectHash:
    """Hash and displace: as many slots as keys, and one displacement for each bucket of keys."""

    slots: list[bytes]
    values: array
    moves: array

    @classmethod
    def build(cls, table: dict[bytes, int]) -> PerfectHash:
        n = max(1, len(table))
        buckets: dict[int, list[bytes]] = {}
        for key in table:
            buckets.setdefault(xxhash.xxh64_intdigest(key) % n, []).append(key)
        slots: list[bytes | None] = [None] * n
        moves = array("q", [0]) * n
        many = sorted((b for b in buckets if len(buckets[b]) > 1), key=lambda b: (-len(buckets[b]), b))
        for b in many:
            hashes = [xxhash.xxh64_intdigest(k) for k in buckets[b]]
            d = 1
            while True:
                at = {place(h, d, n) for h in hashes}
                if len(at) == len(hashes) and all(slots[s] is None for s in at):
                    break
                d += 1
            moves[b] = d
            for key, h in zip(buckets[b], hashes, strict=True):
                slots[place(h, d, n)] = key
        free = (s for s in range(n) if slots[s] is None)
        for b in sorted(b for b in buckets if len(buckets[b]) == 1):  # lone keys take the free slots as they come
            s = next(free)
            moves[b], slots[s] = -s - 1, buckets[b][0]
        return cls([s if s is not None else b"" for s in slots], array("q", [table.get(s, -1) if s is not None else -1 for s in slots]), moves)

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh64_intdigest(key)
        n = len(self.slots)
        d = self.moves[h % n]
        s = -d - 1 if d < 0 else place(h, d, n)
        return self.values[s] if self.slots[s] == key and self.values[s] >= 0 else None


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the adjacent pair of lowest rank is merged first, the leftmost of equal ones."""
    n = len(piece)
    end = list(range(1, n + 1))  # a part begins at its index and ends here; 0: it was merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push, get = heapq.heappop, heapq.heappush, ranks.get
    while heap:
        _, i, stop = pop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # a side has grown or gone since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            r = get(piece[i : end[stop]])
            if r is not None:
                push(heap, (r, i, end[stop]))
        left = before[i]
        if left >= 0:
            r = get(piece[left:stop])
            if r is not None:
                push(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@dataclass
class Codec:
    """Encodes and decodes texts by a rank table and a pattern that splits texts into pre-tokens."""

    ranks: dict[bytes, int]
    pattern: str
    whole: PerfectHash
    starts: np.ndarray
    lengths: np.ndarray
    content: np.ndarray

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> Codec:
        lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        words = sorted((i, word) for word, i in ranks.items())
        for i, word in words:
            lengths[i] = len(word)
        starts = np.cumsum(lengths) - lengths
        return cls(ranks, pattern, PerfectHash.build(ranks), starts, lengths, np.frombuffer(b"".join(w for _, w in words), np.uint8))

    def splitter(self):
        """A function from text to pre-tokens.

        Texts of Latin letters take the standard library's engine, which is several times faster but knows no
        properties: there the same pattern is used with the members of each property below ``LATIN`` spelled out.
        """
        # white space as Unicode defines it, which leaves out the separators U+001C to U+001F
        full = regex.compile(spelled(self.pattern, {r"\s": r"\p{White_Space}", r"\S": r"\P{White_Space}"})).findall
        classes = {f"\\p{{{c}}}": members(f"\\p{{{c}}}") for c in ("L", "N")} | {r"\s": members(r"\p{White_Space}")}
        short = spelled(self.pattern, classes)
        if "\\p" in short or "\\P" in short:
            return full
        latin, other = re.compile(short).findall, re.compile(f"[^\x00-{chr(LATIN - 1)}]").search
        return lambda text: full(text) if other(text) else latin(text)

    def ids(self, piece: bytes) -> list[int]:
        known = self.whole.get(piece)
        return [known] if known is not None else merge(piece, self.ranks)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.splitter()(text) for i in self.ids(piece.encode())]

    def decode(self, ids) -> bytes:
        """The bytes of the ids, one after the other, in blocks of bounded size."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        out = []
        for at in range(0, len(ids), 1 << 16):
            some = ids[at : at + (1 << 16)]
            sizes = self.lengths[some]
            shift = np.repeat(self.starts[some] - (np.cumsum(sizes) - sizes), sizes)
            out.append(self.content[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)


class Memo(dict):
    """Packed ids of pre-tokens seen lately."""

    def __init__(self, codec: Codec, most: int):
        super().__init__()
        self.codec, self.most = codec, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = array("I", self.codec.ids(piece.encode())).tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


def digests(codec_of, memo: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        split, packed = codec.splitter(), Memo(codec, memo)
        look = packed.__getitem__
        for part in parts:
            sizes, ids_at, texts_at = [], [], []
            for text in part.column(1):
                ids = array("I")
                ids.frombytes(b"".join(map(look, split(text.as_py() or ""))))
                sizes.append(len(ids))
                ids_at.append(hashlib.sha256(ids).hexdigest())
                texts_at.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids_at), pa.array(texts_at)], schema=schema)

    return run


def id_lists(codec_of, memo: int):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(parts):
        codec = codec_of()
        split, packed = codec.splitter(), Memo(codec, memo)
        for part in parts:
            for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids = array("I")
                ids.frombytes(b"".join(map(packed.__getitem__, split(text.as_py() or ""))))
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([list(ids)], pa.list_(pa.int32()))], schema=schema)

    return run


def text_lists(codec_of):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])

    def run(parts):
        codec = codec_of()
        for part in parts:
            texts = [codec.decode(x or []) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], schema=schema)

    return run


def shared_codec(docs: DataFrame, path: str, pattern: str):
    """Build the tables on the driver and send them to every executor once."""
    sent = docs.sparkSession.sparkContext.broadcast(Codec.of(read_ranks(path), pattern))
    return lambda: sent.value


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes, for every row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return narrow.mapInArrow(digests(shared_codec(docs, path, pattern), memo), ENCODED)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """doc_id and ids of every row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return narrow.mapInArrow(id_lists(shared_codec(docs, path, pattern), memo), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of every row of ``encode``'s result."""
    return encoded.select("doc_id", "ids").mapInArrow(text_lists(shared_codec(encoded, path, pattern)), "doc_id long, text binary")
