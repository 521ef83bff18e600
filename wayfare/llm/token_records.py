"""Token sequences as length-delimited binary records, with an offset index per file for shuffled reads.

A record file is a run of frames. A frame is the payload's length (u64), the masked checksum of these eight
bytes (u32), the payload, and the masked checksum of the payload (u32); all little-endian. A masked checksum is
the CRC-32 turned right by 15 bits plus ``MASK``, so that a checksum over data that hold checksums stays useful.
A payload is one byte (1: the document has an identifier), the identifier (i64), the width of an id in bytes
(u8: 2 or 4) and the ids. Beside ``x.rec`` stands ``x.idx``: the offset of every frame and the end (u64 each).

Documents are dealt by ranges of the identifier and sorted, so files in order of (part, file) hold all documents
in ascending order. Each task writes files of at most ``FILE_BYTES`` under names of its own and returns one row
per file; the table of these rows (``write``) is committed by Spark and names only files of tasks that ended
well, so a repeated or lost attempt leaves at most files nobody reads. ``read`` streams whole files, ``fetch``
reads single records by offset in any order, ``shuffled`` gives a seeded order of all records.

Long texts are encoded block by block, cut before a space that no white space follows, where the pre-tokenizer
always cuts. A block's chunks between such places are looked up once each: those of ASCII and Latin-1 letters go to the
library's model by pre-token, others to the whole library. Ids of short pre-tokens are remembered (``MEMO`` per worker).

Defined cases: a null text is empty and has the end id alone; null identifiers come first; rows with equal
identifiers are ordered by a hash of the text, equal rows in any order; an empty table gives no files and empty
results; columns but the two named are not read. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import partitions
from wayfare.session import materialise, stage_folder

FILE_BYTES = 128 << 20
MEMO = 1 << 20
BLOCK = 1 << 20
HELD = 1 << 24
MASK = 0xA282EAD8

LENGTH = struct.Struct("<QI")
SUM = struct.Struct("<I")
HEAD = struct.Struct("<BqB")

#: Before a space that no white space follows a pre-token always begins, whatever stands before and after.
CUT = re.compile(r"(?= \S)")
SPLIT = re.compile(r" (?=\S)").split
GAP = re.compile(r" (?!\S)").search
#: The byte-level pre-tokenizer on texts of ASCII and Latin-1 letters.
PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*").fullmatch
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+", re.ASCII).findall


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones as they are, the rest from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


LETTERS = byte_letters()


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + SUM.pack(masked(size)) + payload + SUM.pack(masked(payload))


class Broken(ValueError):
    """A frame whose length, checksum or place is not as written."""


def unframed(stream, offset: int) -> bytes | None:
    """The payload of the frame that begins at ``offset``, where the stream stands; None at the end of the file."""
    head = stream.read(LENGTH.size)
    if not head:
        return None
    if len(head) < LENGTH.size or masked(head[:8]) != LENGTH.unpack(head)[1]:
        raise Broken(f"the length at {offset} is damaged")
    size = LENGTH.unpack(head)[0]
    body = stream.read(size + SUM.size)
    if len(body) < size + SUM.size or masked(body[:size]) != SUM.unpack_from(body, size)[0]:
        raise Broken(f"the record at {offset} is damaged")
    return body[:size]


def payload(doc: int | None, ids: bytes, width: int) -> bytes:
    return HEAD.pack(doc is not None, doc or 0, width) + ids


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    known, doc, width = HEAD.unpack_from(data)
    return (doc if known else None), np.frombuffer(data, "<u2" if width == 2 else "<u4", offset=HEAD.size).astype("<u4")


class Encoder:
    """Packed ids of texts by a byte-level tokenizer of the ``tokenizers`` library, words remembered."""

    def __init__(self, path: str, end_id: int | None, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if max(size, (end_id or 0) + 1) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.end = array(self.code, [] if end_id is None else [end_id]).tobytes()
        self.model = self.tokenizer.model
        self.most, self.pieces = memo, {}

    def piece(self, p: str) -> bytes:
        """Ids of one pre-token, by the library's model alone."""
        found = self.pieces.get(p)
        if found is None:
            found = array(self.code, [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(LETTERS))]).tobytes()
            if len(p) <= 64:
                if len(self.pieces) >= self.most:
                    self.pieces.clear()
                self.pieces[p] = found
        return found

    def chunk(self, c: str) -> bytes:
        """Ids of a chunk: a plain one by its pre-tokens, of which fewer are new, another by the whole library."""
        if c.isascii() or PLAIN(c):
            return b"".join(map(self.piece, PIECES(c)))
        return array(self.code, self.tokenizer.encode(c, add_special_tokens=False).ids).tobytes()

    def spaced(self, w: str) -> bytes:
        """Ids of a chunk given without the space in front; words, with one more character or none, by the short way."""
        if w.isascii() or PLAIN(w):
            if w.isalpha():
                return self.piece(" " + w)
            body = w[:-1]
            if body.isalpha():
                return self.piece(" " + body) + self.piece(w[-1])
        return self.chunk(" " + w)

    def blocks(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that begin a pre-token; every chunk is looked up once, without the space in front."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = lists.values.dictionary_encode()
        ids = pa.array(list(map(self.spaced, words.dictionary.to_pylist())), pa.large_binary()).take(words.indices)
        _, ends, data = ids.buffers()
        ends, data = np.frombuffer(ends, np.int64), memoryview(data or b"")
        first = lists.offsets.to_numpy()
        rest = zip(ends[first[:-1] + 1].tolist(), ends[first[1:]].tolist(), strict=True)
        return [self.chunk(t.partition(" ")[0]) + data[a:b] for t, (a, b) in zip(texts, rest, strict=True)]

    def parted(self, text: str) -> bytes:
        """The same for one text where some spaces have white space after them."""
        first, *rest = SPLIT(text)
        return self.chunk(first) + b"".join(map(self.spaced, rest))

    def encode_all(self, rows: Iterable[tuple[int | None, str | None]]) -> Iterator[tuple[int | None, bytes]]:
        """Every row with the ids of its whole text and the end id, packed. Rows are held back up to ``HELD`` code points."""
        held, plain, size = [], [], 0  # held: a key and its blocks, as ids or as the place in ``plain``

        def done() -> Iterator[tuple[int | None, bytes]]:
            found = self.blocks(plain)
            for key, own in held:
                yield key, b"".join([*(found[x] if isinstance(x, int) else x for x in own), self.end])

        for key, text in rows:
            text, at, own = text or "", 0, []
            while at is not None:
                cut = CUT.search(text, at + BLOCK) if len(text) - at > BLOCK else None
                block, at = (text[at:], None) if cut is None else (text[at : cut.start()], cut.start())
                if GAP(block) is None:
                    own.append(len(plain))
                    plain.append(block)
                else:
                    own.append(self.parted(block))
                size += len(block)
            held.append((key, own))
            if size > HELD:
                yield from done()
                held, plain, size = [], [], 0
        yield from done()

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([(None, text)]))[1]


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int | None) -> Encoder:
    """One encoder per Python worker, so that its memory serves all tasks of the worker."""
    return Encoder(path, end_id)


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder name as Spark gives it, and the path in it."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(folder)


class Writer:
    """A record file and its index, both new."""

    def __init__(self, fs, folder: str, name: str):
        self.name, self.records, self.ids, self.at = name, 0, 0, 0
        self.data = fs.open_output_stream(f"{folder}/{name}.rec", buffer_size=1 << 20)
        self.index = fs.open_output_stream(f"{folder}/{name}.idx", buffer_size=1 << 16)

    def add(self, data: bytes, n: int) -> None:
        self.index.write(struct.pack("<Q", self.at))
        framed = frame(data)
        self.data.write(framed)
        self.at += len(framed)
        self.records += 1
        self.ids += n

    def close(self) -> None:
        self.index.write(struct.pack("<Q", self.at))
        self.index.close()
        self.data.close()


FILES = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
FILES_DDL = "part int, file int, name string, records long, ids long, bytes long"


def writing(folder: str, path: str, end_id: int | None, file_bytes: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        now, count = None, 0

        def done() -> pa.RecordBatch:
            now.close()
            row = [part, count, now.name, now.records, now.ids, now.at]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, FILES, strict=True)], schema=FILES)

        rows = ((doc, text.as_py()) for batch in parts for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        first = next(rows, None)
        if first is not None:
            encoder = encoder_of(path, end_id)
            for doc, ids in encoder.encode_all(chain([first], rows)):
                if now is None:
                    now = Writer(fs, base, f"{part:06d}-{count:05d}-{attempt}")
                now.add(payload(doc, ids, encoder.width), len(ids) // encoder.width)
                if now.at >= file_bytes:
                    yield done()
                    now, count = None, count + 1
        if now is not None:
            yield done()

    return run


def write(docs: DataFrame, path: str, folder: str | None = None, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode and write all documents; one row per file: folder, part, file, name, records, ids, bytes, first_id, the
    number of ids in all files before."""
    spark = docs.sparkSession
    folder = folder or f"{stage_folder(spark)}/token-records-{uuid.uuid4().hex}"
    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row")
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")]  # the row's number only parts equal rows
    dealt = narrow.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    files = materialise(dealt.mapInArrow(writing(folder, path, end_id, file_bytes), FILES_DDL), "token-files")
    sums = files.groupBy("part").agg(F.sum("ids").alias("_ids"))  # one row per shuffle partition at most
    parts = sums.select("part", F.coalesce(F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        files.join(parts, "part")
        .withColumn("first_id", (own + F.col("_before")).cast("long"))
        .withColumn("folder", F.lit(folder))
        .drop("_before")
    )


def offsets(fs, path: str) -> np.ndarray:
    with fs.open_input_stream(f"{path}.idx") as f:
        return np.frombuffer(f.read(), "<u8")


def records(fs, path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of a file, front to back; the index has to agree with the frames."""
    places = offsets(fs, path)
    with fs.open_input_stream(f"{path}.rec", buffer_size=1 << 20) as f:
        for at, end in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
            data = unframed(f, at)
            if data is None or at + LENGTH.size + len(data) + SUM.size != end:
                raise Broken(f"{path}: the index does not fit the record at {at}")
            yield parsed(data)
        if f.read(1):
            raise Broken(f"{path}: records after the end of the index")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def spread(files: DataFrame) -> DataFrame:
    """Rows of files over all tasks; there are few, but each stands for up to ``FILE_BYTES``."""
    return files.repartition(partitions(files), "name")


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and the checksum of the ids, of every record read back."""

    def run(parts):
        for part in parts:
            for folder, name, first in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                fs, base = opened(folder)
                held = []
                for doc, ids in records(fs, f"{base}/{name}"):
                    held.append((doc, first, len(ids), zlib.crc32(ids)))
                    first += len(ids)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=READ)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=READ)

    return spread(files).select("folder", "name", "first_id").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _one(doc: int | None, ids: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), lists], names=["doc_id", "ids"])


def read(files: DataFrame) -> DataFrame:
    """doc_id and ids of every record."""

    def run(parts):
        for part in parts:
            for folder, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                fs, base = opened(folder)
                for doc, ids in records(fs, f"{base}/{name}"):
                    yield _one(doc, ids)

    return spread(files).select("folder", "name").mapInArrow(run, "doc_id long, ids array<int>")


def shuffled(files: DataFrame, seed: int) -> DataFrame:
    """folder, name, record: every record once, in an order that the seed decides."""
    each = files.select("folder", "name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1)).alias("record"))
    return each.withColumn("_draw", F.xxhash64(F.lit(seed), "name", "record")).orderBy("_draw", "name", "record").drop("_draw")


def fetch(wanted: DataFrame, keep_open: int = 16) -> DataFrame:
    """doc_id and ids of the records named by folder, name and record, in the order of ``wanted``; each is one read
    at its offset. A record that the file does not have is an error."""

    def run(parts):
        held: OrderedDict = OrderedDict()
        for part in parts:
            for folder, name, k in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                if (folder, name) not in held:
                    fs, base = opened(folder)
                    held[folder, name] = fs.open_input_file(f"{base}/{name}.rec"), offsets(fs, f"{base}/{name}")
                    if len(held) > keep_open:
                        held.popitem(last=False)[1][0].close()
                held.move_to_end((folder, name))
                data, places = held[folder, name]
                if not 0 <= k < len(places) - 1:
                    raise Broken(f"{name}: there is no record {k}")
                data.seek(int(places[k]))
                yield _one(*parsed(unframed(data, int(places[k]))))
        for data, _ in held.values():
            data.close()

    return wanted.select("folder", "name", "record").mapInArrow(run, "doc_id long, ids array<int>")


def encode_and_read(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents as records and read the files back: doc_id, start, n_tokens, ids_crc32."""
    return read_digests(write(docs, path, end_id=end_id, id_col=id_col, text_col=text_col))
