"""Exact duplicates by compressed radix tries over full byte strings.

Every input partition inserts its texts into tries and hands on one row per distinct text (bytes, owner,
copies); those rows are dealt by length and content hash, and each partition inserts them once more. Terminal
nodes store the owner: the smallest or the largest identifier of the copies. A key is length, content hash and
the bytes themselves, so texts with equal hashes stay apart.

Memory: a trie that holds more than ``budget`` bytes spills whole subtrees, that is, it hands the owners below
them on and prunes them. Before the exchange any subtree can go, since a later copy merely makes one more row;
after it the rows come sorted by length and hash, so subtrees left of the current key are complete. Nothing is
written outside Spark's own exchange, and a lost task is simply run again.

Defined cases: a null text counts as empty; null identifiers never own a group that has another identifier
(a group of null identifiers only has owner null); repeated rows count as copies, each kept if its identifier is
the owner; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import free_name, partitions

BUDGET = 32 << 20
PARTIAL = "length long, content_hash long, content binary, owner long, copies long"
OWNERS = "text_sha256 string, keep_id long, group_size long"


class Node:
    __slots__ = ("copies", "edge", "kids", "owner")

    def __init__(self, edge: bytes):
        self.edge, self.kids, self.owner, self.copies = edge, {}, None, 0


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving with whole comparisons."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


class Trie:
    """A Patricia trie from byte strings to (owner, copies)."""

    def __init__(self, larger: bool):
        self.root, self.larger, self.held = Node(b""), larger, 0

    def better(self, a: int | None, b: int | None) -> int | None:
        if a is None or b is None:
            return b if a is None else a
        return max(a, b) if self.larger else min(a, b)

    def insert(self, key: bytes, owner: int | None, copies: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.held += len(kid.edge) + 200
                node, at = kid, len(key)
                break
            edge = kid.edge
            if key.startswith(edge, at):
                node, at = kid, at + len(edge)
                continue
            cut = common_prefix(edge, key[at : at + len(edge)])
            fork = Node(edge[:cut])
            kid.edge = edge[cut:]
            fork.kids[kid.edge[0]] = kid
            node.kids[key[at]] = fork
            self.held += 200
            node, at = fork, at + cut
        node.owner = self.better(node.owner, owner) if node.copies else owner
        node.copies += copies

    @staticmethod
    def terminals(node: Node, above: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node, above)]
        while stack:
            node, above = stack.pop()
            key = above + node.edge
            if node.copies:
                yield key, node.owner, node.copies
            stack.extend((kid, key) for kid in node.kids.values())

    def spill(self, keep: int = -1) -> Iterator[tuple[bytes, int | None, int]]:
        """Hand on and prune the root's subtrees, but the one that begins with ``keep``."""
        for first in [k for k in self.root.kids if k != keep]:
            node = self.root.kids.pop(first)
            yield from self.terminals(node, b"")
        self.held = sum(self.weight(n) for n in self.root.kids.values())

    @staticmethod
    def weight(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.edge) + 200
            stack.extend(node.kids.values())
        return total


HEAD = 16


def key_of(content: bytes, content_hash: int) -> bytes:
    return (content_hash % (1 << 64)).to_bytes(8, "big") + len(content).to_bytes(8, "big") + content


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most about ``size`` bytes of content."""
    held, used = [], 0
    for row in rows:
        held.append(row)
        used += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if used >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, used = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def local_owners(larger: bool, budget: int):
    """Tries over the rows of one input partition."""
    out = pa.schema([("length", pa.int64()), ("content_hash", pa.int64()), ("content", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())])

    def rows(parts):
        trie = Trie(larger)
        for part in parts:
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                trie.insert(key_of(text, xxhash.xxh64_intdigest(text)), doc, 1)
                if trie.held > budget:
                    yield from trie.spill()
        yield from trie.spill()

    def run(parts):
        flat = ((len(k) - HEAD, int.from_bytes(k[:8], "big", signed=True), k[HEAD:], owner, copies) for k, owner, copies in rows(parts))
        yield from batches(flat, out, 4 << 20)

    return run


def merged_owners(larger: bool, budget: int):
    """Tries over rows that come sorted by content hash and length."""
    out = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def rows(parts):
        trie, now = Trie(larger), None
        for part in parts:
            hashes, contents, owners, copies = (part.column(k).to_pylist() for k in range(1, 5))
            for h, content, owner, n in zip(hashes, contents, owners, copies, strict=True):
                if trie.held > budget and h != now:  # everything held is complete
                    yield from trie.spill()
                now = h
                trie.insert(key_of(content, h), owner, n)
        yield from trie.spill()

    def run(parts):
        flat = ((hashlib.sha256(k[HEAD:]).hexdigest(), owner, copies) for k, owner, copies in rows(parts))
        yield from batches(flat, out, 1 << 20)

    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = BUDGET) -> DataFrame:
    """One row per distinct text: its digest, the identifier that stays and the number of copies."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    narrow = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    partial = narrow.mapInArrow(local_owners(keep == "largest", budget), PARTIAL)
    dealt = partial.repartition(partitions(docs), "length", "content_hash").sortWithinPartitions("content_hash", "length")
    return dealt.mapInArrow(merged_owners(keep == "largest", budget), OWNERS)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = BUDGET) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
    own = owners(docs, id_col, text_col, keep, budget)
    return named.join(own, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = BUDGET) -> DataFrame:
    """The documents that stay, with the columns of ``docs``; equal rows that all carry the owner's identifier all stay."""
    mine = free_name(docs, "_own")
    own = owners(docs, id_col, text_col, keep, budget).select(F.struct("*").alias(mine))
    digest = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    joined = docs.join(own, digest == own[f"{mine}.text_sha256"])
    return joined.where(docs[id_col].cast("long").eqNullSafe(F.col(f"{mine}.keep_id"))).drop(mine)
