"""Set similarity join over word shingles by chosen paths.

Each distinct shingle set draws ``COORDINATES`` minima; agreeing in one is as likely as the sets are similar.
A run starts with all sets in one bucket and splits buckets on sampled coordinates: on average 1 / threshold
children per bucket, whose keys are the path so far with the shared minimum. Buckets of one set end; buckets of
at most ``BUCKET`` sets are compared as they are; larger ones are split again, unless a split left most of the
sets together (near copies, which no further split parts) or ``DEPTH`` is reached: these are cut into blocks and
compared block by block. The first splits of the runs are fixed by their numbers and all runs read the same minima; the
number of runs follows from what these splits draw and the target recall for a pair at the threshold and the
deepest path (``runs_needed``).

A comparison first uses the minima, then the exact sets. A pair that meets in several buckets counts in the
first of them only, which both sides can tell from their lists of buckets, so no list of pairs is ever made or
sorted: buckets give link counts per set and one edge per set to the least set of its part of the bucket.
The edges are joined into classes. Rows with equal sets are one set with a count from the start.

Scale: no task gets more than one block pair or bucket; hot buckets are joined on keys that adaptive execution
splits; what a large group of near copies costs grows with the pairs within it, as counting its links must.

Defined cases: a text without words (or null) has no shingles, links to nothing and is a class of its own; a
text of fewer words than the width has one shingle; rows with equal sets are linked to each other; a null
identifier is kept as such and never names a class unless alone, and its row has its links; rows of one identifier and
different texts are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm import shingles as S
from wayfare.llm.common import free_name, partitions
from wayfare.session import materialise

THRESHOLD = Fraction(4, 5)
RECALL = 0.995
COORDINATES = 64
DEPTH = 3
BUCKET = 200
#: A child that keeps this share of its parent's sets is not split again.
STAYS = 0.6
#: Standard deviations of agreeing minima below the threshold's mean at which a pair is still compared exactly.
SLACK = 4.0
#: Identifiers that may be sent to every executor (8 MB); more are joined by shuffle.
SEND = 1_000_000


def found_by(similarity: float, threshold: float, depth: int) -> float:
    """The chance that a run brings a pair to a common bucket at this depth: each bucket has one or two children,
    1 / threshold on average, and the pair stays together in a child with chance ``similarity``."""
    mean = 1 / threshold
    low, more = int(mean), mean - int(mean)
    lost = 0.0
    for _ in range(depth):
        apart = 1 - similarity + similarity * lost
        lost = (1 - more) * apart**low + more * apart ** (low + 1)
    return 1 - lost


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs that find a pair at the threshold with this chance, even if every bucket on its way is split to the end,
    if runs were independent and had 1 / threshold children on average at each level; in fact it takes more."""
    missed = 1 - found_by(threshold, threshold, depth)
    return math.ceil(math.log(1 - recall) / math.log(missed))


def drawn(path: int, threshold: float, count: int) -> list[int]:
    """The coordinates of a bucket's children, as ``children`` draws them in Spark."""
    mean = 1 / threshold
    low = int(mean)

    def draw(x: bytes, below: int) -> int:
        h = xxhash.xxh64_intdigest(x, xxhash.xxh64_intdigest(path.to_bytes(8, "little", signed=True), 42))
        return (h - (h >> 63 << 64)) % below

    more = draw(b"more", 1 << 20) / (1 << 20) < mean - low
    return [draw(k.to_bytes(4, "little"), count) for k in range(low + more)]


def agreeing(similarity: float, count: int) -> list[float]:
    """The chance that a pair agrees in so many of its minima, from 0 to ``count``."""
    return [math.comb(count, a) * similarity**a * (1 - similarity) ** (count - a) for a in range(count + 1)]


def least_agreeing(recall: float, threshold: float, count: int) -> int:
    """Agreeing minima from which a pair is compared exactly: ``SLACK`` deviations below the mean, or fewer where that
    would lose over a tenth of the pairs that may be missed."""
    least = max(1, math.floor(count * threshold - SLACK * math.sqrt(count * threshold * (1 - threshold))))
    chances = agreeing(threshold, count)
    while least > 1 and sum(chances[:least]) > (1 - recall) / 10:
        least -= 1
    return least


def found_in(runs: int, similarity: float, threshold: float, depth: int, count: int, least: int) -> float:
    """The chance that some of the runs brings a pair to a common bucket at this depth and it is compared.

    All runs read the same minima, so the chance is taken for each number of agreeing ones. The first splits are
    those the roots draw; deeper ones depend on the minima's values and are as good as random.
    """
    roots = [j for r in range(runs) for j in drawn(r, threshold, count)]
    times = [roots.count(j) for j in set(roots)]
    total = 0.0
    for a, chance in enumerate(agreeing(similarity, count)):
        if a >= least:
            lost = 1 - found_by(a / count, threshold, depth - 1)
            total += chance * (1 - math.prod(1 - a / count + a / count * lost**t for t in times))
    return total


def runs_needed(recall: float, threshold: float, depth: int, count: int) -> int:
    """Runs whose own splits find a pair at the threshold with this chance."""
    least, runs = least_agreeing(recall, threshold, count), runs_for(recall, threshold, depth)
    while found_in(runs, threshold, threshold, depth, count, least) < recall:
        runs += 1
        if runs > 10 * count:
            raise ValueError(f"{count} minima are too few to find {recall} of the pairs at {threshold}")
    return runs


# ---- sets ------------------------------------------------------------------------------------------------------


def set_key(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    if not len(s):
        return b"\0" * 16
    return np.array([S.mixed(s).sum(), S.mixed(s ^ S.U(0x5851F42D4C957F2D)).sum()], S.U).tobytes()


def signed(width: int, count: int):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("set_id", pa.binary()), ("n", pa.int64()), ("minima", pa.list_(pa.int32()))])

    def run(parts):
        for part in parts:
            at = 0
            for texts in S.blocks(part.column(1)):
                sets = S.shingles(texts, width)
                full = [s for s in sets if len(s)]
                minima = iter(S.minhashes(full, count).view(np.int32))
                lists = [next(minima).tolist() if len(s) else None for s in sets]
                digests = pa.array([hashlib.md5(t).hexdigest() for t in texts], pa.string())
                keys = pa.array([set_key(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(at, len(texts)), digests, keys, pa.array([len(s) for s in sets], pa.int64()), pa.array(lists, pa.list_(pa.int32()))], schema=schema
                )
                at += len(texts)

    return run


def children(path: Column, minima: Column, threshold: float, count: int) -> Column:
    """Keys of a row's buckets one level down: the coordinates depend on the path alone."""
    mean = 1 / threshold
    low = int(mean)
    keys = []
    for k in range(low + 1):
        j = F.pmod(F.xxhash64(path, F.lit(k)), F.lit(count)).cast("int")
        key = F.xxhash64(path, F.lit(k), j, F.element_at(minima, j + 1))
        if k == low:
            share = F.pmod(F.xxhash64(path, F.lit("more")), F.lit(1 << 20)) / float(1 << 20)
            key = F.when(share < mean - low, key)
        keys.append(key)
    return F.filter(F.array(*keys), lambda x: x.isNotNull())


def leaves(sets: DataFrame, threshold: float, runs: int, depth: int, bucket: int, count: int) -> DataFrame:
    """(path, set_id, blocks): the buckets to compare. Buckets of the same sets are listed once."""
    roots = F.array(*[F.lit(k).cast("long") for k in range(runs)])
    rows = sets.where("n > 0").select("set_id", "minima", F.explode(roots).alias("path"), F.lit(None).cast("long").alias("above"))
    out = None
    for level in range(1, depth + 1):
        rows = rows.select("set_id", "above", F.explode(children(F.col("path"), F.col("minima"), threshold, count)).alias("path"))
        rows = materialise(rows, f"paths-{level}")
        sizes = rows.groupBy("path").agg(
            F.count(F.lit(1)).alias("size"), F.min("above").alias("above"), F.min("set_id").alias("first"), F.max("set_id").alias("last"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("sum")
        ).where("size > 1")
        ends = (F.col("size") <= bucket) | (F.lit(level == depth)) | F.coalesce(F.col("size") >= F.col("above") * STAYS, F.lit(False))
        sizes = materialise(sizes.withColumn("ends", ends), f"buckets-{level}")
        done = sizes.where("ends").groupBy("size", "first", "last", "sum").agg(F.min("path").alias("path"))
        own = rows.join(done.select("path", "size"), "path").select("path", "set_id", F.ceil(F.col("size") / bucket).cast("int").alias("blocks"))
        own = materialise(own, f"leaves-{level}")
        out = own if out is None else out.unionByName(own)
        if level < depth:
            large = sizes.where("not ends").select("path", F.col("size").alias("above"))
            if large.isEmpty():
                break
            rows = rows.drop("above").join(large, "path").join(sets.select("set_id", "minima"), "set_id")
    return out


# ---- comparisons -----------------------------------------------------------------------------------------------


def cells(held: DataFrame, bucket: int) -> DataFrame:
    """One row per set and block pair to compare; ``part`` is the set's block, -1 where a block meets itself.

    A bucket in b blocks has b * (b + 1) / 2 block pairs, and each set goes to the b of its own block.
    """
    opened = held.select("*", F.explode("leaves").alias("leaf")).select("*", F.col("leaf.path").alias("path"), F.col("leaf.blocks").alias("blocks")).drop("leaf")
    own = F.pmod(F.xxhash64("set_id", F.lit("block")), F.col("blocks")).cast("int")
    rows = opened.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        *[c for c in held.columns if c != "leaves"],
        F.transform("leaves", lambda x: x["path"]).alias("paths"),
        "path",
        F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("part"),
    )


class Cell:
    """The sets of one block pair, and which of their pairs are its to count."""

    def __init__(self, path: int, part: np.ndarray, paths: list[list[int]]):
        m = len(part)
        mine = np.triu(np.ones((m, m), bool), 1)
        if m and part[0] >= 0:  # two blocks, one of which may have no set here: across only
            mine &= part[:, None] != part[None, :]
        earlier: dict[int, list[int]] = {}
        for i, own in enumerate(paths):
            for p in own:
                if p < path:
                    earlier.setdefault(p, []).append(i)
        for members in earlier.values():  # these pairs have met before
            if len(members) > 1:
                mine[np.ix_(members, members)] = False
        self.mine = mine


def groups(parts):
    """Runs of rows with the same ``cell`` from a sorted stream, as dicts of columns."""
    held = None
    for part in parts:
        t = pa.Table.from_batches([part])
        if held is not None:
            t = pa.concat_tables([held, t])
        cell = t.column("cell").to_numpy()
        edge = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        at = [0, *edge.tolist()]
        for a, b in zip(at, at[1:], strict=False):
            yield t.slice(a, b - a)
        held = t.slice(at[-1])
    if held is not None and held.num_rows:
        yield held


def flat(column: pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks()
    return (c.flatten() if isinstance(c, (pa.ListArray, pa.LargeListArray)) else c).to_numpy(zero_copy_only=False)


def sizes_near(n: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Pairs whose sizes alone do not rule the threshold out."""
    low, high = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    return low * threshold.denominator >= high * threshold.numerator


def plausible(threshold: Fraction, count: int, least: int):
    """Keep the rows of a cell that have a pair to count with at least ``least`` agreeing minima."""
    names = ["set_id", "n", "copies", "paths", "path", "cell", "part"]

    def run(parts):
        for t in groups(parts):
            m = t.num_rows
            if m < 2:
                continue
            n = t.column("n").to_numpy()
            minima = flat(t.column("minima")).reshape(m, count)
            near = sizes_near(n, threshold)
            agree = np.zeros((m, m), np.int16)
            for i in range(m):
                js = np.flatnonzero(near[i, i + 1 :]) + i + 1
                if len(js):
                    agree[i, js] = (minima[js] == minima[i]).sum(1)
            hit = agree >= least
            if not hit.any():
                continue
            hit &= Cell(t.column("path")[0].as_py(), t.column("part").to_numpy(), t.column("paths").to_pylist()).mine
            stay = np.flatnonzero(hit.any(0) | hit.any(1))
            if len(stay):
                yield from t.select(names).take(pa.array(stay)).combine_chunks().to_batches()

    return run


def shingle_rows(width: int):
    schema = pa.schema([("set_id", pa.binary()), ("shingles", pa.binary())])

    def run(parts):
        for part in parts:
            for texts in S.blocks(part.column(0)):
                sets = S.shingles(texts, width)
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return run


def shared(sets: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """How many elements each pair of sets shares: products of 0/1 columns of the elements that occur twice."""
    m = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, place, times = np.unique(every, return_inverse=True, return_counts=True)
    twice = times > 1
    number = np.cumsum(twice) - 1
    some = twice[place]
    owner, place = owner[some], number[place[some]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((m, m), np.float32)
    for at in range(0, int(twice.sum()), step):
        a, b = np.searchsorted(place, [at, at + step])
        block = np.zeros((m, min(step, int(twice.sum()) - at)), np.float32)
        block[owner[a:b], place[a:b] - at] = 1
        out += block @ block.T
    return out.astype(np.int64)  # exact below 2**24 elements


def roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    up = np.arange(m)
    while len(a):
        low = np.minimum(up[a], up[b])
        before = up.copy()
        np.minimum.at(up, a, low)
        np.minimum.at(up, b, low)
        up = up[up]
        if (up == before).all():
            break
    return up


def verified(threshold: Fraction):
    """Per set of a cell: links (counted in documents) and the least set of its component within the cell."""
    schema = pa.schema([("set_id", pa.binary()), ("links", pa.int64()), ("least", pa.binary())])
    num, den = threshold.numerator, threshold.denominator

    def run(parts):
        for t in groups(parts):
            m = t.num_rows
            if m < 2:
                continue
            mine = Cell(t.column("path")[0].as_py(), t.column("part").to_numpy(), t.column("paths").to_pylist()).mine
            sets = [np.frombuffer(x.as_py(), S.U) for x in t.column("shingles")]
            n, copies = t.column("n").to_numpy(), t.column("copies").to_numpy()
            both = shared(sets)
            # both / (n + n' - both) >= num / den
            hit = mine & (both * (num + den) >= (n[:, None] + n[None, :]) * num)
            a, b = np.nonzero(hit)
            if not len(a):
                continue
            links = np.zeros(m, np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            ids = t.column("set_id").to_pylist()
            order = sorted(range(m), key=ids.__getitem__)
            rank = np.empty(m, np.int64)
            rank[order] = np.arange(m)
            up = roots(m, rank[a], rank[b])
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in some], pa.binary()), pa.array(links[some]), pa.array([ids[order[up[rank[i]]]] for i in some], pa.binary())], schema=schema
            )

    return run


# ---- classes ---------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, by least neighbours and shortcuts.

    ``edges``: columns a and b. Each round is one aggregate and two joins on narrow rows, written in the shared
    folder; rounds end when no root changes. One number per round reaches the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "roots")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = label.join(near, label["node"] == near["a"], "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root"))
        lower = materialise(lower, "roots")
        top = lower.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = lower.join(top, "root", "left").select("node", "was", F.coalesce(F.least("root", "top"), "root").alias("root"))
        label = materialise(jumped, "roots")
        if label.where("root != was").isEmpty():
            return label.select("node", "root")


def small(df: DataFrame, most: int = SEND) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, counted first; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def grouped(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = S.WIDTH, threshold: Fraction = THRESHOLD, recall: float = RECALL,
    depth: int = DEPTH, bucket: int = BUCKET, count: int = COORDINATES,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest of the text, set_id, n of every row; set_id, root, copies, class_id, class_size, links of every set)."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialise(text.mapInArrow(signed(width, count), "doc_id long, digest string, set_id binary, n long, minima array<int>"), "signed")
    sets = rows.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("minima").alias("minima"))
    sets = materialise(sets, "sets")
    s = float(threshold)
    met = leaves(sets, s, runs_needed(recall, s, depth, count), depth, bucket, count)
    lists = met.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("path", "blocks"))).alias("leaves"))
    held = materialise(lists.join(sets.select("set_id", "n", "copies", "minima"), "set_id"), "held")
    p = partitions(docs)
    dealt = cells(held, bucket).repartition(p, "cell").sortWithinPartitions("cell")
    kinds = "set_id binary, n long, copies long, paths array<long>, path long, cell long, part int"
    pairs = materialise(dealt.mapInArrow(plausible(threshold, count, least_agreeing(recall, s, count)), kinds), "plausible")
    asked = pairs.groupBy("set_id").agg(
        *[F.first(c).alias(c) for c in ("n", "copies", "paths")], F.collect_list(F.struct("path", "cell", "part")).alias("at")
    )
    asked = materialise(asked, "asked")
    wanted = materialise(sets.join(asked.select("set_id"), "set_id").select("doc_id").distinct(), "wanted")
    wanted = small(wanted.select(F.col("doc_id").alias("one")))
    found = text.join(wanted, F.col("doc_id").eqNullSafe(F.col("one")), "left_semi").select("text").mapInArrow(shingle_rows(width), "set_id binary, shingles binary")
    full = found.join(asked, "set_id").dropDuplicates(["set_id"])  # an identifier may be that of several rows
    opened = full.select("set_id", "shingles", "n", "copies", "paths", F.explode("at").alias("x")).select("*", "x.*").drop("x")
    exact = opened.repartition(p, "cell").sortWithinPartitions("cell")
    linked = materialise(exact.mapInArrow(verified(threshold), "set_id binary, links long, least binary"), "linked")
    root = components(linked.select(F.col("set_id").alias("a"), F.col("least").alias("b")))
    links = linked.groupBy("set_id").agg(F.sum("links").alias("links"))
    named = sets.select("set_id", "doc_id", "copies", "n").join(root.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = materialise(named, "named")
    classes = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    known = materialise(named.join(classes, "root").join(links, "set_id", "left").select("set_id", "root", "copies", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links")), "classes")
    return rows.select("doc_id", "digest", "set_id", "n"), known


def join(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), n_links (other documents it is
    linked to), n_shingles and class_size. Options as of ``grouped``."""
    rows, known = grouped(docs, **options)
    bare = F.col("n") == 0
    return rows.select("doc_id", "set_id", "n").join(known, "set_id").select(
        "doc_id",
        F.when(bare, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(bare, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.col("n").alias("n_shingles"),
        F.when(bare, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
    )


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, with the columns of ``docs``: the one with the least identifier (nulls last), among these the
    one with the least MD5 of the text, among rows equal in both the one whose columns have the least hash. Rows without
    words all stay."""
    rows, known = grouped(docs, id_col=id_col, text_col=text_col, **options)
    told = rows.where("n > 0").join(known.select("set_id", "root"), "set_id")
    told = told.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("times"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    first = told.groupBy("root").agg(F.min(place).alias("first"))
    named = materialise(told.join(first, "root").withColumn("stays", place == F.col("first")).select("doc_id", "digest", "times", "stays"), "near-rows")

    own, other, text_of = (free_name(docs, c) for c in ("_own", "_other", "_digest"))
    marked = docs.withColumn(own, docs[id_col].cast("long")).withColumn(text_of, F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary")))
    listed = named.select(F.col("doc_id").alias(other), F.col("digest").alias(other + "d"), "times", "stays")
    same = F.col(own).eqNullSafe(F.col(other)) & (F.col(text_of) == F.col(other + "d"))
    gone = listed.where("NOT stays OR times > 1").drop("times", "stays")
    left = marked.join(small(gone), same, "left_anti")
    repeated = listed.where("stays AND times > 1").drop("times", "stays")
    if not repeated.isEmpty():
        again = marked.join(small(repeated), same, "left_semi")
        one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(other)
        left = left.unionByName(again.groupBy(own, text_of).agg(one).select(own, text_of, f"{other}.*"))
    return left.select(*docs.columns)
