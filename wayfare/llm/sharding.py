"""Sharding by fixed virtual slots with a versioned slot-to-shard map.

Records are hashed into a fixed number of slots; only the map from slots to shards changes. A first map fills
the shards with the slots in order of falling size; ``rebalanced`` edits a map by moving slots to new or light
shards and leaves the others where they are. Versions of a map are written once and never changed; ``current_map``
takes the latest one and writes an edited version only if shards came, went or ran out of balance.

Defined cases: a null text counts no bytes and has checksum 0; a null id is hashed as such with the text, so
that null or repeated ids spread; rows that agree in id, size and checksum are told apart by their number among
themselves, so that they spread as well; an empty table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.session import materialise, stage_folder

SHARDS = 24
#: Fixed for the life of a data set: what is collected on the driver is one row per slot at most.
SLOTS = 8192
ROW_BYTES = 8


#: Equal rows that are numbered by one task at a time.
COPIES = 10_000
#: A map is edited where its heaviest shard holds more than this times the mean.
MOST_OVER = 1.05


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every row; texts are read once.

    Equal rows are counted, and the count is opened in blocks that are dealt anew, so no task holds all copies of a row.
    """
    crc = F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).cast("long")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + ROW_BYTES
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    key = ["doc_id", "size", "text_crc32"]
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    blocks = counted.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES).cast("long"))))
    blocks = blocks.repartition(*key, "_b")
    first, last = F.col("_b") * COPIES, F.least(F.col("_n"), (F.col("_b") + 1) * COPIES) - 1
    one = blocks.select(*key, F.explode(F.sequence(first, last)).alias("_copy"))
    said = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), "text_crc32", "size", "_copy")
    number = F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("long")
    return one.select(*key, F.pmod(number, F.lit(slots)).cast("int").alias("vslot"))


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy("vslot").agg(F.sum("size")).collect()}


def first_map(sizes: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard of each slot: the largest slot left goes to the lightest shard; empty slots are dealt in turn."""
    load = [(0, s) for s in range(shards)]
    out = [s % shards for s in range(slots)]
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        used, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (used + sizes[slot], shard))
    return out


def rebalanced(shard_of: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """An edited map: slots leave shards above the mean, for the lightest shards, while that evens the loads."""
    out, load = list(shard_of), [0] * shards
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in enumerate(out):
        load[shard] += sizes.get(slot, 0)
        held[shard].append(slot)
    mean = sum(load) / shards
    for giver in sorted(range(shards), key=lambda s: (-load[s], s)):
        for slot in sorted(held[giver], key=lambda s: (-sizes.get(s, 0), s)):
            size = sizes.get(slot, 0)
            taker = min(range(shards), key=lambda s: (load[s], s))
            if size and taker != giver and load[giver] - size >= mean * 0.999 and load[taker] + size <= mean:
                out[slot] = taker
                load[giver] -= size
                load[taker] += size
    return out


def store_map(spark: SparkSession, shard_of: list[int], version: int, folder: str) -> DataFrame:
    """Write a version of the map beside the earlier ones, and read it back. A version that is there stays as it is."""
    path = f"{folder}/version={version}"
    spark.createDataFrame(list(enumerate(shard_of)), "vslot int, shard int").coalesce(1).write.mode("errorifexists").parquet(path)
    return spark.read.schema("vslot int, shard int").parquet(path)


def latest_map(spark: SparkSession, folder: str) -> tuple[int, list[int]]:
    """The last version in a folder and its map; version 0 and an empty map where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    # a version counts once its writer has finished
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")) or []
    versions = [int(str(f.getPath().getParent().getName()).split("=")[1]) for f in done]
    if not versions:
        return 0, []
    last = max(versions)
    listed = spark.read.schema("vslot int, shard int").parquet(f"{folder}/version={last}").orderBy("vslot").collect()  # a row per slot
    return last, [r.shard for r in listed]


def current_map(rows: DataFrame, folder: str, shards: int = SHARDS, slots: int = SLOTS) -> tuple[int, DataFrame]:
    """(version, map) for ``rows``: the stored map if it fits the shards and is in balance, else an edited next version."""
    spark, sizes = rows.sparkSession, slot_bytes(rows)
    version, shard_of = latest_map(spark, folder)
    if not version:
        return 1, store_map(spark, first_map(sizes, shards, slots), 1, folder)
    if len(shard_of) != slots:
        raise ValueError(f"the map in {folder} has {len(shard_of)} slots, not {slots}: the number of slots is fixed for a data set")
    # slots of shards that went go to the lightest ones; rebalancing evens the rest
    edited = [s if s < shards else -1 for s in shard_of]
    load = [0] * shards
    for slot, s in enumerate(edited):
        if s >= 0:
            load[s] += sizes.get(slot, 0)
    for slot in sorted((i for i, s in enumerate(edited) if s < 0), key=lambda i: (-sizes.get(i, 0), i)):
        edited[slot] = min(range(shards), key=lambda s: (load[s], s))
        load[edited[slot]] += sizes.get(slot, 0)
    grown = shards > max(shard_of) + 1
    if grown or max(load) > MOST_OVER * sum(load) / shards:
        edited = rebalanced(edited, sizes, shards)
    if edited == shard_of:
        return version, spark.read.schema("vslot int, shard int").parquet(f"{folder}/version={version}")
    return version + 1, store_map(spark, edited, version + 1, folder)


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with shard and ``slot``, the row's gapless place in its shard.

    A place is the number of rows in the shard's virtual slots before plus the place in the own virtual slot, so
    rows are ranked per virtual slot, thousands of small windows, and only one row per slot is ranked per shard.
    """
    counts = rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("_n")).join(slot_map, "vslot")
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialise(counts.select("vslot", "shard", F.coalesce(before, F.lit(0)).alias("_before")), "shard-starts")
    own = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("_own", own)
        .join(F.broadcast(starts), "vslot")  # at most SLOTS rows
        .withColumn("slot", (F.col("_before") + F.col("_own")).cast("long"))
        .drop("_own", "_before")
    )


def shard(
    docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot and map_version of every row.

    ``folder`` holds the versions of the data set's map; without one a first map is made for these rows alone.
    """
    spark = docs.sparkSession
    rows = materialise(hashed(docs, id_col, text_col, slots), "shard-rows")
    version, slot_map = current_map(rows, folder or f"{stage_folder(spark)}/shard-map-{uuid.uuid4().hex}", shards, slots)
    return placed(rows, slot_map).withColumn("map_version", F.lit(version))
