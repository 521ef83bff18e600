"""Session helpers: a local session for tests, and the shared folder for materialised stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CHUNK_FRAMES = 49_152
CHUNK_CONF = "spark.wayfare.chunkFrames"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wayfare")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def chunk_frames(spark: SparkSession) -> int:
    """Frames per chunk: the unit in which a long track is cut so that no task holds all of it."""
    return int(spark.conf.get(CHUNK_CONF, str(DEFAULT_CHUNK_FRAMES)))


_scratch: dict[str, str] = {}


def stage_folder(spark: SparkSession) -> str:
    """The folder for materialised stages: the cluster's checkpoint folder, or a temporary one in local tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="wayfare-")
    return _scratch[app]


METHOD_CONF = "spark.sql.codegen.hugeMethodLimit"
#: Bytes above which the JVM does not compile a method.
COMPILED = "8000"


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Runs started within leave out generated code in one method so long that the JVM would only interpret it."""
    before = spark.conf.get(METHOD_CONF, None)
    spark.conf.set(METHOD_CONF, COMPILED)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(METHOD_CONF)
        else:
            spark.conf.set(METHOD_CONF, before)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a stage as a table in the shared folder and read it back.

    Cuts lineage so that a lost executor re-reads the stage rather than recomputing it, and gives
    later readers column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with small_methods(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


NO_DICTIONARY = {"parquet.enable.dictionary": "false"}
#: Options of files about as large as the rows in them.
PLAIN = {"compression": "none", **NO_DICTIONARY}


def materialise_plain(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` for rows per video, correction or event, which joins may broadcast.

    The planner takes the size of the files for that of the rows. Rows with equal values are packed a hundred times
    smaller, and would then be collected by the driver and broadcast however many they are.
    """
    return materialise(df, name, **PLAIN)


#: Rows of a clustered stage that make another bucket worth while.
BUCKET_ROWS = 250_000


def buckets_for(rows: int) -> int:
    """Buckets for a clustered stage of about ``rows`` rows: a bucket does not grow with the input."""
    return max(1, -(-rows // BUCKET_ROWS))


PARTITIONS_CONF = "spark.sql.shuffle.partitions"


@contextmanager
def dealt_into(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Runs started within deal rows into this many partitions, so that rows already dealt so are not dealt again."""
    before = spark.conf.get(PARTITIONS_CONF)
    spark.conf.set(PARTITIONS_CONF, str(partitions))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS_CONF, before)


def materialise_clustered(df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], buckets: int) -> DataFrame:
    """Write a stage as a bucketed, sorted table in the shared folder and read it back.

    Windows, aggregates and joins on ``keys`` and more columns (joins within ``co_partitioned``) then read the buckets as
    they are, without an exchange. Rows should come dealt by ``keys`` into as many partitions, so that each task writes
    one bucket; other exchanges of the stage are then of that many partitions too, or the rows would move once more.
    """
    spark = df.sparkSession
    table = f"wayfare_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{stage_folder(spark)}/{table}"
    with small_methods(spark), dealt_into(spark, buckets):
        df.write.option("path", path).bucketBy(buckets, *keys).sortBy(*order).saveAsTable(table, format="parquet")
    return spark.table(table)


CO_PARTITION_CONF = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Joins planned within may use a partitioning by some of their keys, as that of a clustered stage by (track, chunk)."""
    before = spark.conf.get(CO_PARTITION_CONF)
    spark.conf.set(CO_PARTITION_CONF, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITION_CONF, before)
