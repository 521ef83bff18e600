"""What several corpus operators share: word and size columns, and gapless numbering without a single task."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import materialise

#: A word is a run of characters that are no ASCII white space; ``bytes.split()`` cuts UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column | str) -> Column:
    """Words of a text; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def numbered(df: DataFrame, order: list[Column], out: str, name: str) -> DataFrame:
    """``df`` with a gapless number from 0 in the given order.

    Rows are dealt by ranges of the order and written with their range, ranges are numbered one by one and
    shifted by the rows of the ranges before, so no task holds more than one range. The rows should be
    distinct in the order; equal rows are numbered in any order.
    """
    dealt = df.repartitionByRange(partitions(df), *order).withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt, name)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: at most as many as shuffle partitions
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return (
        dealt.join(offsets, "_range")
        .withColumn(out, (place + F.col("_before")).cast("long"))
        .drop("_range", "_before")
    )


#: Bytes of one Arrow batch between Spark and a Python worker; with long texts ten thousand rows would be far more.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark) -> None:
    """Bound the batches that Python workers get (unless the session sets a lower bound), and send them this package,
    unless they find it where the driver does."""
    own = spark.conf.get(BATCH_CONF).removesuffix("b")
    if not own.isdigit() or int(own) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    root = Path(__file__).resolve().parent.parent.parent
    seen = [Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    sc = spark.sparkContext
    if root in seen or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    # a local master reads the file again when a task starts, so it stays as long as this process does
    folder = tempfile.mkdtemp(prefix="wayfare-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "wayfare.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted((root / "wayfare").rglob("*.py")):
            z.write(file, file.relative_to(root))
    sc.addPyFile(str(path))


_shipped: set[str] = set()
