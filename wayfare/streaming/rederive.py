"""Incremental derivation as a stream: each micro-batch of changed videos is derived again.

A batch writes below its own epoch folder and replaces that folder when it is retried, so a restarted
query leaves one result per epoch. The keys of an epoch are a table of their own, written last: readers take the
latest epoch of each video from it, so a video whose new result has no rows shows none, and half a written epoch
is not seen. An output folder belongs to one checkpoint; with a new checkpoint (epochs start at 0 again) use a
new folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfare.operators.timeline import KEY
from wayfare.plans.derive import Inputs, derive
from wayfare.session import materialise_plain


#: The table of the videos each epoch derived.
KEYS = "keys"


def only(inputs: Inputs, keys: DataFrame) -> Inputs:
    """The inputs of the named videos."""
    keep = lambda d: d.join(keys, KEY, "left_semi")
    return replace(inputs, frames=keep(inputs.frames), videos=keep(inputs.videos), corrections=keep(inputs.corrections))


def rederive_batch(load: Callable[[SparkSession], Inputs], p: dict[str, Any], out: str) -> Callable[[DataFrame, int], None]:
    """The writer of one micro-batch of changed video keys."""

    def write(batch: DataFrame, epoch: int) -> None:
        keys = materialise_plain(batch.select(*KEY).distinct(), "changed")
        if keys.isEmpty():
            return
        d = derive(only(load(batch.sparkSession), keys), p)
        for name, df in (("metrics", d.metrics), ("quality", d.quality), ("events", d.events), ("flags", d.flags), ("removed", d.removed)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")
        keys.write.mode("overwrite").parquet(f"{out}/{KEYS}/epoch={epoch}")

    return write


def rederive_stream(changes: DataFrame, load: Callable[[SparkSession], Inputs], p: dict[str, Any], out: str, checkpoint: str) -> StreamingQuery:
    """Start the query over a stream of changed keys, working off what is there."""
    return (
        changes.writeStream.foreachBatch(rederive_batch(load, p, out))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The current derived rows: those of each video's latest epoch that was written to the end."""
    last = spark.read.parquet(f"{out}/{KEYS}").groupBy(*KEY).agg(F.max("epoch").alias("epoch"))
    return spark.read.parquet(f"{out}/{name}").join(last, [*KEY, "epoch"], "left_semi").drop("epoch")
