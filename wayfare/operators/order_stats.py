"""Exact order statistics per group without collecting a group.

Equal values are counted before the shuffle. Groups of many distinct values are cut into value buckets whose
limits come from a mergeable quantile sketch of those values, so that buckets hold about equally many however the
values lie; ranks are then exact inside the buckets that hold a wanted one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
#: Groups of at most this many distinct values are one bucket.
WHOLE = 4096
#: Rank error of the sketch that chooses the limits; the limits need not be exact, the answer is.
ACCURACY = 2000


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: Column, ranks: dict[str, Column]
) -> DataFrame:
    """One row per group: ``n`` and, for each name, the value at a 0-based rank of the sorted values.

    A rank is an expression over ``n``. Nulls are left out.
    """
    keys = list(keys)
    counts = (
        df.select(*keys, value.alias("__v"))
        .filter(F.col("__v").isNotNull())
        .groupBy(*keys, "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("n"), F.count(F.lit(1)).alias("__d"))
    large = totals.filter(F.col("__d") > WHOLE).select(*keys)
    steps = [k / BUCKETS for k in range(1, BUCKETS)]
    limits = counts.join(large, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("__v", steps, ACCURACY).alias("__limits"))
    info = totals.drop("__d").join(limits, keys, "left")
    bucket = F.coalesce(F.size(F.filter("__limits", lambda x: x < F.col("__v"))), F.lit(0))
    bucket = F.when(F.col("__limits").isNull(), 0).otherwise(bucket)
    binned = counts.join(info, keys).withColumn("__b", bucket).drop("__limits")
    sizes = binned.groupBy(*keys, "__b").agg(F.sum("__c").alias("__s"), F.first("n").alias("n"))
    before = F.coalesce(
        F.sum("__s").over(
            Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    sizes = sizes.withColumn("__from", before)
    wanted = [
        (rank >= F.col("__from")) & (rank < F.col("__from") + F.col("__s")) for rank in ranks.values()
    ]
    any_wanted = wanted[0]
    for w in wanted[1:]:
        any_wanted = any_wanted | w
    hot = sizes.filter(any_wanted).select(*keys, "__b", "__from")
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.join(hot, [*keys, "__b"]).withColumn(
        "__upto", F.col("__from") + F.sum("__c").over(inside)
    )
    picks = [
        F.min(F.when((rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__c")), F.col("__v"))).alias(name)
        for name, rank in ranks.items()
    ]
    return ranked.groupBy(*keys).agg(F.first("n").alias("n"), *picks)


def midpoint_median(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Median; the mean of the two middle values when their number is even."""
    n = F.col("n")
    stats = order_statistics(
        df, keys, value, {"__a": F.floor((n - 1) / 2), "__z": F.floor(n / 2)}
    )
    same = F.col("__a") == F.col("__z")
    return stats.select(
        *keys, F.when(same, F.col("__a")).otherwise((F.col("__a") + F.col("__z")) / 2).alias(name)
    )


def lower_median(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Median; the smaller of the two middle values when their number is even."""
    return order_statistics(df, keys, value, {name: F.floor((F.col("n") - 1) / 2)}).select(*keys, name)


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: Column, fractions: dict[str, float]
) -> DataFrame:
    """Nearest-rank percentiles: the value at round(f · (n − 1)), halves upwards."""
    ranks = {
        name: F.floor(F.lit(f) * (F.col("n") - 1) + 0.5) for name, f in fractions.items()
    }
    return order_statistics(df, keys, value, ranks)
