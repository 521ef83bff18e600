"""Which part of an event rests on a correction: matching the corrected detection against the automatic one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators.timeline import KEY, overlaps

MEASURED = [
    "kind", "hole_index", "is_target", "start_frame", "end_frame", "start_t", "end_t", "duration_s",
    "point_used", "min_nose_cm", "min_centroid_cm", "evidence",
]


def _greedy(pairs: Column) -> Column:
    """One-to-one pairs, taken in the order of the array: each id is used once."""
    ids = F.array().cast("array<string>")
    start = F.struct(ids.alias("c"), ids.alias("a"))

    def take(acc: Column, v: Column) -> Column:
        free = ~F.array_contains(acc["c"], v["ci"]) & ~F.array_contains(acc["a"], v["ai"])
        return F.struct(
            F.when(free, F.concat(acc["c"], F.array(v["ci"]))).otherwise(acc["c"]).alias("c"),
            F.when(free, F.concat(acc["a"], F.array(v["ai"]))).otherwise(acc["a"]).alias("a"),
        )

    return F.aggregate(pairs, start, take, lambda acc: F.arrays_zip(acc["c"], acc["a"]))


def _pairs(corrected: DataFrame, auto: DataFrame, same_kind: bool) -> DataFrame:
    """Greedy matches by largest overlap among events of one hole (and kind); bounded by one trial's events."""
    c = corrected.select(
        *KEY, F.col("event_id").alias("ci"), F.col("kind").alias("ck"), F.coalesce("hole_index", F.lit(-1)).alias("h"),
        F.col("start_frame").alias("cs"), F.col("end_frame").alias("ce"),
    )
    a = auto.select(
        *KEY, F.col("event_id").alias("ai"), F.col("kind").alias("ak"), F.coalesce("hole_index", F.lit(-1)).alias("h"),
        F.col("start_frame").alias("as"), F.col("end_frame").alias("ae"),
    )
    met = c.join(a, [*KEY, "h"])
    if same_kind:
        met = met.filter(F.col("ck") == F.col("ak"))
    overlap = F.least("ce", "ae") - F.greatest("cs", "as") + 1
    met = met.withColumn("o", overlap).filter(F.col("o") > 0)
    item = F.struct((-F.col("o")).alias("o"), "cs", "as", "ci", "ai")
    arr = met.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("pairs"))
    return arr.select(*KEY, F.explode(_greedy(F.col("pairs"))).alias("m")).select(
        *KEY, F.col("m.c").alias("event_id"), F.col("m.a").alias("auto_id")
    )


def ids_in_span(events: DataFrame, spans: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Per event, the corrections whose frames overlap [lo, hi], in application order."""
    e = events.select(*KEY, "event_id", lo.alias("lo"), hi.alias("hi"))
    hit = overlaps(e, spans, ("lo", "hi"), ("span_start", "span_end"))
    item = F.struct("timestamp", "id")
    return hit.groupBy(*KEY, "event_id").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda v: v["id"]).alias("correction_ids")
    )


def label(events: DataFrame, auto_events: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with provenance, pairs used). ``events`` are those of videos that also have ``auto_events``."""
    measured = [c for c in MEASURED if c in events.columns]
    same = _pairs(events, auto_events, True)
    left_c = events.join(same.select(*KEY, "event_id"), [*KEY, "event_id"], "left_anti")
    left_a = auto_events.join(
        same.select(*KEY, F.col("auto_id").alias("event_id")), [*KEY, "event_id"], "left_anti"
    )
    changed = _pairs(left_c, left_a, False)
    pairs = same.withColumn("changed", F.lit(False)).unionByName(changed.withColumn("changed", F.lit(True)))
    shadow = auto_events.select(
        *KEY, F.col("event_id").alias("auto_id"), F.struct(*measured).alias("auto")
    )
    df = events.join(pairs, [*KEY, "event_id"], "left").join(shadow, [*KEY, "auto_id"], "left")
    equal = F.lit(True)
    for m in measured:
        equal = equal & F.col(m).eqNullSafe(F.col("auto")[m])
    df = df.withColumn("same", F.coalesce(~F.col("changed") & equal, F.lit(False)))
    paired = F.col("auto_id").isNotNull()
    touched = ids_in_span(
        df.filter(~F.col("same")),
        spans,
        F.least(F.col("start_frame"), F.coalesce(F.col("auto.start_frame"), F.col("start_frame"))),
        F.greatest(F.col("end_frame"), F.coalesce(F.col("auto.end_frame"), F.col("end_frame"))),
    )
    df = df.join(touched, [*KEY, "event_id"], "left")
    kept = paired & ~F.col("same")
    where = F.when(F.col("auto.hole_index").isNull(), "away from any hole").otherwise(
        F.concat(F.lit("at hole "), F.col("auto.hole_index").cast("string"))
    )
    cols = [c for c in events.columns if c not in ("source", "evidence_corrected", "correction_ids", "confirmed", "auto_shadow", "evidence")]
    out = df.select(
        *cols,
        *(
            [
                F.when(
                    F.col("changed"),
                    F.concat(
                        F.col("evidence"), F.lit(" Was an automatic "), F.translate(F.col("auto.kind"), "_", " "),
                        F.lit(" "), where, F.lit(", frames "), F.col("auto.start_frame").cast("string"), F.lit("–"),
                        F.col("auto.end_frame").cast("string"), F.lit(", before the corrections changed its kind."),
                    ),
                ).otherwise(F.col("evidence")).alias("evidence")
            ]
            if "evidence" in events.columns
            else []
        ),
        F.when(paired & ~F.coalesce("changed", F.lit(False)), "auto").otherwise("corrected").alias("source"),
        (kept & ~F.coalesce("changed", F.lit(False))).alias("evidence_corrected"),
        F.coalesce("correction_ids", F.array().cast("array<string>")).alias("correction_ids"),
        F.lit(False).alias("confirmed"),
        F.when(
            kept,
            F.struct(
                F.col("auto.hole_index").alias("hole_index"), F.col("auto.start_frame").alias("start_frame"),
                F.col("auto.end_frame").alias("end_frame"),
                F.when(F.col("changed"), F.col("auto.kind")).alias("kind"),
            ),
        ).alias("auto_shadow"),
    )
    return out, pairs


def untouched(events: DataFrame) -> DataFrame:
    """Provenance of events of a video without frame corrections."""
    return events.withColumns(
        {
            "source": F.lit("auto"),
            "evidence_corrected": F.lit(False),
            "correction_ids": F.array().cast("array<string>"),
            "confirmed": F.lit(False),
            "auto_shadow": F.lit(None).cast(
                "struct<hole_index:int,start_frame:int,end_frame:int,kind:string>"
            ),
        }
    )


def removed_events(
    events: DataFrame, auto_events: DataFrame, pairs: DataFrame, spans: DataFrame, windows: DataFrame
) -> DataFrame:
    """Automatic visits and entries the corrected detection no longer finds, with the corrections around them.

    ``windows``: KEY, win_start, win_end — frame numbers of the corrected trial.
    """
    used = pairs.select(*KEY, F.col("auto_id").alias("event_id"))
    left = (
        auto_events.filter(F.col("kind") != "tracking_failure")
        .join(used, [*KEY, "event_id"], "left_anti")
        .join(windows, KEY)
        .filter((F.col("start_frame") <= F.col("win_end")) & (F.col("end_frame") >= F.col("win_start")))
    )
    c = events.select(*KEY, F.col("start_frame").alias("cs"), F.col("end_frame").alias("ce"))
    reach = (
        overlaps(left.select(*KEY, "event_id", "start_frame", "end_frame"), c, ("start_frame", "end_frame"), ("cs", "ce"))
        .groupBy(*KEY, "event_id")
        .agg(F.min("cs").alias("cs"), F.max("ce").alias("ce"))
    )
    left = left.join(reach, [*KEY, "event_id"], "left")
    ids = ids_in_span(
        left, spans, F.least("start_frame", F.coalesce("cs", "start_frame")),
        F.greatest("end_frame", F.coalesce("ce", "end_frame")),
    )
    return left.drop("cs", "ce", "win_start", "win_end").join(ids, [*KEY, "event_id"], "left").withColumn(
        "correction_ids", F.coalesce("correction_ids", F.array().cast("array<string>"))
    )
