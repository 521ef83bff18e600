"""Editing the corrections layer itself: ranges, event edits, single entries, reverts and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.numbers import fmt
from wayfare.operators.review import spans_at
from wayfare.operators.timeline import KEY

WHEN = ["timestamp", "id"]
BUCKET = 1024


def resolve_ranges(marks: DataFrame) -> DataFrame:
    """The ranges that remain after marking and clearing in order.

    ``marks``: KEY, id, timestamp, range_type (null clears), start_frame, end_frame. A later mark wins
    over the frames it covers; touching stretches of one type become one range. Works on the edges of
    the marks, never on frames.
    """
    m = marks.select(
        *KEY, "id", "timestamp", "range_type", F.least("start_frame", "end_frame").alias("a"), (F.greatest("start_frame", "end_frame") + 1).alias("z")
    )
    # marks are cut at fixed buckets, so marks and edges meet bucket by bucket
    m = m.withColumn("b", F.explode(F.sequence(F.floor(F.col("a") / BUCKET), F.floor((F.col("z") - 1) / BUCKET))))
    m = m.withColumn("a", F.greatest("a", F.col("b") * BUCKET)).withColumn("z", F.least("z", (F.col("b") + 1) * BUCKET))
    edges = m.select(*KEY, "b", F.col("a").alias("at")).unionByName(m.select(*KEY, "b", F.col("z").alias("at"))).distinct()
    inside = Window.partitionBy(*KEY, "b").orderBy("at")
    w = Window.partitionBy(*KEY).orderBy("at")
    parts = edges.withColumn("to", F.lead("at").over(inside)).filter(F.col("to").isNotNull())
    hit = parts.join(m, [*KEY, "b"]).filter((F.col("a") <= F.col("at")) & (F.col("to") <= F.col("z")))
    top = hit.groupBy(*KEY, "at", "to").agg(
        F.max_by("range_type", F.struct("timestamp", "id")).alias("range_type"),
        F.max_by("id", F.struct("timestamp", "id")).alias("id"),
        F.max("timestamp").alias("timestamp"),
    ).filter(F.col("range_type").isNotNull())
    joined = (F.lag("to").over(w) == F.col("at")) & (F.lag("range_type").over(w) == F.col("range_type"))
    top = top.withColumn("new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("g", F.sum("new").over(w))
    return top.groupBy(*KEY, "g").agg(
        F.min_by("id", "at").alias("id"), F.max("timestamp").alias("timestamp"), F.first("range_type").alias("range_type"),
        F.min("at").alias("start_frame"), (F.max("to") - 1).alias("end_frame"),
    ).drop("g")


def coalesce_points(points: DataFrame) -> DataFrame:
    """One entry per frame and point: the first id, the last value; a clear (null x) removes it."""
    first, last = F.struct(*WHEN), F.struct(*WHEN)
    g = points.groupBy(*KEY, "frame_index", "point").agg(
        F.min_by("id", first).alias("id"),
        F.max_by(F.struct("x", "y", "confidence", "valid", "timestamp"), last).alias("v"),
    )
    return g.filter(F.col("v.x").isNotNull()).select(*KEY, "id", "v.timestamp", "frame_index", "point", "v.x", "v.y", "v.confidence", "v.valid")


def coalesce_event_edits(actions: DataFrame) -> DataFrame:
    """The event corrections that remain after a log of actions on each event.

    ``actions``: KEY, id, timestamp, event_id (target), action (add, edit, confirm, reclassify, delete,
    revert), hole_index, start_frame, end_frame. Edits merge field by field into the first edit's id; a
    confirmation marks the edit; a reclassification replaces its values; a delete replaces the edits of
    an automatic event and removes an added event altogether.
    """
    a = F.col("action")
    target = F.when(a == "add", F.concat(F.lit("user-"), F.col("id"))).otherwise(F.col("event_id"))
    df = actions.withColumn("target", target)
    item = F.struct("timestamp", "id", "action", "hole_index", "start_frame", "end_frame")
    log = df.groupBy(*KEY, "target").agg(F.array_sort(F.collect_list(item)).alias("log"))
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    empty = F.struct(
        none_s.alias("action"), none_s.alias("id"), none_s.alias("timestamp"), none_i.alias("hole_index"),
        none_i.alias("start_frame"), none_i.alias("end_frame"), F.lit(False).alias("confirmed"), none_s.alias("new_kind"),
    )

    def step(acc: Column, v: Column) -> Column:
        act = v["action"]
        adding, gone = act == "add", act.isin("delete", "revert")
        was_add = F.coalesce(acc["action"] == "add", F.lit(False))
        was_edit = F.coalesce(acc["action"] == "edit", F.lit(False))
        void = (act == "revert") | ((act == "delete") & was_add)
        cleared = gone | (act == "reclassify")
        keep = was_add | was_edit

        def field(name: str) -> Column:
            own = F.coalesce(v[name], F.when(keep, acc[name]))
            return F.when(cleared, none_i).otherwise(own)

        kind = F.when(void, none_s).when(act == "delete", "delete").when(adding | was_add, "add").otherwise("edit")
        ident = F.when(void, none_s).when(act == "delete", v["id"]).when(keep, acc["id"]).otherwise(v["id"])
        return F.struct(
            kind.alias("action"), ident.alias("id"), F.when(void, none_s).otherwise(v["timestamp"]).alias("timestamp"),
            field("hole_index").alias("hole_index"), field("start_frame").alias("start_frame"), field("end_frame").alias("end_frame"),
            (act == "confirm").alias("confirmed"), F.when(act == "reclassify", "tracking_failure").otherwise(none_s).alias("new_kind"),
        )

    out = log.select(*KEY, "target", F.aggregate("log", empty, step).alias("e"))
    return out.filter(F.col("e.action").isNotNull()).select(
        *KEY, F.when(F.col("e.action") != "add", F.col("target")).alias("event_id"), "e.id", "e.timestamp", "e.action",
        "e.hole_index", "e.start_frame", "e.end_frame", "e.confirmed", "e.new_kind",
    )


def single_entries(entries: DataFrame) -> DataFrame:
    """Trial starts, overrides and non-escape claims: one per video and kind, the first id with the last value."""
    kinds = entries.filter(F.col("kind").isin("trial_start", "strategy_override", "no_escape"))
    order = F.struct(*WHEN)
    return kinds.groupBy(*KEY, "kind").agg(
        F.min_by("id", order).alias("id"), F.max("timestamp").alias("timestamp"),
        F.max_by("frame_index", order).alias("frame_index"), F.max_by("strategy", order).alias("strategy"),
        F.max_by("reason_text", order).alias("reason_text"),
    )


def revert(corrections: DataFrame, ids: DataFrame | None = None, events: DataFrame | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """Corrections without those named by id, by event, or by kind."""
    out = corrections
    if ids is not None:
        out = out.join(ids.select(*KEY, "id").distinct(), [*KEY, "id"], "left_anti")
    if kinds is not None:
        out = out.join(kinds.select(*KEY, "kind").distinct(), [*KEY, "kind"], "left_anti")
    if events is not None:
        about = F.when(F.col("action") == "add", F.concat(F.lit("user-"), F.col("id"))).otherwise(F.col("event_id"))
        gone = events.select(*KEY, F.col("event_id").alias("about")).distinct()
        out = out.withColumn("about", F.when(F.col("kind") == "event", about)).join(gone, [*KEY, "about"], "left_anti").drop("about")
    return out


def at_frames(corrections: DataFrame, frames: DataFrame) -> DataFrame:
    """Corrections at each asked frame (KEY, frame_index): points and starts on it, ranges over it."""
    c = corrections.filter(F.col("kind").isin("point", "trial_start", "range")).select(
        *KEY, "id", "kind", F.coalesce("frame_index", "start_frame").alias("start_frame"), F.coalesce("frame_index", "end_frame").alias("end_frame")
    )
    return spans_at(frames.select(*KEY, "frame_index"), c, ["id", "kind"]).select(*KEY, F.col("frame_index").alias("asked"), "id", "kind")


def of_events(corrections: DataFrame, events: DataFrame) -> DataFrame:
    """The event corrections behind each event, the one that added it included."""
    about = F.when(F.col("action") == "add", F.concat(F.lit("user-"), F.col("id"))).otherwise(F.col("event_id"))
    c = corrections.filter(F.col("kind") == "event").select(*KEY, about.alias("event_id"), "id", "action")
    return events.select(*KEY, "event_id").join(c, [*KEY, "event_id"])


def orphaned(corrections: DataFrame, flags: DataFrame) -> DataFrame:
    """Corrections that do not apply, with the flag that says so."""
    f = flags.filter(F.col("code").isin("orphaned_correction", "correction_out_of_range") & F.col("correction_id").isNotNull())
    return f.select(*KEY, F.col("correction_id").alias("id"), "code").join(corrections.select(*KEY, "id", "kind"), [*KEY, "id"])


def describe(corrections: DataFrame) -> DataFrame:
    """One sentence per correction."""
    c = F.col
    n = lambda x: F.coalesce(c(x).cast("string"), F.lit("…"))
    which = F.when(c("point") == "nose", "Nose").otherwise("Centroid")
    point = F.when(
        c("valid"), F.concat(which, F.lit(" placed by hand on frame "), n("frame_index"), fmt(" at (%.1f, ", "x"), fmt("%.1f) px", "y"))
    ).otherwise(F.concat(which, F.lit(" marked invalid on frame "), n("frame_index")))
    span = F.concat(F.lit(", frames "), n("start_frame"), F.lit("–"), n("end_frame"))
    range_ = F.concat(F.when(c("range_type") == "not_visible", "Animal not visible").otherwise("Animal in the escape box"), span)
    changes = F.concat_ws(
        ", ", F.concat(F.lit("hole → "), c("hole_index").cast("string")),
        F.when(c("start_frame").isNotNull() | c("end_frame").isNotNull(), F.concat(F.lit("frames → "), n("start_frame"), F.lit("–"), n("end_frame"))),
    )
    named = F.concat(F.lit("Event "), F.coalesce("event_id", F.lit("(none)")))
    event = (
        F.when(c("action") == "add", F.concat(F.lit("Investigation added at hole "), n("hole_index"), span))
        .when(c("action") == "delete", F.concat(named, F.lit(" deleted")))
        .when(c("new_kind") == "tracking_failure", F.concat(named, F.lit(" reclassified: not an entry, the animal was lost")))
        .when(c("confirmed"), F.concat(named, F.lit(" confirmed, no change")))
        .otherwise(F.concat(named, F.lit(" edited: "), F.coalesce(F.nullif(changes, F.lit("")), F.lit("no change"))))
    )
    because = F.coalesce(F.concat(F.lit(": "), F.nullif(c("reason_text"), F.lit(""))), F.lit(""))
    text = (
        F.when(c("kind") == "point", point).when(c("kind") == "range", range_).when(c("kind") == "event", event)
        .when(c("kind") == "trial_start", F.concat(F.lit("Trial start moved to frame "), n("frame_index")))
        .when(c("kind") == "strategy_override", F.concat(F.lit("Strategy set to "), c("strategy"), F.lit(" by hand"), because))
        .otherwise(F.concat(F.lit("No escape, as a reviewer saw"), because))
    )
    return corrections.select(*KEY, "id", text.alias("sentence"))


def stamp_reviewer(before: DataFrame, after: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Entries a write changed or added take the session's reviewer; untouched ones keep theirs.

    ``reviewers``: session_id, reviewer.
    """
    cols = [c for c in after.columns if c not in (*KEY, "id", "reviewer")]
    old = before.select(*KEY, "id", F.struct(*cols).alias("old"), F.col("reviewer").alias("was"))
    now = reviewers.select("session_id", F.col("reviewer").alias("now"))
    df = after.join(old, [*KEY, "id"], "left").join(now, "session_id", "left")
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col("old")[c])
    kept = F.col("old").isNotNull() & same
    return df.withColumn("reviewer", F.when(kept, F.col("was")).otherwise(F.col("now"))).select(*after.columns)
