"""Events of a trial: hole visits, escape entries and tracking losses.

Works on pieces (runs of equal frames), which are far fewer than frames. Only runs that begin in
the trial matter from ``classify_runs`` on, so everything after it is bounded by the trial.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import geometry as G
from wayfare.operators.clean import ABSENT, FULL, PARTIAL, TRACK
from wayfare.operators.timeline import Carry, beside, carry, in_chunks, spread
from wayfare.operators.trial import resolve_end
from wayfare.session import chunk_frames, materialise

SPAN_BUCKET = 64


def pieces(clean: DataFrame) -> DataFrame:
    """One row per piece, with its first and last frame."""
    last = F.struct(
        "pos", "t", "frame_index", "ex", "ey", "nearest", "near_px", "partial_at", "use_nose", "area"
    )
    return clean.filter("piece_end").select(
        *TRACK, "chunk", "kind", F.col("partial_at").alias("part"), F.col("hole_at").alias("hole"), "box",
        F.col("piece_first").alias("first"), last.alias("last"),
    )


def trial_pieces(pieces_: DataFrame, cut: DataFrame, chunk_frames: int) -> DataFrame:
    """Pieces from the trial start on, clipped to it, with what lies before and after each of them."""
    around = carry(
        materialise(pieces_.withColumn("at", F.col("first.pos")), "pieces"),
        [
            Carry("before", F.struct("kind", "hole", "last")),
            Carry("seen", F.when(F.col("kind") != ABSENT, F.col("last"))),
            Carry("after", F.col("first"), following=True),
        ],
        TRACK,
        order="at",
    )
    around = materialise(around, "pieces-around")
    slim = cut.select(*TRACK, "n", F.col("from"), F.col("cut.pos").alias("cut_pos"))
    df = around.join(spread(slim, TRACK, chunk_frames), [*TRACK, "chunk"])
    df = df.filter(F.col("from").isNotNull() & (F.col("last.pos") >= F.col("from.pos")))
    clipped = F.col("first.pos") < F.col("from.pos")
    start = F.when(clipped, F.col("from")).otherwise(F.struct("first.pos", "first.t", "first.frame_index"))
    df = df.withColumn("start", start).withColumn("at", F.col("start.pos"))
    floor = F.col("from.pos")
    df = df.withColumn("before", F.when(F.col("before.last.pos") >= floor, F.col("before")))
    seen_in = F.coalesce(F.col("seen.pos") >= floor, F.lit(False))
    member = F.col("kind") != FULL
    other_hole = (
        (F.col("kind") == PARTIAL)
        & seen_in
        & (F.col("seen.partial_at") >= 0)
        & (F.col("seen.partial_at") != F.col("part"))
    )
    begins = member & (F.col("before").isNull() | (F.col("before.kind") == FULL) | other_hole)
    same = F.coalesce(F.col("before.hole") == F.col("hole"), F.lit(False))
    visit = (F.col("hole") >= 0) & ~same
    df = carry(
        df,
        [
            Carry("run", F.when(begins, F.col("at")), inclusive=True),
            Carry("chain", F.when(visit, F.col("at")), inclusive=True),
            Carry("chain_before", F.when(visit, F.col("at"))),
        ],
        TRACK,
        order="at",
    )
    walk = F.struct(
        "hole", "chain", F.col("at").alias("start"), F.col("before.hole").alias("hole_before"), "chain_before"
    )
    df = carry(df, [Carry("walk", walk)], TRACK, order="at")
    return df.withColumn("run", F.when(member, F.col("run")))


def entry_runs(trial: DataFrame) -> DataFrame:
    """Maximal stretches of absent or partial frames, each at one hole."""
    at, size = F.col("at"), F.col("last.pos") - F.col("at") + 1
    box_at = F.when(F.col("box"), at)
    members = trial.filter(F.col("run").isNotNull())
    runs = members.groupBy(*TRACK, "run").agg(
        F.min_by("start", "at").alias("start"),
        F.max_by(F.struct("last.pos", "last.t", "last.frame_index"), "at").alias("end"),
        F.max("part").alias("partial_hole"),
        F.coalesce(F.sum(F.when(F.col("kind") == PARTIAL, size)), F.lit(0)).alias("partial_frames"),
        F.coalesce(F.sum(F.when(F.col("kind") == ABSENT, size)), F.lit(0)).alias("absent_frames"),
        F.min_by("start", box_at).alias("box_start"),
        F.min_by("seen", box_at).alias("box_seen"),
        F.min_by("before", "at").alias("before"),
        F.min_by("walk", "at").alias("walk"),
        F.max_by("after", "at").alias("after"),
        F.first("n").alias("n"),
        F.first("from").alias("from"),
        F.first("cut_pos").alias("cut_pos"),
    )
    return runs.withColumn(
        "last_seen",
        F.when((F.col("start.pos") > F.col("from.pos")) & (F.col("before.kind") != ABSENT), F.col("before.last")),
    ).drop("before")


def classify_runs(runs: DataFrame, geo: DataFrame, p: dict[str, Any]) -> DataFrame:
    """What each run is: an escape entry, an unlikely entry elsewhere, a tracking failure or nothing."""
    g = geo.select("session_id", "video_id", "holes", "target", "inv_px", "esc_px", "hole_r_px", "px_per_cm", "pcx", "pcy", "trial_type")
    df = runs.filter(F.col("start.pos") <= F.col("cut_pos")).join(g, ["session_id", "video_id"])
    esc = p["escapeEntry"]
    seen = F.col("last_seen")
    df = df.withColumn(
        "hole",
        F.when(F.col("partial_hole") >= 0, F.col("partial_hole"))
        .when(seen["near_px"] <= F.col("esc_px"), seen["nearest"])
        .otherwise(-1),
    )
    df = df.withColumn("to_end", F.col("end.pos") == F.col("n") - 1).withColumn(
        "duration", F.col("end.t") - F.col("start.t")
    )
    back_px = F.when(
        F.col("after").isNotNull() & (F.col("hole") >= 0),
        G.distance_to_hole(F.col("holes"), F.col("hole"), F.col("after.ex"), F.col("after.ey")),
    )
    df = df.withColumn("back_px", back_px).withColumn(
        "back_same", F.coalesce(F.col("back_px") <= F.col("inv_px"), F.lit(False))
    )
    box_here = F.col("trial_type") != "probe"
    marked = box_here & F.col("box_start").isNotNull()
    at_target = box_here & (F.col("hole") == F.col("target"))
    long_enough = (F.col("to_end") & at_target) | (F.col("duration") >= float(esc["minDuration_s"]))
    shaped = (F.col("hole") >= 0) & long_enough & (F.col("after").isNull() | F.col("back_same"))
    lost = long_enough & (F.col("absent_frames") > 0)
    df = df.withColumn("by_user", marked).withColumn(
        "outcome",
        F.when(marked | (shaped & at_target), "escape_entry")
        .when(shaped, "investigation")
        .when(lost, "tracking_failure")
        .otherwise("none"),
    )
    lasted = F.when(marked, F.col("end.t") - F.col("box_start.t")).otherwise(F.col("duration"))
    failure_hole = F.when(seen["near_px"] <= F.col("inv_px"), seen["nearest"])
    return (
        df.withColumn("first", F.when(marked, F.col("box_start")).otherwise(F.col("start")))
        .withColumn(
            "persistent",
            (F.col("outcome") == "escape_entry") & (F.col("to_end") | (lasted >= float(esc["persistCutoff_s"]))),
        )
        .withColumn(
            "event_hole",
            F.when(marked, F.col("target"))
            .when(F.col("outcome") == "tracking_failure", failure_hole)
            .when(F.col("hole") >= 0, F.col("hole")),
        )
        .withColumn("claim_px", F.when(marked, F.col("box_seen.near_px")))
        .drop("holes")
    )


def trial_bounds(cut: DataFrame, runs: DataFrame) -> DataFrame:
    """The end of each trial: the first persistent entry, else the cutoff, else the end of the video."""
    entry = runs.filter("persistent").groupBy(*TRACK).agg(
        F.min_by("first", F.col("first.pos")).alias("escape")
    )
    end, reason = resolve_end(F.col("escape"))
    return (
        cut.join(entry, TRACK, "left").withColumn("end", end).withColumn("end_reason", reason).drop("escape")
    )


def bouts(trial: DataFrame, runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Stretches of frames at one hole inside the trial, without the frames of an entry."""
    masked = runs.filter(
        F.col("outcome").isin("escape_entry", "investigation") & (F.col("partial_frames") > 0)
    ).select(*TRACK, "run")
    at_hole = trial.filter(F.col("hole") >= 0).drop("from", "n").join(
        bounds.select(*TRACK, F.col("end").alias("trial_end")), TRACK
    )
    at_hole = at_hole.filter(F.col("at") <= F.col("trial_end.pos")).join(masked, [*TRACK, "run"], "left_anti")
    over = F.col("last.pos") > F.col("trial_end.pos")
    stop = F.when(over, F.col("trial_end")).otherwise(F.struct("last.pos", "last.t", "last.frame_index"))
    w = Window.partitionBy(*TRACK).orderBy("at")
    next_hole = F.when(over, F.col("hole")).when(F.col("last.pos") == F.col("trial_end.pos"), F.col("after.hole_at"))
    still = F.coalesce(next_hole == F.col("hole"), F.lit(False))
    part = at_hole.select(*TRACK, "at", "hole", "start", stop.alias("stop"), still.alias("still"))
    joined = (F.lag("stop.pos").over(w) == F.col("at") - 1) & (F.lag("hole").over(w) == F.col("hole"))
    part = part.withColumn("new", (~F.coalesce(joined, F.lit(False))).cast("int"))
    part = part.withColumn("bout", F.sum("new").over(w))
    return part.groupBy(*TRACK, "hole", "bout").agg(
        F.min_by("start", "at").alias("start"),
        F.max_by("stop", "at").alias("stop"),
        F.max_by("still", "at").alias("still"),
    ).drop("bout")


def merged_visits(bouts_: DataFrame, runs: DataFrame, bounds: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Bouts and unlikely entries at one hole, merged while the gap between them is short enough."""
    unlikely = (
        runs.filter(F.col("outcome") == "investigation")
        .join(bounds.select(*TRACK, F.col("end.pos").alias("end_pos")), TRACK)
        .filter(F.col("start.pos") <= F.col("end_pos"))
        .select(
            *TRACK, F.col("event_hole").alias("hole"), "start", F.col("end").alias("stop"),
            F.coalesce(
                (F.col("end.pos") == F.col("end_pos")) & (F.col("after.hole_at") == F.col("event_hole")), F.lit(False)
            ).alias("still"),
            "run",
        )
    )
    parts = bouts_.withColumn("run", F.lit(None).cast("int")).unionByName(unlikely)
    w = Window.partitionBy(*TRACK, "hole").orderBy("start.pos")
    reach = F.max("stop.t").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("start.t") - F.col("reach")
    parts = parts.withColumn("reach", reach).withColumn(
        "new", (~F.coalesce(gap < float(p["holeInvestigation"]["mergeGap_s"]), F.lit(False))).cast("int")
    )
    parts = parts.withColumn("visit", F.sum("new").over(w))
    merged = parts.groupBy(*TRACK, "hole", "visit").agg(
        F.min_by("start", F.col("start.pos")).alias("first"),
        F.max_by("stop", F.col("stop.pos")).alias("end"),
        F.count(F.lit(1)).alias("bouts"),
        F.greatest(F.lit(0.0), F.max(F.when(F.col("new") == 0, gap))).alias("largest_gap"),
        F.min(F.col("run")).alias("run"),
        F.max_by("still", F.col("stop.pos")).alias("still"),
    )
    long_enough = F.col("end.t") - F.col("first.t") >= float(p["holeInvestigation"]["minDuration_s"])
    return merged.filter(long_enough).drop("visit")


def span_distances(clean: DataFrame, spans: DataFrame, geo: DataFrame) -> DataFrame:
    """Closest approach to a hole over each span, and how many frames used the nose.

    ``spans``: TRACK, span_id, hole, lo, hi. Frames and spans meet by chunk and small buckets of positions, so
    the join is on equal keys, no group is larger than a bucket, and frames clustered by chunk stay where they are.
    """
    known = spans.filter(F.col("hole").isNotNull() & (F.col("lo") <= F.col("hi")))
    wanted = in_chunks(known, "lo", "hi", chunk_frames(clean.sparkSession), SPAN_BUCKET)
    g = geo.select("session_id", "video_id", "holes", "px_per_cm")
    wanted = wanted.join(g, ["session_id", "video_id"]).select(
        *TRACK, "span_id", "chunk", "bucket", "lo", "hi", "px_per_cm",
        F.element_at("holes", (F.col("hole") + 1).cast("int")).alias("h"),
    )
    points = clean.filter("c_valid").select(
        *TRACK, "chunk", (F.col("pos") / SPAN_BUCKET).cast("int").alias("bucket"), "pos", "x", "y", "nx", "ny", "use_nose"
    )
    hit = points.join(beside(wanted, TRACK), [*TRACK, "chunk", "bucket"]).filter(F.col("pos").between(F.col("lo"), F.col("hi")))
    cm = F.col("px_per_cm")
    d_c = G.length(F.col("x") - F.col("h.x"), F.col("y") - F.col("h.y")) / cm
    d_n = F.when(F.col("use_nose"), G.length(F.col("nx") - F.col("h.x"), F.col("ny") - F.col("h.y")) / cm)
    return hit.groupBy(*TRACK, "span_id").agg(
        F.min(d_n).alias("min_nose_cm"),
        F.min(d_c).alias("min_centroid_cm"),
        F.count_if("use_nose").alias("nose_frames"),
        F.count_if(~F.col("use_nose")).alias("centroid_frames"),
    )


def kind_order(kind: Column) -> Column:
    return F.when(kind == "investigation", 0).when(kind == "escape_entry", 1).otherwise(2)


def event_id(kind: Column, hole: Column, start_number: Column) -> Column:
    return F.concat(
        F.lit("auto-"), kind, F.lit("-h"), F.coalesce(hole.cast("string"), F.lit("x")),
        F.lit("-f"), start_number.cast("string"),
    )


def detect(
    trial: DataFrame, runs: DataFrame, bounds: DataFrame, clean: DataFrame, geo: DataFrame, p: dict[str, Any]
) -> DataFrame:
    """All events of the tracks in ``bounds``, for the trial end given there."""
    visits = merged_visits(bouts(trial, runs, bounds), runs, bounds, p).select(
        *TRACK, F.lit("investigation").alias("kind"), "hole", "first", "end",
        F.col("first.pos").alias("lo"), F.col("end.pos").alias("hi"),
        "run", "bouts", "largest_gap", "still",
    )
    seen = F.col("last_seen")
    w = F.col("walk")
    hole = F.col("event_hole")
    approach = (
        F.when(w["hole"] == hole, w["chain"])
        .when((w["start"] == seen["pos"]) & (w["hole_before"] == hole), w["chain_before"])
        .otherwise(seen["pos"])
    )
    losses = (
        runs.filter(F.col("outcome").isin("escape_entry", "tracking_failure"))
        .join(bounds.select(*TRACK, F.col("end.pos").alias("end_pos")), TRACK)
        .filter(F.col("first.pos") <= F.col("end_pos"))
        .select(
            *TRACK, F.col("outcome").alias("kind"), hole.alias("hole"), "first", "end",
            F.when(seen.isNotNull() & hole.isNotNull(), approach).alias("lo"),
            F.when(F.col("partial_frames") > 0, F.col("end.pos")).otherwise(seen["pos"]).alias("hi"),
            "run", F.lit(None).cast("bigint").alias("bouts"), F.lit(None).cast("double").alias("largest_gap"),
            F.lit(False).alias("still"),
            F.when(F.coalesce(seen["use_nose"], F.lit(False)), "nose").otherwise("centroid").alias("point_at_loss"),
        )
    )
    both = visits.withColumn("point_at_loss", F.lit(None).cast("string")).unionByName(losses)
    both = both.withColumn("span_id", F.concat_ws("/", "kind", F.col("hole").cast("string"), F.col("first.pos").cast("string")))
    measured = span_distances(clean, both.select(*TRACK, "span_id", "hole", "lo", "hi"), geo)
    g = geo.select("session_id", "video_id", "target")
    ends = bounds.select(*TRACK, F.col("end.t").alias("trial_end_t"))
    df = both.join(measured, [*TRACK, "span_id"], "left").join(g, ["session_id", "video_id"]).join(ends, TRACK)
    used = F.when(F.col("nose_frames") > F.col("centroid_frames"), "nose").otherwise("centroid")
    return df.select(
        *TRACK,
        event_id(F.col("kind"), F.col("hole"), F.col("first.frame_index")).alias("event_id"),
        "kind",
        F.col("hole").alias("hole_index"),
        F.coalesce(F.col("hole") == F.col("target"), F.lit(False)).alias("is_target"),
        F.col("first.pos").alias("start_pos"),
        F.col("end.pos").alias("end_pos"),
        F.col("first.frame_index").alias("start_frame"),
        F.col("end.frame_index").alias("end_frame"),
        F.col("first.t").alias("start_t"),
        F.col("end.t").alias("end_t"),
        (F.col("end.t") - F.col("first.t")).alias("duration_s"),
        F.coalesce("point_at_loss", used).alias("point_used"),
        "min_nose_cm",
        "min_centroid_cm",
        F.coalesce("nose_frames", F.lit(0)).alias("nose_frames"),
        F.coalesce("centroid_frames", F.lit(0)).alias("centroid_frames"),
        "run",
        "bouts",
        "largest_gap",
        "still",
        "trial_end_t",
    )
