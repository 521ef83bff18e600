"""Event corrections: add, edit, reclassify, confirm and delete, in the order they were made.

The edits of one video depend on each other, so the (short) list of one trial's events and edits is
folded per video; spans an edit changed are measured afterwards by the span join.
"""

from __future__ import annotations

import sys
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.numbers import fmt
from wayfare.operators.clean import TRACK
from wayfare.operators.events import span_distances
from wayfare.operators.timeline import KEY, beside, overlaps, spread
from wayfare.session import PARTITIONS_CONF, chunk_frames

# the fold travels with its task, so workers need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEASURE = "\u0001"

EVENT_SCHEMA = (
    "event_id string, kind string, hole_index int, is_target boolean, start_pos int, end_pos int, "
    "start_frame int, end_frame int, start_t double, end_t double, duration_s double, point_used string, "
    "min_nose_cm double, min_centroid_cm double, evidence string, source string, evidence_corrected boolean, "
    "correction_ids array<string>, confirmed boolean, "
    "auto_shadow struct<hole_index:int,start_frame:int,end_frame:int,kind:string>"
)
COLUMNS = [c.strip().split(" ")[0] for c in EVENT_SCHEMA.split("auto_shadow")[0].split(",") if c.strip()] + ["auto_shadow"]
OUT_SCHEMA = (
    "session_id string, video_id string, row string, measure boolean, code string, message string, "
    "flag_event string, correction_id string, flag_frame int, "
    + EVENT_SCHEMA.split("auto_shadow")[0]
    + "has_shadow boolean, shadow_hole int, shadow_start int, shadow_end int, shadow_kind string"
)
# pandas columns of the shadow: Arrow has no nullable struct column to pandas and back
SHADOW = {"shadow_hole": "hole_index", "shadow_start": "start_frame", "shadow_end": "end_frame", "shadow_kind": "kind"}
FLAT = [c for c in COLUMNS if c != "auto_shadow"] + ["has_shadow", *SHADOW]


def _int(v: Any) -> int | None:
    return None if v is None or pd.isna(v) else int(v)


def _text(v: Any) -> str | None:
    return None if v is None or (isinstance(v, float) and pd.isna(v)) else v


def _fold(key: tuple, events: pd.DataFrame, edits: pd.DataFrame) -> pd.DataFrame:
    live: list[dict[str, Any]] = events[FLAT].to_dict("records")
    for e in live:
        e["hole_index"] = _int(e["hole_index"])
        e["correction_ids"] = list(e["correction_ids"])
        e["auto_shadow"] = _shadow(e)
        e["measure"] = False
    flags: list[dict[str, Any]] = []

    def flag(code: str, c: Any, message: str, frame: int | None = None) -> None:
        flags.append(
            {"code": code, "message": message, "flag_event": _text(c.event_id), "correction_id": c.id, "flag_frame": frame}
        )

    for c in edits.sort_values(["timestamp", "id"]).itertuples():
        named = _text(c.event_id)
        target = next((e for e in live if named is not None and e["event_id"] == named), None)
        hole, holes = _int(c.hole_index), int(c.n_holes)
        if c.action == "add":
            spot = (_int(c.lo), _int(c.hi))
            if hole is None or None in spot or spot[0] > spot[1] or not 0 <= hole < holes:
                flag("orphaned_correction", c, f"{c.id} (add) skipped: hole or frame span is not on this track.")
                continue
            live.append(
                _event(c, f"user-{c.id}", "investigation", hole, spot, c, source="corrected",
                       evidence=f"New investigation from a reviewer: hole {hole}, frames {int(c.start_frame)}–{int(c.end_frame)}. {MEASURE}",
                       correction_ids=list(c.touched))
            )
            continue
        if c.action == "edit" and _text(c.new_kind) == "tracking_failure":
            if target is None or target["kind"] != "escape_entry":
                why = "no such event now" if target is None else f"a {target['kind']} has no failure reading"
                flag("orphaned_correction", c, f"{c.id} (tracking failure for {named}) skipped: {why}.")
                continue
            base = target["auto_shadow"] or _span_of(target)
            auto_kind = base.get("kind") or target["kind"]
            base = {**base, "kind": None if auto_kind == "tracking_failure" else auto_kind}
            target.update(
                kind="tracking_failure", source="corrected", confirmed=False, auto_shadow=base,
                evidence=f"{c.id} turned this escape entry into a tracking failure. Before: {target['evidence']}",
            )
            continue
        if c.action == "edit" and c.confirmed is True:
            if target is None:
                flag("confirmation_contradicted", c, f"{c.id} confirms {named}, but these parameters give no such event.")
            elif target["kind"] == "tracking_failure":
                flag("orphaned_correction", c, f"{c.id} (confirm) skipped: {named} is a tracking failure.")
            else:
                target["confirmed"] = True
            continue
        if c.action == "delete":
            if target is None:
                flag("orphaned_correction", c, f"{c.id} (delete) had nothing to do: these parameters give no event {named}.")
            else:
                live = [e for e in live if e is not target]
            continue
        if hole is None and target is not None:
            hole = target["hole_index"]
        lo = (_int(c.lo), _int(c.start_frame), c.lo_t) if _int(c.start_frame) is not None else (
            (target["start_pos"], target["start_frame"], target["start_t"]) if target else (None, None, None))
        hi = (_int(c.hi), _int(c.end_frame), c.hi_t) if _int(c.end_frame) is not None else (
            (target["end_pos"], target["end_frame"], target["end_t"]) if target else (None, None, None))
        if lo[0] is None or hi[0] is None or lo[0] > hi[0] or (hole is not None and not 0 <= hole < holes):
            flag("orphaned_correction", c, f"{c.id} (edit of {named}) skipped: hole or frame span is not on this track.")
            continue
        new = _event(
            c, target["event_id"] if target else (named or f"user-{c.id}"), target["kind"] if target else "investigation",
            hole, (lo[0], hi[0]), c, source="corrected",
            evidence=f"Set by correction {c.id} to frames {lo[1]}–{hi[1]}. {MEASURE}",
            correction_ids=target["correction_ids"] if target else list(c.touched),
        )
        new.update(start_frame=lo[1], end_frame=hi[1], start_t=lo[2], end_t=hi[2], duration_s=hi[2] - lo[2])
        if target is None:
            over = [e["event_id"] for e in live if e["source"] == "auto" and e["start_frame"] <= hi[1] and lo[1] <= e["end_frame"]]
            if over:
                flag("orphaned_correction", c, f"{c.id} edits {named}, which these parameters do not give; its span {lo[1]}–{hi[1]} stays, together with {', '.join(over)}.")
            live.append(new)
        else:
            new["evidence_corrected"] = target["evidence_corrected"]
            new["auto_shadow"] = target["auto_shadow"] or (_span_of(target) if target["source"] == "auto" else None)
            live = [new if e is target else e for e in live]
    for e in live:
        shadow = e["auto_shadow"]
        e["has_shadow"] = shadow is not None
        e.update({c: shadow[k] if shadow else None for c, k in SHADOW.items()})
    rows = [{"row": "event", **e} for e in live] + [{"row": "flag", "measure": False, **f} for f in flags]
    out = pd.DataFrame(rows, columns=["row", "measure", "code", "message", "flag_event", "correction_id", "flag_frame", *FLAT])
    out.insert(0, "video_id", key[1])
    out.insert(0, "session_id", key[0])
    # plain Python values: nullable extension columns do not convert to one Arrow array
    ints = {"hole_index", "start_pos", "end_pos", "start_frame", "end_frame", "flag_frame", "shadow_hole", "shadow_start", "shadow_end"}
    for c in out.columns:
        values = [v if isinstance(v, list) else (None if v is None or pd.isna(v) else v) for v in out[c]]
        out[c] = pd.Series([int(v) if c in ints and v is not None else v for v in values], dtype=object, index=out.index)
    return out


def _shadow(e: dict[str, Any]) -> dict[str, Any] | None:
    if not e["has_shadow"]:
        return None
    return {k: _text(e[c]) if k == "kind" else _int(e[c]) for c, k in SHADOW.items()}


def _span_of(e: dict[str, Any]) -> dict[str, Any]:
    return {"hole_index": e["hole_index"], "start_frame": e["start_frame"], "end_frame": e["end_frame"], "kind": None}


def _event(c: Any, event_id: str, kind: str, hole: int | None, spot: tuple, at: Any, **more: Any) -> dict[str, Any]:
    both = not (pd.isna(at.lo_t) or pd.isna(at.hi_t))
    base = dict(
        event_id=event_id, kind=kind, hole_index=hole, is_target=hole is not None and hole == int(c.target),
        start_pos=spot[0], end_pos=spot[1], start_frame=_int(at.start_frame), end_frame=_int(at.end_frame),
        start_t=at.lo_t, end_t=at.hi_t, duration_s=(at.hi_t - at.lo_t) if both else None, point_used="centroid",
        min_nose_cm=None, min_centroid_cm=None, evidence_corrected=False, confirmed=False, auto_shadow=None, measure=True,
    )
    return {**base, **more}


def locate(edits: DataFrame, clean: DataFrame) -> DataFrame:
    """Position and stamp of the frames an event correction names."""
    size = chunk_frames(clean.sparkSession)
    frames = clean.filter(F.col("variant") == "c").select(*TRACK, "chunk", "frame_index", "pos", "t")
    lengths = frames.groupBy(*TRACK).agg((F.max("pos") + 1).alias("n"))
    for column, pos, stamp in (("start_frame", "lo", "lo_t"), ("end_frame", "hi", "hi_t")):
        want = edits.filter(F.col(column).isNotNull()).select(*KEY, F.col(column).alias("frame_index")).distinct()
        # a frame number may stand in any chunk of its track
        want = spread(want.join(lengths, KEY), TRACK, size).select(*TRACK, "chunk", "frame_index")
        found = frames.join(beside(want, TRACK), [*TRACK, "chunk", "frame_index"], "left_semi").select(
            *KEY, F.col("frame_index").alias(column), F.col("pos").alias(pos), F.col("t").alias(stamp)
        )
        edits = edits.join(found, [*KEY, column], "left")
    return edits


def event_edits(corrections: DataFrame, clean: DataFrame, geo: DataFrame, spans: DataFrame) -> DataFrame:
    """The event corrections with what the fold needs to know about the track."""
    edits = locate(corrections.filter(F.col("kind") == "event"), clean)
    named = edits.filter(F.col("start_frame").isNotNull() & F.col("end_frame").isNotNull()).select(
        *KEY, "id", F.col("start_frame").alias("a"), F.col("end_frame").alias("z")
    )
    about = spans.select(*KEY, F.col("id").alias("sid"), "timestamp", "span_start", "span_end")
    hit = (
        overlaps(named, about, ("a", "z"), ("span_start", "span_end"))
        .groupBy(*KEY, "id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "sid"))), lambda v: v["sid"]).alias("touched"))
    )
    edits = edits.join(hit, [*KEY, "id"], "left").join(geo.select(*KEY, "n_holes", "target"), KEY)
    return edits.select(
        *KEY, "id", "timestamp", "action", "event_id", "new_kind", "hole_index", "confirmed", "start_frame",
        "end_frame", "lo", "hi", "lo_t", "hi_t", "n_holes", "target",
        F.coalesce("touched", F.array().cast("array<string>")).alias("touched"),
    )


def apply_event_edits(events: DataFrame, edits: DataFrame, clean: DataFrame, geo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, flags) of the videos that have event corrections."""
    named = edits.select(*KEY).distinct()
    subset = events.join(named, KEY, "left_semi").select(
        *KEY, *[c for c in COLUMNS if c != "auto_shadow"],
        F.col("auto_shadow").isNotNull().alias("has_shadow"),
        *[F.col(f"auto_shadow.{k}").alias(c) for c, k in SHADOW.items()],
    )
    # by number: the rows are few and small but each video takes long, so by their size they would all go to one task
    tasks = int(events.sparkSession.conf.get(PARTITIONS_CONF))
    subset, edits = subset.repartition(tasks, *KEY), edits.repartition(tasks, *KEY)
    out = subset.groupBy(*KEY).cogroup(edits.groupBy(*KEY)).applyInPandas(_fold, OUT_SCHEMA)
    return out, out


def split_edited(out: DataFrame, clean: DataFrame, geo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Measure the re-measured spans of a materialised fold and split it into events and flags."""
    shadow = F.struct(*[F.col(c).alias(k) for c, k in SHADOW.items()])
    ev = (
        out.filter(F.col("row") == "event")
        .withColumn("variant", F.lit("c"))
        .withColumn("auto_shadow", F.when(F.col("has_shadow"), shadow))
    )
    spans = ev.filter("measure").select(
        *TRACK, F.col("event_id").alias("span_id"), F.col("hole_index").alias("hole"),
        F.col("start_pos").alias("lo"), F.col("end_pos").alias("hi"),
    )
    d = span_distances(clean, spans, geo).select(
        *KEY, F.col("span_id").alias("event_id"), F.col("min_nose_cm").alias("mn"), F.col("min_centroid_cm").alias("mc"),
        "nose_frames", "centroid_frames",
    )
    ev = ev.join(d, [*KEY, "event_id"], "left")
    m = F.col("measure")
    used = F.when(F.col("nose_frames") > F.col("centroid_frames"), "nose").otherwise("centroid")
    ev = (
        ev.withColumn("min_nose_cm", F.when(m, F.col("mn")).otherwise(F.col("min_nose_cm")))
        .withColumn("min_centroid_cm", F.when(m, F.col("mc")).otherwise(F.col("min_centroid_cm")))
        .withColumn("point_used", F.when(m, used).otherwise(F.col("point_used")))
        .withColumn("evidence", F.replace("evidence", F.lit(MEASURE), measure_sentence()))
    )
    flags = out.filter(F.col("row") == "flag").select(
        *KEY, "code", "message", F.col("flag_frame").alias("frame_index"), F.col("flag_event").alias("event_id"), "correction_id"
    )
    return ev.select(*KEY, *COLUMNS), flags


def measure_sentence() -> Column:
    total = F.coalesce(F.col("nose_frames") + F.col("centroid_frames"), F.lit(0))
    cm = lambda c: F.coalesce(fmt("%.1f cm", c), F.lit("n/a"))
    used = F.when(total == 0, "The span has no position.").otherwise(
        F.format_string("Nose in %d of %d positions, else the centroid.", F.col("nose_frames"), total)
    )
    near = F.when(
        F.col("min_nose_cm").isNotNull(),
        F.concat(F.lit("Least distance to the hole: nose "), cm("min_nose_cm"), F.lit(", centroid "), cm("min_centroid_cm"), F.lit(".")),
    ).otherwise(
        F.concat(
            F.lit("Least distance to the hole: centroid "), cm("min_centroid_cm"),
            F.lit(" (the nose was never seen)."),
        )
    )
    return F.concat_ws(" ", used, near)
