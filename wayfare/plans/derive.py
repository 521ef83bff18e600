"""The derived layer of a whole cohort as one plan over all tracks.

automatic track ⊕ corrections → cleaned track → pieces → runs → events → provenance → event edits →
measures, strategy, quality and flags. Nothing iterates over videos; the stages several readers share
are written once to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare import params as P
from wayfare.operators import corrections as C
from wayfare.operators import event_edits as EE
from wayfare.operators import evidence as EV
from wayfare.operators import events as E
from wayfare.operators import kinematics as K
from wayfare.operators import metrics as M
from wayfare.operators import provenance as PR
from wayfare.operators import quality as Q
from wayfare.operators import strategy as S
from wayfare.operators import trial as T
from wayfare.operators.clean import TRACK, clean_tracks, nominal_dt
from wayfare.operators.geometry import geometry
from wayfare.operators.timeline import KEY
from wayfare.session import buckets_for, chunk_frames, co_partitioned, materialise, materialise_clustered, materialise_plain


@dataclass
class Inputs:
    """The tables a cohort is derived from."""

    frames: DataFrame
    videos: DataFrame
    maze_maps: DataFrame
    corrections: DataFrame
    auto_layers: DataFrame | None = None
    index_drift: DataFrame | None = None


@dataclass
class Derived:
    """Every table of the derived layer."""

    geometry: DataFrame
    clean: DataFrame
    bounds: DataFrame
    runs: DataFrame
    events: DataFrame
    removed: DataFrame
    flags: DataFrame
    trial: DataFrame
    motion: DataFrame
    kinematics: DataFrame
    strategy: DataFrame
    scan: DataFrame
    gaps: DataFrame
    quality: DataFrame
    metrics: DataFrame
    stages: dict[str, DataFrame] = field(default_factory=dict)


FLAG_COLUMNS = [*KEY, "code", "message", "frame_index", "event_id", "correction_id"]


def cleaned(inputs: Inputs, p: dict[str, Any]) -> dict[str, DataFrame]:
    """Frames with edits applied and cleaned, in both variants, with the geometry they were read under."""
    return _cleaned(inputs, p)[0]


def _cleaned(inputs: Inputs, p: dict[str, Any]) -> tuple[dict[str, DataFrame], int]:
    size = chunk_frames(inputs.frames.sparkSession)
    geo = geometry(inputs.videos, inputs.maze_maps, p).filter(F.col("problem").isNull())
    flat = C.flat_frames(inputs.frames, size)
    spans = C.track_spans(inputs.frames)
    # small tables are written first: their true sizes then decide how the frames are joined to them
    edits = materialise_plain(C.frame_edits(inputs.corrections, inputs.frames, spans), "edits")
    fields = materialise_plain(C.edited_fields(edits, size).withColumn("variant", F.lit("c")), "fields")
    per_video = geo.join(spans.select(*KEY, "n"), KEY).join(nominal_dt(flat, KEY), KEY, "left")
    per_video = materialise_plain(per_video.withColumn("row", F.monotonically_increasing_id()), "per-video")
    # both variants of a chunk lie together: the one exchange of the frames, and how they are clustered
    buckets = buckets_for(2 * (per_video.agg(F.sum("n")).first()[0] or 0))
    clean = clean_tracks(C.both_variants(flat, edits, fields, buckets), per_video, p, size)
    return {"geometry": per_video.drop("n", "nominal_dt", "row"), "edits": edits, "clean": clean}, buckets


def clustered(inputs: Inputs, p: dict[str, Any]) -> dict[str, DataFrame]:
    """``cleaned``, with the frames written as a table clustered by chunk of a video, both variants together."""
    with co_partitioned(inputs.frames.sparkSession):
        stage, buckets = _cleaned(inputs, p)
        stage["clean"] = materialise_clustered(stage["clean"], "clean", [*KEY, "chunk"], [*TRACK, "chunk", "pos"], buckets)
    return stage


def detected(stage: dict[str, DataFrame], bounds: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Events of the tracks in ``bounds`` with their evidence."""
    ev = E.detect(stage["trial_pieces"], stage["runs"], bounds, stage["clean"], stage["geometry"], p)
    return EV.evidence(ev, stage["run_texts"], stage["geometry"], p)


def with_provenance(
    stage: dict[str, DataFrame], corrected: DataFrame, bounds: DataFrame, override: bool, p: dict[str, Any]
) -> tuple[DataFrame, DataFrame]:
    """(events labelled against the automatic detection, removed automatic events)."""
    twin = stage["bounds"].filter(F.col("variant") == "a").select(*TRACK, "n", F.col("from"), F.col("end").alias("own_end"), "end_reason")
    ends = bounds.filter(F.col("variant") == "c").select(
        *KEY, F.col("end").alias("c_end"), F.col("from").alias("c_from"), F.col("end_reason").alias("c_reason")
    )
    # the automatic pass starts where the corrected trial starts and runs to the later of the two
    # ends; an end moved by an event correction holds for both
    a = twin.join(ends, KEY).filter(F.col("c_end").isNotNull())
    own_later = F.col("own_end.pos") >= F.col("c_end.pos")
    end = F.col("c_end") if override else F.when(own_later, F.col("own_end")).otherwise(F.col("c_end"))
    auto_bounds = a.withColumn("end", end)
    auto = materialise_plain(detected(stage, auto_bounds, p), "auto-events")
    if not override:
        stage["auto_events"] = auto
    auto_bounds = materialise_plain(auto_bounds, "auto-bounds")
    both = auto_bounds.select(*KEY).distinct()
    ours = corrected.join(both, KEY, "left_semi")
    rest = PR.untouched(corrected.join(both, KEY, "left_anti"))
    spans = stage["correction_spans"]
    labelled, pairs = PR.label(ours, auto, spans)
    windows = ends.select(*KEY, F.col("c_from.frame_index").alias("win_start"), F.col("c_end.frame_index").alias("win_end"))
    removed = PR.removed_events(ours, auto, pairs, spans, windows)
    return labelled.unionByName(rest.select(labelled.columns)), removed


def derive(inputs: Inputs, p: dict[str, Any], with_edits: bool = True, stage: dict[str, DataFrame] | None = None) -> Derived:
    """Derive the whole cohort. The cleaned frames are clustered by chunk of a track once; what reads them meets them there.

    ``stage`` is what ``clustered`` gave for the same inputs and parameters, if it is there already.
    """
    P.require_valid(p)
    with co_partitioned(inputs.frames.sparkSession):
        return _derive(inputs, p, with_edits, stage)


def _derive(inputs: Inputs, p: dict[str, Any], with_edits: bool, stage: dict[str, DataFrame] | None) -> Derived:
    size = chunk_frames(inputs.frames.sparkSession)
    stage = dict(clustered(inputs, p) if stage is None else stage)
    clean, geo = stage["clean"], stage["geometry"]
    stage["correction_spans"] = C.correction_spans(inputs.corrections)

    starts = materialise_plain(corrected_starts(T.trial_starts(clean, inputs.corrections)), "starts")
    cut = materialise_plain(T.cutoffs(clean, starts, p, size), "cut")
    stage["trial_pieces"] = materialise(E.trial_pieces(E.pieces(clean), cut, size), "pieces")
    stage["runs"] = materialise_plain(E.classify_runs(E.entry_runs(stage["trial_pieces"]), geo, p), "runs")
    runs = stage["runs"]
    stage["run_texts"] = EV.run_sentences(runs, EV.blob_trends(clean, runs))
    stage["bounds"] = materialise_plain(E.trial_bounds(cut, runs), "bounds")
    bounds = stage["bounds"]

    corrected = materialise_plain(detected(stage, bounds.filter(F.col("variant") == "c"), p), "events")
    labelled, removed = with_provenance(stage, corrected, bounds, False, p)
    stage["detected"] = corrected
    labelled = materialise_plain(labelled, "labelled")
    edits = EE.event_edits(inputs.corrections, clean, geo, stage["correction_spans"])
    if with_edits and not edits.isEmpty():
        edits = materialise_plain(edits, "edits")
        events, removed, bounds, edit_flags, corrected = edit_events(stage, labelled, removed, edits, cut, p)
    else:
        events = labelled.select(*KEY, *EE.COLUMNS)
        edit_flags = None
    removed = materialise_plain(removed, "removed")
    live = corrected.filter(F.col("variant") == "c")

    trial = K.trial_frames(clean, bounds, size)
    motion = materialise(K.motion(trial, p), "motion")
    kin = materialise_plain(K.kinematics(motion, trial, bounds, geo, p), "kinematics")
    phase = S.search_phase(bounds, events)
    seq = S.search_sequence(phase, events)
    feats = S.features(seq, S.centre_crossings(motion, seq, geo), K.tortuosity(motion, phase, geo), kin, geo)
    strategy = materialise_plain(S.classify(feats, geo, inputs.corrections, p), "strategy")
    scan = materialise_plain(
        Q.scan(clean.filter(F.col("variant") == "c"), Q.quality_windows(bounds), p, size), "scan"
    )
    gaps = Q.gaps(clean, scan, geo, size)
    quality = Q.report(scan, gaps, events, geo, p, inputs.index_drift)

    flags = materialise_plain(
        all_flags(inputs, stage, starts, runs, live, events, removed, edit_flags, bounds, scan, p), "flags"
    )
    confirmed = C.latest(inputs.corrections, "no_escape")
    counts = correction_counts(inputs.corrections, removed, live)
    metrics = M.metrics(
        inputs.videos, bounds, events, flags, kin, scan, strategy, confirmed, counts, p
    )
    return Derived(
        geo, clean, bounds, runs, events, removed, flags, trial, motion, kin, strategy, scan, gaps,
        quality, metrics, stage,
    )


def corrected_starts(starts: DataFrame) -> DataFrame:
    """Both variants of a video share the start that stands for the corrected one."""
    c = starts.filter(F.col("variant") == "c").select(*KEY, F.col("from").alias("c_from"))
    return starts.join(c, KEY).withColumn("from", F.col("c_from")).drop("c_from")


def edit_events(
    stage: dict[str, DataFrame], labelled: DataFrame, removed: DataFrame, edits: DataFrame, cut: DataFrame,
    p: dict[str, Any],
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Apply event corrections; where they move the end of a trial, detect again for that end.

    Each pass works only on the videos whose end moved, until none moves. Ends come from the starts of entries and
    the cutoff; a video that comes back to an end it had has no settled one, which is an error that names it.
    """
    clean, geo, bounds, corrected = stage["clean"], stage["geometry"], stage["bounds"], stage["detected"]
    named = edits.select(*KEY).distinct()
    others = labelled.join(named, KEY, "left_anti").select(*KEY, *EE.COLUMNS)
    early_flags = None

    def fold(events: DataFrame) -> tuple[DataFrame, DataFrame]:
        out, _ = EE.apply_event_edits(events, edits, clean, geo)
        return EE.split_edited(materialise_plain(out, "fold"), clean, geo)

    events, flags = fold(labelled)
    seen = bounds.filter(F.col("variant") == "c").join(named, KEY, "left_semi").select(*KEY, F.col("end.pos").alias("end_pos"), "end_reason")
    while True:
        last = bounds.filter(F.col("variant") == "c").select(
            *KEY, F.col("last.frame_index").alias("last_no"), F.col("from").alias("begin")
        )
        entries = events.join(last, KEY).filter(M.is_persistent(F.col("last_no"), p) & F.col("begin").isNotNull())
        before = entries.filter(F.col("start_pos") < F.col("begin.pos")).select(
            *KEY,
            F.lit("correction_out_of_range").alias("code"),
            F.format_string(
                "%s begins at frame %d, earlier than the trial (frame %d), so it ends nothing.",
                "event_id", "start_frame", F.col("begin.frame_index"),
            ).alias("message"),
            F.col("start_frame").alias("frame_index"), "event_id", F.lit(None).cast("string").alias("correction_id"),
        )
        early_flags = before if early_flags is None else early_flags.unionByName(before)
        first = entries.filter(F.col("start_pos") >= F.col("begin.pos")).groupBy(*KEY).agg(
            F.min_by(
                F.struct(F.col("start_pos").alias("pos"), F.col("start_t").alias("t"), F.col("start_frame").alias("frame_index")),
                "start_pos",
            ).alias("escape")
        )
        c = cut.filter(F.col("variant") == "c").join(named, KEY, "left_semi").join(first, KEY, "left")
        end, reason = T.resolve_end(F.col("escape"))
        was = bounds.filter(F.col("variant") == "c").select(*KEY, F.col("end.pos").alias("was_end"), F.col("end_reason").alias("was_reason"))
        moved = (
            c.withColumn("end", end).withColumn("end_reason", reason).drop("escape").join(was, KEY)
            .filter(F.col("end").isNotNull() & ((F.col("end.pos") != F.col("was_end")) | (F.col("end_reason") != F.col("was_reason"))))
            .drop("was_end", "was_reason")
        )
        moved = materialise_plain(moved, "moved")
        if moved.isEmpty():
            break
        ends = moved.select(*KEY, F.col("end.pos").alias("end_pos"), "end_reason")
        again = ends.join(seen, [*KEY, "end_pos", "end_reason"], "left_semi").limit(5).collect()
        if again:
            raise ValueError("event corrections leave no settled trial end for " + ", ".join(f"{r.session_id}/{r.video_id}" for r in again))
        seen = materialise_plain(seen.unionByName(ends), "seen-ends")
        key = moved.select(*KEY)
        bounds = materialise_plain(
            bounds.join(key.withColumn("variant", F.lit("c")), TRACK, "left_anti").unionByName(moved.select(bounds.columns)), "bounds"
        )
        again = materialise_plain(detected(stage, moved, p), "events")
        relabelled, gone = with_provenance(stage, again, moved, True, p)
        corrected = corrected.join(key, KEY, "left_anti").unionByName(again.select(corrected.columns))
        removed = removed.join(key, KEY, "left_anti").unionByName(gone.select(removed.columns))
        new_events, new_flags = fold(materialise_plain(relabelled, "labelled"))
        events = materialise_plain(events.join(key, KEY, "left_anti").unionByName(
            new_events.join(key, KEY, "left_semi")), "edited")
        flags = materialise_plain(flags.join(key, KEY, "left_anti").unionByName(new_flags.join(key, KEY, "left_semi")), "editflags")
    all_events = materialise_plain(others.unionByName(events), "edited")
    out_flags = flags if early_flags is None else flags.unionByName(early_flags.dropDuplicates([*KEY, "event_id"]))
    return all_events, removed, bounds, out_flags, corrected


def naming_edits(corrections: DataFrame) -> DataFrame:
    """Event corrections, confirmations left out, that name an event id."""
    return corrections.filter(
        (F.col("kind") == "event") & ~F.coalesce("confirmed", F.lit(False)) & F.col("event_id").isNotNull()
    ).select(*KEY, "event_id", "id", "timestamp", "action")


def removal_standing(removed: DataFrame, detected_: DataFrame, corrections: DataFrame) -> DataFrame:
    """Per removed event: whether another event carries its id, and which edits already name it."""
    carrier = detected_.select(*KEY, "event_id", F.lit(True).alias("carried"))
    naming = naming_edits(corrections).groupBy(*KEY, "event_id").agg(F.count(F.lit(1)).alias("named_by"))
    return (
        removed.join(carrier, [*KEY, "event_id"], "left")
        .join(naming, [*KEY, "event_id"], "left")
        .withColumn("counted", F.coalesce("carried", F.lit(False)) | F.col("named_by").isNull())
    )


def correction_counts(corrections: DataFrame, removed: DataFrame, detected_: DataFrame) -> DataFrame:
    """Corrections per video: all but confirmations, plus removals no edit already stands for."""
    own = corrections.filter(~((F.col("kind") == "event") & F.coalesce("confirmed", F.lit(False)))).select(*KEY)
    gone = removal_standing(removed, detected_, corrections).filter("counted").select(*KEY)
    return own.unionByName(gone).groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("correction_count"))


def all_flags(
    inputs: Inputs, stage: dict[str, DataFrame], starts: DataFrame, runs: DataFrame, detected_: DataFrame,
    events: DataFrame, removed: DataFrame, edit_flags: DataFrame | None, bounds: DataFrame, scan: DataFrame,
    p: dict[str, Any],
) -> DataFrame:
    """Every review flag of the cohort."""
    none = F.lit(None).cast("string")
    raised = EV.event_flags(detected_, runs, stage["geometry"]).select(*FLAG_COLUMNS)
    live = events.select(*KEY, "event_id", F.col("kind").alias("live_kind"))
    raised = raised.join(live, [*KEY, "event_id"]).filter(
        ~((F.col("code") == "physically_unlikely_entry") & (F.col("live_kind") == "tracking_failure"))
    ).select(*FLAG_COLUMNS)

    gone = removal_standing(removed, detected_, inputs.corrections)
    where = F.when(F.col("hole_index").isNull(), "away from any hole").otherwise(
        F.concat(F.lit("at hole "), F.col("hole_index").cast("string"))
    )
    standing = F.when(F.col("carried"), "its id now belongs to an event that absorbed it; counted as a correction").when(
        F.col("named_by").isNull(), "counted as a correction"
    ).otherwise("an event correction names it, so it is not counted again")
    removal = gone.select(
        *KEY,
        F.lit("auto_event_removed_by_correction").alias("code"),
        F.concat(
            F.lit("The automatic "), F.translate("kind", "_", " "), F.lit(" "), where,
            F.format_string(", frames %d–%d (%.2f–%.2f s), is not found once corrections (", "start_frame", "end_frame", "start_t", "end_t"),
            F.array_join("correction_ids", ", "), F.lit(") apply: "), standing, F.lit("."),
        ).alias("message"),
        F.col("start_frame").alias("frame_index"), "event_id", none.alias("correction_id"),
    )
    hand = scan.filter(F.col("oversized_in") > 0).select(
        *KEY,
        F.lit("oversized_in_trial").alias("code"),
        F.format_string(
            "%d frames inside the trial show an oversized foreground, the first at %.2f s.", "oversized_in", "oversized_t"
        ).alias("message"),
        F.col("oversized_frame").alias("frame_index"), none.alias("event_id"), none.alias("correction_id"),
    )
    parts = [
        C.out_of_range_flags(stage["edits"]), T.start_flags(starts), raised, removal, hand,
        escape_flags(inputs, events, bounds, p),
    ]
    if edit_flags is not None:
        parts.append(edit_flags)
    if inputs.auto_layers is not None:
        now = P.tracking_hash(p)
        parts.append(
            inputs.auto_layers.filter(F.col("tracking_parameters_hash") != now).select(
                *KEY,
                F.lit("stale_auto_layer").alias("code"),
                F.format_string(
                    "This track was produced with tracking parameters %s…, not the %s… in force now.",
                    F.substring("tracking_parameters_hash", 1, 8), F.lit(now[:8]),
                ).alias("message"),
                F.lit(None).cast("int").alias("frame_index"), none.alias("event_id"), none.alias("correction_id"),
            )
        )
    return reduce(DataFrame.unionByName, [d.select(*FLAG_COLUMNS) for d in parts])


def escape_flags(inputs: Inputs, events: DataFrame, bounds: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Corrections about the escape box that do not apply to a probe, or that the events contradict."""
    none = F.lit(None).cast("string")
    probe = inputs.videos.filter(F.col("trial_type") == "probe").select(*KEY)
    about_box = inputs.corrections.filter(
        ((F.col("kind") == "range") & (F.col("range_type") == "in_escape_box")) | (F.col("kind") == "no_escape")
    )
    orphan = about_box.join(probe, KEY, "left_semi").select(
        *KEY,
        F.lit("orphaned_correction").alias("code"),
        F.concat(F.lit("A probe trial has no escape box, so correction "), F.col("id"), F.lit(" does not apply.")).alias("message"),
        F.col("start_frame").alias("frame_index"), none.alias("event_id"), F.col("id").alias("correction_id"),
    )
    claim = C.latest(inputs.corrections, "no_escape").join(probe, KEY, "left_anti").select(
        *KEY, F.col("id").alias("correction_id"), F.col("reason_text").alias("because")
    )
    b = bounds.filter(F.col("variant") == "c").select(
        *KEY, F.col("last.frame_index").alias("last_no"), "end_reason", F.col("end.t").alias("trial_end_t")
    )
    entries = events.filter(F.col("kind") == "escape_entry").join(b, KEY)
    per = entries.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("entries"),
        F.bool_or(M.is_persistent(F.col("last_no"), p)).alias("persistent"),
        F.first("end_reason").alias("end_reason"),
        F.first("trial_end_t").alias("trial_end_t"),
        F.min("start_frame").alias("frame_index"),
        F.min_by("start_t", "start_frame").alias("first_t"),
    )
    contradicted = (F.col("end_reason") == "escape") | F.col("persistent")
    message = (
        F.when(F.col("end_reason") == "escape", F.format_string("An escape entry ends this trial at %.2f s, contradicting the confirmed non-escape", "trial_end_t"))
        .when(F.col("persistent"), F.format_string("A persistent escape entry at %.2f s, outside the trial, contradicts the confirmed non-escape", "first_t"))
        .otherwise(F.format_string("%d short escape entries, the first at %.2f s, stand beside the confirmed non-escape", "entries", "first_t"))
    )
    note = claim.join(per, KEY).select(
        *KEY,
        F.when(contradicted, "no_escape_contradicted").otherwise("non_persistent_entry_noted").alias("code"),
        F.concat(message, F.coalesce(F.concat(F.lit(' ("'), F.col("because"), F.lit('")')), F.lit("")), F.lit(".")).alias("message"),
        "frame_index", none.alias("event_id"), "correction_id",
    )
    return orphan.unionByName(note)
