"""Queries over the derived layer: geometry, cleaning, trial, events, measures, strategy, quality, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import cohort as C
from catalog import twin_derive as TD
from catalog.registry import query, rd, rp, srd, srp
from catalog.twin import CX, CY, PXCM, R, cte
from wayfare import params as P
from wayfare.functions import geometry as G
from wayfare.operators import clean as CL
from wayfare.operators import corrections as CO
from wayfare.operators import kinematics as K
from wayfare.operators import quality as Q
from wayfare.operators import strategy as S
from wayfare.operators.timeline import KEY
from wayfare.plans import derive as D
from wayfare.session import chunk_frames

V = "session_id, video_id"
JV = "JOIN (SELECT s AS vs, session_id, video_id FROM k_sup) vv ON vv.vs = q.s"


@query("frame_table", f"SELECT {V}, pos, frame_index, {srd('t_s', 't')}, {srp('x', 'x')}, {srp('y', 'y')}, c_valid, n_valid, state, reason FROM k_frames")
def frame_table(spark: SparkSession, sf: str) -> DataFrame:
    """The frame table itself: one row per frame of every track."""
    return C.inputs(spark, sf).frames.select(
        *KEY, "pos", "frame_index", rd("t_s").alias("t"), rp("centroid.x").alias("x"), rp("centroid.y").alias("y"),
        F.col("centroid.valid").alias("c_valid"), F.col("nose.valid").alias("n_valid"),
        F.col("detection_state").alias("state"), "reason",
    )


@query(
    "geometry_bundle",
    f"""SELECT {V}, target::INT AS target, 20 AS n_holes, {srd(PXCM, 'px_per_cm')}, {srd(str(TD.HR), 'hole_r_px')},
    {srd(TD.INV_PX, 'inv_px')}, {srd(TD.ESC_PX, 'esc_px')}, {srd(f'{R} * 0.89', 'ring_px')}, {srd('(deg % 360 + 360) % 360', 'sector_deg', 4)},
    {srd('2.5 * 360 / 20', 'sector_half')}, {srd(f'0.5 * {R}', 'centre_zone_px')} FROM k_videos JOIN k_sector USING (s, target)""",
)
def geometry_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Geometry of every video: map placed, target resolved, radii converted."""
    g = C.clean(spark, sf)["geometry"]
    return g.select(
        *KEY, "target", "n_holes", rd("px_per_cm").alias("px_per_cm"), rd("hole_r_px").alias("hole_r_px"),
        rd("inv_px").alias("inv_px"), rd("esc_px").alias("esc_px"), rd("ring_px").alias("ring_px"),
        rd("sector_deg", 4).alias("sector_deg"), rd("sector_half").alias("sector_half"),
        rd("centre_zone_px").alias("centre_zone_px"),
    )


@query(
    "geometry_nearest_hole",
    f"""SELECT {V}, pos, nearest AS hole_index, {srd(f'near_px / {PXCM}', 'distance_cm', 4)} FROM k_clean q {JV} WHERE v = 'c' AND c_valid""",
)
def geometry_nearest_hole(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest hole and distance of the event point of every positioned frame."""
    st = C.clean(spark, sf)
    return (
        C.final(st["clean"]).filter("c_valid").join(st["geometry"].select(*KEY, "px_per_cm"), KEY)
        .select(*KEY, "pos", F.col("nearest").alias("hole_index"), rd(F.col("near_px") / F.col("px_per_cm"), 4).alias("distance_cm"))
    )


@query(
    "geometry_zones",
    f"""SELECT {V}, count(*) FILTER (WHERE sqrt((x - {CX}) ** 2 + (y - {CY}) ** 2) <= {R}) AS on_platform,
    count(*) FILTER (WHERE sqrt((x - {CX}) ** 2 + (y - {CY}) ** 2) < 0.5 * {R}) AS in_centre,
    count(*) FILTER (WHERE {TD._in_sector}) AS in_sector, count(*) AS positioned
    FROM k_clean q JOIN k_sector USING (s) {JV} WHERE v = 'c' AND c_valid GROUP BY {V}""",
)
def geometry_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Positioned frames on the platform, in the centre zone and in the target sector."""
    st = C.clean(spark, sf)
    df = C.final(st["clean"]).filter("c_valid").join(st["geometry"], KEY)
    d = G.length(F.col("x") - F.col("pcx"), F.col("y") - F.col("pcy"))
    sector = G.in_sector(F.col("pcx"), F.col("pcy"), F.col("sector_deg"), F.col("sector_half"), F.col("x"), F.col("y"))
    return df.groupBy(*KEY).agg(
        F.count_if(d <= F.col("pr")).alias("on_platform"), F.count_if(d < F.col("centre_zone_px")).alias("in_centre"),
        F.count_if(sector).alias("in_sector"), F.count(F.lit(1)).alias("positioned"),
    )


@query("timebase_nominal_dt", f"SELECT {V}, {srd('nominal', 'nominal_dt', 9)} FROM k_nominal q {JV}")
def timebase_nominal_dt(spark: SparkSession, sf: str) -> DataFrame:
    """Midpoint median of the positive stamp differences."""
    flat = CO.flat_frames(C.inputs(spark, sf).frames, chunk_frames(spark))
    return CL.nominal_dt(flat, KEY).select(*KEY, rd("nominal_dt", 9).alias("nominal_dt"))


@query("timebase_report", f"SELECT {V}, duplicates AS duplicate_timestamp_count, drops AS dropped_frame_gap_count, {srd('drift', 'drift_s')} FROM k_quality q {JV}")
def timebase_report(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicate and dropped stamps of the whole clip and the drift from first to last stamp."""
    d = C.derived(spark, sf).quality
    return d.select(*KEY, "duplicate_timestamp_count", "dropped_frame_gap_count", rd("drift_s").alias("drift_s"))


@query(
    "clean_outliers",
    f"SELECT {V}, v AS variant, pos, frame_index FROM k_clean q {JV} WHERE outlier",
)
def clean_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Velocity outliers, in the corrected and the automatic tracks."""
    return C.clean(spark, sf)["clean"].filter("outlier").select(*KEY, "variant", "pos", "frame_index")


@query(
    "clean_gap_runs",
    f"""SELECT {V}, gap_start AS start_frame, gap_end AS end_frame, frames, CASE WHEN gap_start > lo AND gap_end < hi THEN round(dur, 6) + 0.0::DOUBLE END AS duration_s,
    'disabled' AS reason FROM (SELECT s, min(frame_index) AS gap_start, max(frame_index) AS gap_end, count(*) AS frames, any_value(n0) AS lo, any_value(n1) AS hi,
      max(aft) - min(bef) AS dur FROM (SELECT *, pos - row_number() OVER (PARTITION BY s ORDER BY pos) AS g FROM
       (SELECT s, pos, frame_index, seen_raw, lag(t) OVER w AS bef, lead(t) OVER w AS aft, min(frame_index) OVER (PARTITION BY s) AS n0, max(frame_index) OVER (PARTITION BY s) AS n1
        FROM k_clean WHERE v = 'c' WINDOW w AS (PARTITION BY s ORDER BY pos)) WHERE NOT seen_raw) GROUP BY s, g) q {JV}""",
)
def clean_gap_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of unpositioned frames before outlier marking, bounded or not, with why they were not filled."""
    c = C.final(C.clean(spark, sf)["clean"]).withColumn("gap", F.coalesce(F.col("prev_ok.pos"), F.lit(-1)))
    runs = c.filter(~F.col("seen_raw")).groupBy(*KEY, "gap").agg(
        F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"), F.count(F.lit(1)).alias("frames"),
        F.max("prev_ok.t").alias("bt"), F.first("unfilled").alias("reason"),
    )
    after = c.filter(F.col("seen_raw") & (F.col("gap") < F.col("pos") - 1)).select(*KEY, "gap", F.col("t").alias("at"))
    return runs.join(after, [*KEY, "gap"], "left").select(
        *KEY, "start_frame", "end_frame", "frames", rd(F.col("at") - F.col("bt")).alias("duration_s"), "reason"
    )


@query(
    "clean_report",
    f"""SELECT {V}, count(*) FILTER (WHERE outlier) AS outlier_frames, 0::BIGINT AS filled_frames, count(*) FILTER (WHERE NOT seen_raw) AS unfilled_frames
    FROM k_clean q {JV} WHERE v = 'c' GROUP BY {V}""",
)
def clean_report(spark: SparkSession, sf: str) -> DataFrame:
    return C.final(C.clean(spark, sf)["clean"]).groupBy(*KEY).agg(
        F.count_if("outlier").alias("outlier_frames"), F.count_if("filled").alias("filled_frames"),
        F.count_if(F.col("unfilled").isNotNull()).alias("unfilled_frames"),
    )


_fill_sql = f"""
SELECT {V}, pos, {srp('fx', 'x')}, {srp('fy', 'y')} FROM (
 SELECT s, pos, a.x + (CASE WHEN z.t - a.t > 0 THEN (t - a.t) / (z.t - a.t) ELSE 0.5 END) * (z.x - a.x) AS fx,
        a.y + (CASE WHEN z.t - a.t > 0 THEN (t - a.t) / (z.t - a.t) ELSE 0.5 END) * (z.y - a.y) AS fy
 FROM (SELECT s, pos, t, seen_raw,
   last_value(CASE WHEN seen_raw THEN {{'t': t, 'x': x, 'y': y, 'o': outlier, 'p': pos, 'near': dn <= {TD.HR}}} END IGNORE NULLS) OVER (PARTITION BY s ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
   first_value(CASE WHEN seen_raw THEN {{'t': t, 'x': x, 'y': y, 'o': outlier, 'p': pos, 'near': dn <= {TD.HR}}} END IGNORE NULLS) OVER (PARTITION BY s ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z,
   max(CASE WHEN c_hand THEN pos END) OVER (PARTITION BY s ORDER BY pos) AS hl, min(CASE WHEN c_hand THEN pos END) OVER (PARTITION BY s ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hr
  FROM (SELECT c.*, (SELECT min(sqrt((c.x - hx) ** 2 + (c.y - hy) ** 2)) FROM k_holes) AS dn FROM k_clean0 c WHERE v = 'c'))
 WHERE NOT seen_raw AND a IS NOT NULL AND z IS NOT NULL AND NOT a.o AND NOT z.o AND NOT coalesce(hl > a.p, false) AND NOT coalesce(hr < z.p, false)
   AND z.t - a.t <= 0.7 AND NOT a.near AND NOT z.near) q {JV}
"""


@query("clean_gap_fill", _fill_sql)
def clean_gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Frames filled by linear interpolation in time when filling is on."""
    p = C.params(gapFilling__enabled=True, gapFilling__maxDuration_s=0.7)
    c = D.cleaned(C.inputs(spark, sf), p)["clean"]
    return C.final(c).filter("filled").select(*KEY, "pos", rp("x").alias("x"), rp("y").alias("y"))


@query(
    "trial_window",
    f"""SELECT {V}, e.from_no AS start_frame, {srd('e.from_t', 'start_t')}, e.end_no AS end_frame, {srd('e.end_t', 'end_t')}, e.end_reason,
    CASE WHEN hand_start THEN 'corrected' ELSE 'auto' END AS start_source, lo.last_oversized
    FROM k_ends q JOIN k_ends e ON e.s = q.s AND e.v = 'c' JOIN k_cut c ON c.s = q.s AND c.v = 'c'
    LEFT JOIN (SELECT f.s, max(pos) AS last_oversized FROM k_clean f JOIN k_cut t ON t.s = f.s AND t.v = 'c' WHERE f.v = 'c' AND f.reason = 'oversized_blob' AND f.pos < coalesce(t.auto_pos, t.n) GROUP BY f.s) lo ON lo.s = q.s
    {JV} WHERE q.v = 'c'""",
)
def trial_window(spark: SparkSession, sf: str) -> DataFrame:
    """Start, end and end reason of every trial."""
    b = C.final(C.derived(spark, sf).bounds)
    return b.select(
        *KEY, F.col("from.frame_index").alias("start_frame"), rd("from.t").alias("start_t"),
        F.col("end.frame_index").alias("end_frame"), rd("end.t").alias("end_t"), "end_reason", "start_source", "last_oversized",
    )


@query(
    "trial_window_short_cutoff",
    f"""SELECT {V}, c.from_no AS start_frame, x.frame_index AS cutoff_frame, cp < c.n - 1 AS cut_short FROM
    (SELECT k.s, k.n, k.from_no, (SELECT max(pos) FROM k_clean c WHERE c.s = k.s AND c.v = 'c' AND c.t <= k.from_t + 7 + 1e-9) AS cp FROM k_cut k WHERE v = 'c') c
    LEFT JOIN k_clean x ON x.s = c.s AND x.v = 'c' AND x.pos = cp JOIN (SELECT s AS vs, session_id, video_id FROM k_sup) vv ON vv.vs = c.s""",
)
def trial_window_short_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """The cutoff frame under a 7 s cutoff, which most clips exceed."""
    from wayfare.operators import trial as T

    st = C.clean(spark, sf)
    starts = T.trial_starts(C.final(st["clean"]), C.inputs(spark, sf).corrections)
    cut = T.cutoffs(C.final(st["clean"]), starts, C.params(trialCutoff_s=7), chunk_frames(spark))
    return cut.select(
        *KEY, F.col("from.frame_index").alias("start_frame"), F.col("cut.frame_index").alias("cutoff_frame"),
        (F.col("cut.pos") < F.col("n") - 1).alias("cut_short"),
    )


@query(
    "event_points",
    f"""SELECT {V}, pos, use_nose, {srp('ex', 'ex')}, {srp('ey', 'ey')}, hole_at, partial_at FROM k_clean q {JV} WHERE v = 'c' AND c_valid""",
)
def event_points(spark: SparkSession, sf: str) -> DataFrame:
    """The event point of every positioned frame and the hole it is at."""
    return C.final(C.clean(spark, sf)["clean"]).filter("c_valid").select(
        *KEY, "pos", "use_nose", rp("ex").alias("ex"), rp("ey").alias("ey"), "hole_at", "partial_at"
    )


@query(
    "event_entry_runs",
    f"""SELECT {V}, v AS variant, start_no AS start_frame, end_no AS end_frame, partial_hole, partial_frames, absent_frames, hole, outcome, persistent, to_end,
    event_hole, {srd('duration', 'duration_s')}, back_same AS reappears_near FROM k_runs q {JV}""",
)
def event_entry_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of absent or partial frames and what each of them is."""
    r = C.derived(spark, sf).runs
    return r.select(
        *KEY, "variant", F.col("start.frame_index").alias("start_frame"), F.col("end.frame_index").alias("end_frame"),
        "partial_hole", "partial_frames", "absent_frames", "hole", "outcome", "persistent", "to_end", "event_hole",
        rd("duration").alias("duration_s"), F.col("back_same").alias("reappears_near"),
    )


@query(
    "event_visits",
    f"""SELECT {V}, v AS variant, kind, hole AS hole_index, event_id, start_no AS start_frame, end_no AS end_frame, {srd('duration_s', 'duration_s')}, point_used,
    {srd('min_nose_cm', 'min_nose_cm', 4)}, {srd('min_centroid_cm', 'min_centroid_cm', 4)}, nose_frames, centroid_frames, bouts FROM k_ev q {JV} WHERE v = 'c'""",
)
def event_visits(spark: SparkSession, sf: str) -> DataFrame:
    """Every detected event of the corrected tracks with its distances."""
    e = C.derived(spark, sf).stages["detected"]
    return e.select(
        *KEY, "variant", "kind", "hole_index", "event_id", "start_frame", "end_frame", rd("duration_s").alias("duration_s"), "point_used",
        rd("min_nose_cm", 4).alias("min_nose_cm"), rd("min_centroid_cm", 4).alias("min_centroid_cm"), "nose_frames", "centroid_frames", "bouts",
    )


@query("event_evidence", f"SELECT {V}, event_id, evidence FROM k_evc q {JV}")
def event_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence behind every detected event."""
    return C.derived(spark, sf).stages["detected"].select(*KEY, "event_id", "evidence")


@query(
    "event_provenance",
    f"""SELECT {V}, event_id, kind, source, evidence_corrected, correction_ids, auto_hole AS auto_hole_index, auto_lo AS auto_start_frame, auto_hi AS auto_end_frame
    FROM k_events q {JV}""",
)
def event_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Which events rest on corrections, and what the automatic track said."""
    e = C.derived(spark, sf).events
    return e.select(
        *KEY, "event_id", "kind", "source", "evidence_corrected", F.array_join("correction_ids", ";").alias("correction_ids"),
        F.col("auto_shadow.hole_index").alias("auto_hole_index"), F.col("auto_shadow.start_frame").alias("auto_start_frame"),
        F.col("auto_shadow.end_frame").alias("auto_end_frame"),
    )


@query("event_removed", f"SELECT {V}, event_id, kind, hole AS hole_index, start_no AS start_frame, end_no AS end_frame, correction_ids FROM k_removed q {JV}")
def event_removed(spark: SparkSession, sf: str) -> DataFrame:
    """Automatic events the corrected detection no longer finds."""
    r = C.derived(spark, sf).removed
    return r.select(*KEY, "event_id", "kind", "hole_index", "start_frame", "end_frame", F.array_join("correction_ids", ";").alias("correction_ids"))


@query("review_flags", f"SELECT {V}, code, frame_index, event_id, correction_id FROM k_flags q {JV}")
def review_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every review flag of the cohort."""
    return C.derived(spark, sf).flags.select(*KEY, "code", "frame_index", "event_id", "correction_id")


@query(
    "corrections_applied_frames",
    f"""SELECT {V}, pos, {srp('x', 'x')}, {srp('y', 'y')}, c_valid, n_valid, state, reason, c_hand, n_hand FROM k_corrected q {JV} WHERE c_hand OR n_hand""",
)
def corrections_applied_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames changed by point and range corrections, last writer per field."""
    i, size = C.inputs(spark, sf), chunk_frames(spark)
    spans = CO.track_spans(i.frames)
    fields = CO.edited_fields(CO.frame_edits(i.corrections, i.frames, spans), size)
    out = CO.apply_frame_edits(CO.flat_frames(i.frames, size), fields)
    hand = lambda c: F.col(c) == "corrected"
    return out.filter(hand("c_src") | hand("n_src")).select(
        *KEY, "pos", rp("x").alias("x"), rp("y").alias("y"), "c_valid", "n_valid", "state", "reason",
        hand("c_src").alias("c_hand"), hand("n_src").alias("n_hand"),
    )


@query(
    "corrections_out_of_range",
    f"""SELECT {V}, id AS correction_id, lo_no AS frame_index FROM (SELECT s, id, lo_no FROM k_edits e WHERE NOT EXISTS (SELECT 1 FROM k_edits_ok o WHERE o.s = e.s AND o.id = e.id)) q {JV}""",
)
def corrections_out_of_range(spark: SparkSession, sf: str) -> DataFrame:
    i = C.inputs(spark, sf)
    return CO.out_of_range_flags(CO.frame_edits(i.corrections, i.frames, CO.track_spans(i.frames))).select(*KEY, "correction_id", "frame_index")


@query(
    "kinematics_trial",
    f"""SELECT {V}, {srd('trial_s', 'trial_s')}, {srd('path_cm', 'path_cm', 4)}, {srd('path_smoothed_cm', 'path_smoothed_cm', 4)}, {srd('tracked_time_s', 'tracked_time_s')},
    {srd('gap_time_s', 'gap_time_s')}, {srd('sector_time_s', 'sector_time_s')}, {srd('mean_speed_cm_s', 'mean_speed_cm_s', 4)}, {srd('path_efficiency', 'path_efficiency', 4)},
    duplicate_pairs, dropped_pairs FROM k_kin q {JV}""",
)
def kinematics_trial(spark: SparkSession, sf: str) -> DataFrame:
    """Path, times, speed and stamp anomalies of each trial."""
    k = C.derived(spark, sf).kinematics
    return k.select(
        *KEY, rd("trial_s").alias("trial_s"), rd("path_cm", 4).alias("path_cm"), rd("path_smoothed_cm", 4).alias("path_smoothed_cm"),
        rd("tracked_time_s").alias("tracked_time_s"), rd("gap_time_s").alias("gap_time_s"), rd("sector_time_s").alias("sector_time_s"),
        rd("mean_speed_cm_s", 4).alias("mean_speed_cm_s"), rd("path_efficiency", 4).alias("path_efficiency"), "duplicate_pairs", "dropped_pairs",
    )


@query("kinematics_smoothed", f"SELECT {V}, pos, {srp('sx', 'sx')}, {srp('sy', 'sy')} FROM k_motion q {JV}")
def kinematics_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    """The median-filtered path."""
    return C.derived(spark, sf).motion.select(*KEY, "pos", rp("sx").alias("sx"), rp("sy").alias("sy"))


_speed_sql = f"""
SELECT {V}, pos, {srd(f"CASE WHEN kept >= 2 AND kt - t0 > 0 THEN path / {PXCM} / (kt - t0) END", "speed_cm_s", 4)} FROM (
 SELECT s, pos, f.path, f.kt, f.kept, arr[1].t AS t0 FROM (
  SELECT s, pos, arr, list_reduce(arr[2:], lambda acc, e: CASE WHEN e.t - acc.pt >= dup
     THEN {{'path': acc.path + sqrt((e.x - acc.kx) ** 2 + (e.y - acc.ky) ** 2), 'kt': e.t, 'kx': e.x, 'ky': e.y, 'pt': e.t, 'kept': acc.kept + 1}}
     ELSE {{'path': acc.path, 'kt': acc.kt, 'kx': acc.kx, 'ky': acc.ky, 'pt': e.t, 'kept': acc.kept}} END,
     {{'path': 0.0::DOUBLE, 'kt': arr[1].t, 'kx': arr[1].x, 'ky': arr[1].y, 'pt': arr[1].t, 'kept': 1}}) AS f
  FROM (SELECT m.s, m.pos, {TD.KIN['duplicateTimestampFactor']} * any_value(m.nominal) AS dup, list({{'t': o.t, 'x': o.sx, 'y': o.sy}} ORDER BY o.pos) AS arr
        FROM (SELECT *, pos - row_number() OVER (PARTITION BY s ORDER BY pos) AS g FROM k_motion) m
        JOIN (SELECT *, pos - row_number() OVER (PARTITION BY s ORDER BY pos) AS g FROM k_motion) o ON o.s = m.s AND o.g = m.g AND o.pos BETWEEN m.pos - 2 AND m.pos + 2
        GROUP BY m.s, m.pos))) q {JV}
"""


@query("kinematics_frame_speed", _speed_sql)
def kinematics_frame_speed(spark: SparkSession, sf: str) -> DataFrame:
    """Speed of every positioned frame over its neighbours of the same run."""
    d = C.derived(spark, sf)
    return K.frame_speed(d.motion, d.geometry, C.params()).select(*KEY, "pos", rd("speed_cm_s", 4).alias("speed_cm_s"))


_tort_sql = f"""
SELECT {V}, {srd("coalesce(f.total, 0)", "tortuosity_rad", 4)} FROM (
 SELECT p.s, f FROM k_phase p LEFT JOIN (
 SELECT s, list_reduce(pts, lambda acc, e: CASE
    WHEN acc.ax IS NULL OR e.p <> acc.last + 1 THEN {{'ax': e.x, 'ay': e.y, 'h': acc.h, 'total': acc.total, 'last': e.p}}
    WHEN sqrt((e.x - acc.ax) ** 2 + (e.y - acc.ay) ** 2) < {PXCM} THEN {{'ax': acc.ax, 'ay': acc.ay, 'h': acc.h, 'total': acc.total, 'last': e.p}}
    ELSE {{'ax': e.x, 'ay': e.y, 'h': atan2(e.y - acc.ay, e.x - acc.ax),
      'total': acc.total + coalesce(least(abs(atan2(e.y - acc.ay, e.x - acc.ax) - acc.h), 2 * pi() - abs(atan2(e.y - acc.ay, e.x - acc.ax) - acc.h)), 0.0), 'last': e.p}} END,
    {{'ax': NULL::DOUBLE, 'ay': NULL::DOUBLE, 'h': NULL::DOUBLE, 'total': 0.0::DOUBLE, 'last': -2}}) AS f
 FROM (SELECT m.s, list({{'p': m.pos::INT, 'x': sx, 'y': sy}} ORDER BY m.pos) AS pts FROM k_motion m JOIN k_phase p ON p.s = m.s AND m.pos <= p.phase_end GROUP BY m.s)) t ON t.s = p.s) q {JV}
"""


cte("k_tort", _tort_sql.replace(f"SELECT {V}, {srd('coalesce(f.total, 0)', 'tortuosity_rad', 4)}", "SELECT q.s, coalesce(f.total, 0) AS tort").replace(f"q {JV}", "q"))


@query("strategy_tortuosity", _tort_sql)
def strategy_tortuosity(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative heading change over the search phase."""
    st = C.derived(spark, sf).strategy
    return st.filter(F.col("errors").isNotNull()).select(*KEY, rd("tortuosity_rad", 4).alias("tortuosity_rad"))


@query(
    "strategy_features",
    f"""SELECT {V}, errors, max_hole_distance, centre_crossings, longest_run::INT AS longest_run, coalesce(array_to_string(best, '>'), '') AS longest_run_holes,
    array_to_string(list_transform(seq, lambda e: e.hole), '>') AS sequence, reached AS target_reached FROM k_class q {JV} WHERE errors IS NOT NULL""",
)
def strategy_features(spark: SparkSession, sf: str) -> DataFrame:
    """The features the strategy rules read."""
    st = C.derived(spark, sf).strategy.filter(F.col("errors").isNotNull())
    join = lambda c: F.array_join(F.transform(c, lambda h: h.cast("string")), ">")
    return st.select(
        *KEY, "errors", "max_hole_distance", "centre_crossings", "longest_run", join("longest_run_holes").alias("longest_run_holes"),
        join("sequence").alias("sequence"), "target_reached",
    )


@query(
    "strategy_class",
    f"""SELECT {V}, auto_strategy, runner_up, CASE WHEN overridden THEN 'serial' ELSE auto_strategy END AS strategy,
    CASE WHEN overridden THEN 'corrected' ELSE 'auto' END AS strategy_source FROM k_class q {JV}""",
)
def strategy_class(spark: SparkSession, sf: str) -> DataFrame:
    return C.derived(spark, sf).strategy.select(*KEY, "auto_strategy", "runner_up", "strategy", "strategy_source")


_st = TD._st
_yes = lambda c: f"CASE WHEN {c} THEN 'yes' ELSE 'no' END"
_verdict = lambda name: f"CASE WHEN auto_strategy = '{name}' THEN 'fired' WHEN {name} THEN 'fired, outranked by ' || auto_strategy ELSE 'did not fire' END"
_over = """CASE WHEN overridden THEN 'By hand (correction so-' || s || '): serial — seen on video. Found by rule: ' || auto_strategy || '.' END"""
_reason_sql = f"""
WITH t AS (SELECT c.s, list_filter(CASE WHEN auto_strategy = 'unclassified' THEN [CASE WHEN errors IS NULL THEN 'No class: the trial has no start.' ELSE 'No class: the trial has neither an investigation nor a target visit.' END, {_over}]
 ELSE [CASE WHEN NOT reached THEN 'The target was never reached, so the class covers the whole trial window.' END,
  'Over the search phase (to ' || CASE WHEN reached THEN 'the first target visit' ELSE 'the trial end; the target was never reached' END || '): ' || errors || ' error' || CASE WHEN errors = 1 THEN '' ELSE 's' END
   || ', holes visited ' || CASE WHEN len(seq) > 0 THEN array_to_string(list_transform(seq, lambda e: e.hole), '→') ELSE 'none' END || ', farthest from the target ' || max_hole_distance || ', longest adjacent run ' || longest_run
   || ', centre crossings ' || centre_crossings || ', path efficiency ' || coalesce(printf('%.2f', path_efficiency), 'n/a') || ', heading change ' || coalesce(printf('%.2f rad', tort), 'n/a') || '.',
  'spatial ' || {_verdict('spatial')} || ': ' || CASE WHEN reached AND errors = 0 THEN 'direct approach — yes' ELSE 'errors at most {_st['spatialMaxErrors']} — ' || {_yes(f"errors <= {_st['spatialMaxErrors']}")}
   || '; hole distance at most {_st['spatialMaxHoleDistance']} — ' || {_yes(f"max_hole_distance <= {_st['spatialMaxHoleDistance']}")} || '; centre crossings at most {_st['spatialMaxCentreCrossings']} — ' || {_yes(f"centre_crossings <= {_st['spatialMaxCentreCrossings']}")} END || '.',
  'serial ' || {_verdict('serial')} || ': adjacent run at least {_st['serialMinRun']} — ' || {_yes('serial')} || '.', 'Classified as ' || auto_strategy || '; runner-up ' || runner_up || '.', {_over}] END, lambda x: x IS NOT NULL) AS lines
 FROM k_class c LEFT JOIN k_tort USING (s))
SELECT {V}, i::INT AS line, lines[i + 1] AS sentence FROM (SELECT s, lines, unnest(range(len(lines))) AS i FROM t) q {JV}
"""


@query("strategy_reasoning", _reason_sql)
def strategy_reasoning(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences behind each class, one row per sentence."""
    r = S.reasoning(C.derived(spark, sf).strategy, C.params())
    return r.select(*KEY, F.posexplode("reasoning").alias("line", "sentence"))


@query(
    "metrics_trial",
    f"""SELECT {V}, {srd('trial_start_s', 'trial_start_s')}, {srd('primary_latency_s', 'primary_latency_s')}, {srd('total_latency_s', 'total_latency_s')}, primary_errors, total_errors,
    strategy, strategy_source, escaped, no_escape_confirmed, status, {srd('tracked_fraction', 'tracked_fraction')}, correction_count FROM k_metrics""",
)
def metrics_trial(spark: SparkSession, sf: str) -> DataFrame:
    """Latencies, errors, escape, status and correction count of each trial."""
    m = C.derived(spark, sf).metrics
    return m.select(
        *KEY, rd("trial_start_s").alias("trial_start_s"), rd("primary_latency_s").alias("primary_latency_s"), rd("total_latency_s").alias("total_latency_s"),
        "primary_errors", "total_errors", "strategy", "strategy_source", "escaped", "no_escape_confirmed", "status",
        rd("tracked_fraction").alias("tracked_fraction"), "correction_count",
    )


@query(
    "errors_per_group",
    """SELECT coalesce(grp, 'ungrouped') AS group_name, count(*) AS trials, sum(total_errors)::BIGINT AS total_errors,
    round(avg(total_errors), 6) + 0.0::DOUBLE AS mean_errors FROM k_metrics m JOIN k_videos v ON v.s = m.s WHERE total_errors IS NOT NULL GROUP BY 1""",
)
def errors_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """Errors per trial in each group: the flagship query."""
    v = C.inputs(spark, sf).videos.select(*KEY, F.coalesce("group", F.lit("ungrouped")).alias("group_name"))
    return (
        C.derived(spark, sf).metrics.filter(F.col("total_errors").isNotNull()).join(v, KEY).groupBy("group_name")
        .agg(F.count(F.lit(1)).alias("trials"), F.sum("total_errors").alias("total_errors"), rd(F.avg("total_errors")).alias("mean_errors"))
    )


@query(
    "quality_report",
    f"""SELECT {V}, {', '.join(srd(f'{x}_fraction', f'{x}_fraction') for x in P.STATES)}, {srd('positioned_fraction', 'positioned_fraction')},
    {srd('whole_clip_positioned_fraction', 'whole_clip_positioned_fraction')}, {srd('nose_judged_fraction', 'nose_judged_fraction')}, gap_count, {srd('longest_gap_s', 'longest_gap_s')}, tier FROM k_quality q {JV}""",
)
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    q = C.derived(spark, sf).quality
    return q.select(
        *KEY, *[rd(f"{x}_fraction").alias(f"{x}_fraction") for x in P.STATES], rd("positioned_fraction").alias("positioned_fraction"),
        rd("whole_clip_positioned_fraction").alias("whole_clip_positioned_fraction"), rd("nose_judged_fraction").alias("nose_judged_fraction"),
        "gap_count", rd("longest_gap_s").alias("longest_gap_s"), "tier",
    )


@query("quality_gaps", f"SELECT {V}, start_no AS start_frame, end_no AS end_frame, {srd('duration_s', 'duration_s')}, location_class, hole_index FROM k_gaps q {JV}")
def quality_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps of the corrected, uncleaned track by place."""
    return C.derived(spark, sf).gaps.select(*KEY, "start_frame", "end_frame", rd("duration_s").alias("duration_s"), "location_class", "hole_index")


@query(
    "quality_nose_histogram",
    f"""SELECT {V}, b AS bin, {srd('b / 5.0::DOUBLE', 'bin_min')}, {srd('(b + 1) / 5.0::DOUBLE', 'bin_max')},
    CASE b WHEN 0 THEN nose_bin_0 WHEN 1 THEN nose_bin_1 WHEN 2 THEN nose_bin_2 WHEN 3 THEN nose_bin_3 ELSE nose_bin_4 END AS frames
    FROM k_scan q CROSS JOIN (SELECT unnest(range(5))::INT AS b) {JV}""",
)
def quality_nose_histogram(spark: SparkSession, sf: str) -> DataFrame:
    h = Q.nose_histogram(C.derived(spark, sf).scan)
    return h.select(*KEY, "bin", rd("bin_min").alias("bin_min"), rd("bin_max").alias("bin_max"), "frames")


