"""Queries over the exported tables, the cohort, the figures and the review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import cohort as C
from catalog import twin_derive as TD
from catalog.derived import JV, V
from catalog.registry import query, rd, srd
from catalog.twin import CX, CY, PXCM, R, cte
from wayfare import params as P
from wayfare.operators import cohort as CH
from wayfare.operators import figures as FG
from wayfare.operators import gold as GX
from wayfare.operators import metrics as M
from wayfare.operators import review as RV
from wayfare.operators.timeline import KEY
from wayfare.session import chunk_frames
from catalog import benchmark as B

h3 = lambda x, n: f"{TD.half_up(x, 3)} AS {n}"
h2 = lambda x, n: f"{TD.half_up(x, 2)} AS {n}"
HASH = P.parameters_hash(P.DEFAULTS)
_names = "'Cohort ' || substr(v.session_id, 9) AS session_name"
_stamp = f"'0.1' AS tool_version, 2 AS schema_version, '{HASH}' AS parameters_hash"

cte(
    "k_gold_trials",
    f"""SELECT v.session_id, {_names}, v.video_id, animal, day, trial AS trial_label, grp AS "group", trial_type, target::INT AS target_hole,
    {h3('trial_start_s', 'trial_start_s')}, {h3('primary_latency_s', 'primary_latency_s')}, {h3('total_latency_s', 'total_latency_s')}, primary_errors, total_errors,
    {h2('path_cm', 'path_length_cm')}, {h2('path_smoothed_cm', 'path_length_smoothed_cm')}, {h2('mean_speed_cm_s', 'mean_speed_cm_per_s')}, {h3('sector_time_s', 'target_quadrant_time_s')},
    strategy, strategy_source, escaped, no_escape_confirmed, CASE WHEN no_escape_confirmed THEN confirmed_by END AS no_escape_confirmed_by, status,
    coalesce(codes, '') AS review_flags, round(tracked_fraction, 9) AS tracked_fraction, correction_count,
    {', '.join(f"{float(P.get(P.DEFAULTS, path))}::DOUBLE AS {c}" for c, path in GX.THRESHOLDS.items())}, {_stamp}
    FROM k_videos v JOIN k_metrics m ON m.s = v.s LEFT JOIN (SELECT s, string_agg(DISTINCT code, ';' ORDER BY code) AS codes FROM k_flags GROUP BY s) f ON f.s = v.s""",
)
cte(
    "k_reviewers",
    """SELECT s, event_id, list_distinct_ordered AS reviewer FROM (
    SELECT s, event_id, array_to_string(list_reduce(list(reviewer ORDER BY late, ts, id), lambda acc, e: CASE WHEN list_contains(acc, e) THEN acc ELSE list_append(acc, e) END, []::VARCHAR[]), ';') AS list_distinct_ordered
    FROM (SELECT e.s, e.event_id, 0 AS late, c.ts, c.id, c.reviewer FROM k_events e JOIN k_corr c ON c.s = e.s AND list_contains(string_split(e.correction_ids, ';'), c.id)
          UNION ALL SELECT e.s, e.event_id, 1, c.ts, c.id, c.reviewer FROM k_events e JOIN k_corr c ON c.s = e.s AND c.kind = 'event' AND c.what = 'add' AND 'user-' || c.id = e.event_id)
    WHERE reviewer IS NOT NULL GROUP BY s, event_id)""",
)
cte(
    "k_gold_events",
    f"""SELECT v.session_id, {_names}, v.video_id, trial AS trial_label, e.event_id, kind, hole AS hole_index, is_target, start_no AS start_frame, end_no AS end_frame,
    {h3('start_t', 'start_time_s')}, {h3('end_t', 'end_time_s')}, {h3(f"{TD.half_up('end_t', 3)} - {TD.half_up('start_t', 3)}", 'duration_s')}, point_used,
    {h2('min_nose_cm', 'min_nose_distance_cm')}, {h2('min_centroid_cm', 'min_centroid_distance_cm')}, evidence AS evidence_summary, source, evidence_corrected, correction_ids,
    false AS confirmed, reviewer, auto_hole AS auto_hole_index, auto_lo AS auto_start_frame, auto_hi AS auto_end_frame, {_stamp}
    FROM k_events e JOIN k_videos v ON v.s = e.s LEFT JOIN k_reviewers r ON r.s = e.s AND r.event_id = e.event_id""",
)
cte(
    "k_gold_quality",
    f"""SELECT v.session_id, {_names}, v.video_id, {', '.join(f'round({s}_fraction, 9) AS {s}_fraction' for s in P.STATES)}, round(positioned_fraction, 9) AS positioned_fraction,
    round(whole_clip_positioned_fraction, 9) AS whole_clip_positioned_fraction, round(nose_judged_fraction, 9) AS nose_judged_event_fraction, gap_count,
    {h3('longest_gap_s', 'longest_gap_s')}, duplicates AS duplicate_timestamp_count, drops AS dropped_frame_gap_count, {h3('drift', 'drift_s')}, {B.DIAMETER_CM}::DOUBLE AS platform_diameter_cm,
    round({PXCM}, 9) AS px_per_cm, tier, {_stamp} FROM k_videos v JOIN k_quality q ON q.s = v.s""",
)


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    return B.sessions(spark, sf)


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    d, i = C.derived(spark, sf), C.inputs(spark, sf)
    return GX.trial_rows(i.videos, _sessions(spark, sf), d.geometry, d.metrics, d.flags, i.corrections, C.params())


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return GX.quality_rows(C.inputs(spark, sf).videos, _sessions(spark, sf), C.derived(spark, sf).quality, C.params())


def _round9(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c.endswith("fraction") or c == "px_per_cm" else F.col(c) for c in df.columns])


@query("gold_trials", "SELECT * FROM k_gold_trials")
def gold_trials(spark: SparkSession, sf: str) -> DataFrame:
    """The exported trial table, 41 columns."""
    return _round9(_trials(spark, sf))


@query("gold_events", "SELECT * FROM k_gold_events")
def gold_events(spark: SparkSession, sf: str) -> DataFrame:
    """The exported event table, 28 columns."""
    i = C.inputs(spark, sf)
    return GX.event_rows(i.videos, _sessions(spark, sf), C.derived(spark, sf).events, i.corrections, C.params())


@query("gold_quality", "SELECT * FROM k_gold_quality")
def gold_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The exported quality table, 21 columns."""
    return _round9(_quality(spark, sf))


@query(
    "gold_manifest",
    """SELECT 'trials' AS output, count(*) AS row_count FROM k_gold_trials UNION ALL SELECT 'events', count(*) FROM k_gold_events UNION ALL SELECT 'quality', count(*) FROM k_gold_quality""",
)
def gold_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per exported table."""
    from wayfare.sources import exports

    return exports.manifest({"trials": _trials(spark, sf), "events": C.derived(spark, sf).events, "quality": _quality(spark, sf)})


@query(
    "gold_event_reviewers",
    f"SELECT {V}, event_id, reviewer FROM k_reviewers q {JV}",
)
def gold_event_reviewers(spark: SparkSession, sf: str) -> DataFrame:
    """Who stands behind each event."""
    return GX.event_reviewers(C.derived(spark, sf).events, C.inputs(spark, sf).corrections)


_pt = " UNION ALL ".join(
    f"SELECT v.s, v.session_id, v.video_id, animal, coalesce(grp, 'ungrouped') AS g, coalesce(day, '') AS day, coalesce(trial, '') AS trial, status, '{m}' AS measure, {c}::DOUBLE AS value FROM k_videos v JOIN k_metrics k ON k.s = v.s WHERE animal IS NOT NULL"
    for m, c in {
        "primary_latency_s": "primary_latency_s", "total_latency_s": "total_latency_s", "primary_errors": "primary_errors", "total_errors": "total_errors",
        "path_length_cm": "path_cm", "path_length_smoothed_cm": "path_smoothed_cm", "mean_speed_cm_per_s": "mean_speed_cm_s", "target_quadrant_time_s": "sector_time_s",
    }.items()
)
cte("k_points", f"SELECT *, CASE WHEN value IS NOT NULL THEN NULL WHEN status = 'unresolved' THEN 'unresolved' ELSE 'no_value' END AS excluded FROM ({_pt})")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return CH.points(C.inputs(spark, sf).videos, C.derived(spark, sf).metrics)


@query("cohort_points", f"""SELECT session_id, video_id, animal, g AS "group", day, trial, measure, {srd('value', 'value', 5)}, excluded FROM k_points""")
def cohort_points(spark: SparkSession, sf: str) -> DataFrame:
    """Every measure of every trial, with why a value is missing."""
    return _points(spark, sf).select(*KEY, "animal", "group", "day", "trial", "measure", rd("value", 5).alias("value"), "excluded")


@query(
    "cohort_captions",
    """SELECT session_id, measure, printf('n = %d of %d', count(value), count(*)) || CASE WHEN count(*) FILTER (WHERE excluded = 'unresolved') > 0 THEN printf('; %d unresolved', count(*) FILTER (WHERE excluded = 'unresolved')) ELSE '' END
    || CASE WHEN count(*) FILTER (WHERE excluded = 'no_value') > 0 THEN printf('; %d without value', count(*) FILTER (WHERE excluded = 'no_value')) ELSE '' END AS caption FROM k_points GROUP BY session_id, measure""",
)
def cohort_captions(spark: SparkSession, sf: str) -> DataFrame:
    return CH.captions(_points(spark, sf), ["session_id", "measure"]).select("session_id", "measure", "caption")


@query(
    "cohort_learning_curve",
    f"""WITH a AS (SELECT session_id, measure, CASE WHEN count(DISTINCT nullif(day, '')) > 1 THEN 'day' ELSE 'trial' END AS x_axis FROM k_points GROUP BY ALL),
    p AS (SELECT k.*, x_axis, coalesce(nullif(CASE WHEN x_axis = 'day' THEN day ELSE trial END, ''), '—') AS x_label FROM k_points k JOIN a USING (session_id, measure)),
    l AS (SELECT session_id, measure, x_label, (row_number() OVER (PARTITION BY session_id, measure ORDER BY try_cast(x_label AS DOUBLE) IS NULL, try_cast(x_label AS DOUBLE), x_label) - 1)::INT AS x FROM (SELECT DISTINCT session_id, measure, x_label FROM p))
    SELECT session_id, measure, x_axis, animal, x_label, x, {srd('avg(value)', 'value', 5)}, count(value) AS n FROM p JOIN l USING (session_id, measure, x_label) GROUP BY session_id, measure, x_axis, animal, x_label, x""",
)
def cohort_learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of each measure per animal and day (or trial)."""
    c = CH.learning_curve(_points(spark, sf))
    return c.select("session_id", "measure", "x_axis", "animal", "x_label", "x", rd("value", 5).alias("value"), "n")


@query(
    "cohort_group_comparison",
    f"""SELECT session_id, measure, g AS "group", count(value) AS n, {srd('coalesce(avg(value), 0)', 'mean', 5)}, {srd('coalesce(stddev_samp(value), 0)', 'sd', 5)}, count(*) - count(value) AS missing FROM k_points GROUP BY session_id, measure, g""",
)
def cohort_group_comparison(spark: SparkSession, sf: str) -> DataFrame:
    g = CH.group_comparison(_points(spark, sf))
    return g.select("session_id", "measure", "group", "n", rd("mean", 5).alias("mean"), rd("sd", 5).alias("sd"), "missing")


@query(
    "cohort_ok_and_all",
    f"""SELECT measure, g AS "group", 'all' AS trials, count(value) AS n, {srd('avg(value)', 'mean', 5)}, {srd('coalesce(stddev_samp(value), 0)', 'sd', 5)} FROM k_points GROUP BY measure, g
    UNION ALL SELECT measure, g, 'ok', count(value) FILTER (WHERE status = 'ok'), round(avg(value) FILTER (WHERE status = 'ok'), 5) + 0.0::DOUBLE, round(coalesce(stddev_samp(value) FILTER (WHERE status = 'ok'), 0), 5) + 0.0::DOUBLE FROM k_points GROUP BY measure, g""",
)
def cohort_ok_and_all(spark: SparkSession, sf: str) -> DataFrame:
    d = CH.ok_and_all(_points(spark, sf))
    return d.select("measure", "group", "trials", "n", rd("mean", 5).alias("mean"), rd("sd", 5).alias("sd"))


@query(
    "cohort_strategy_breakdown",
    """SELECT coalesce(grp, 'ungrouped') AS "group", coalesce(day, '—') AS day, strategy_source, count(*) FILTER (WHERE strategy = 'spatial') AS spatial, count(*) FILTER (WHERE strategy = 'serial') AS serial,
    count(*) FILTER (WHERE strategy = 'random') AS random, count(*) FILTER (WHERE strategy = 'unclassified') AS unclassified FROM k_videos v JOIN k_metrics m ON m.s = v.s GROUP BY 1, 2, 3""",
)
def cohort_strategy_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return CH.strategy_breakdown(C.inputs(spark, sf).videos, C.derived(spark, sf).metrics)


@query(
    "cohort_quality_triage",
    f"""SELECT {V}, CASE tier WHEN 'POOR' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END AS rank, tier, {srd('positioned_fraction', 'positioned_fraction')},
    CASE WHEN greatest(not_detected_fraction, ambiguous_fraction, low_confidence_fraction) = 0 THEN 'none' WHEN not_detected_fraction = greatest(not_detected_fraction, ambiguous_fraction, low_confidence_fraction) THEN 'not_detected'
      WHEN ambiguous_fraction = greatest(not_detected_fraction, ambiguous_fraction, low_confidence_fraction) THEN 'ambiguous' ELSE 'low_confidence' END AS reason, {srd('longest_gap_s', 'longest_gap_s')} FROM k_quality q {JV}""",
)
def cohort_quality_triage(spark: SparkSession, sf: str) -> DataFrame:
    """Videos worst first with the reason, ordered by tier and positioned fraction."""
    t = CH.quality_triage(C.derived(spark, sf).quality)
    return t.orderBy("rank", "positioned_fraction").select(
        *KEY, "rank", "tier", rd("positioned_fraction").alias("positioned_fraction"), "reason", rd("longest_gap_s").alias("longest_gap_s")
    )


@query(
    "cohort_correction_share",
    """SELECT coalesce(grp, 'ungrouped') AS "group", count(*) AS trials, count(*) FILTER (WHERE strategy_source = 'corrected') AS strategies_set_by_hand, count(*) FILTER (WHERE correction_count > 0) AS trials_with_corrections,
    sum(correction_count)::BIGINT AS corrections, coalesce(sum(n), 0)::BIGINT AS events, coalesce(sum(nc), 0)::BIGINT AS corrected_events, coalesce(sum(ne), 0)::BIGINT AS evidence_corrected, 0::BIGINT AS confirmed
    FROM k_videos v JOIN k_metrics m ON m.s = v.s LEFT JOIN (SELECT s, count(*) AS n, count(*) FILTER (WHERE source = 'corrected') AS nc, count(*) FILTER (WHERE evidence_corrected) AS ne FROM k_events GROUP BY s) e ON e.s = v.s GROUP BY 1""",
)
def cohort_correction_share(spark: SparkSession, sf: str) -> DataFrame:
    d = C.derived(spark, sf)
    return CH.correction_share(C.inputs(spark, sf).videos, d.metrics, d.events)


@query(
    "cohort_why_different",
    """WITH t AS (SELECT session_id, count(*) FILTER (WHERE status = 'ok') || '/' || count(*) FILTER (WHERE status = 'review') || '/' || count(*) FILTER (WHERE status = 'unresolved') AS st,
      sum(correction_count) || '/' || count(*) FILTER (WHERE strategy_source = 'corrected') AS co FROM k_gold_trials GROUP BY session_id),
    q AS (SELECT session_id, count(*) FILTER (WHERE tier = 'GOOD') || '/' || count(*) FILTER (WHERE tier = 'REVIEW') || '/' || count(*) FILTER (WHERE tier = 'POOR') || '/' || round(avg(positioned_fraction), 6) AS qu FROM k_gold_quality GROUP BY session_id),
    p AS (SELECT * FROM t JOIN q USING (session_id))
    SELECT a.session_id AS session_a, b.session_id AS session_b, CASE WHEN a.qu <> b.qu THEN 'quality' WHEN a.st <> b.st THEN 'status' WHEN a.co <> b.co THEN 'corrections' ELSE 'none' END AS first_difference
    FROM p a JOIN p b ON b.session_id = 'session-' || ((substr(a.session_id, 9)::INT + 1) % 3)""",
)
def cohort_why_different(spark: SparkSession, sf: str) -> DataFrame:
    """For neighbouring cohorts, the first of the ordered checks at which they differ."""
    profile = CH.cohort_profile(_trials(spark, sf), _quality(spark, sf))
    nxt = F.concat(F.lit("session-"), ((F.substring("session_id", 9, 10).cast("int") + 1) % 3).cast("string"))
    pairs = _sessions(spark, sf).select(F.col("session_id").alias("session_a"), nxt.alias("session_b"))
    return CH.why_cohorts_differ(profile, pairs)


# figures
cte("k_path", "SELECT * FROM k_clean WHERE v = 'c' AND c_valid")


def _path(spark: SparkSession, sf: str) -> DataFrame:
    return FG.path(C.clean(spark, sf)["clean"])


cte(
    "k_occ",
    f"""SELECT s, "row", col, count(*) AS frames, sum(greatest(0, own)) AS seconds FROM (SELECT s,
      least(span - 1, greatest(0, floor(((y - {CY}) / {PXCM} + {R} / {PXCM}) / 2.5)))::INT AS "row", least(span - 1, greatest(0, floor(((x - {CX}) / {PXCM} + {R} / {PXCM}) / 2.5)))::INT AS col,
      CASE WHEN lead(frame_index) OVER w = frame_index + 1 THEN lead(t) OVER w - t WHEN lag(frame_index) OVER w = frame_index - 1 THEN t - lag(t) OVER w ELSE 0 END AS own
      FROM (SELECT *, greatest(1, ceil(2 * {R} / {PXCM} / 2.5)) AS span FROM k_path) WINDOW w AS (PARTITION BY s ORDER BY pos)) GROUP BY s, "row", col""",
)


@query("figure_occupancy", f"""SELECT {V}, "row", col AS "column", frames, {srd('seconds', 'seconds')} FROM k_occ q {JV}""")
def figure_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    """Frames and seconds per 2.5 cm cell."""
    o = FG.occupancy(_path(spark, sf), C.clean(spark, sf)["geometry"], 2.5)
    return o.select(*KEY, "row", "column", "frames", rd("seconds").alias("seconds"))


@query(
    "figure_busiest_cell",
    f"""SELECT {V}, b['row'] AS "row", b['col'] AS "column", round(b['sec'], 6) + 0.0::DOUBLE AS seconds FROM (SELECT s, arg_max({{'row': "row", 'col': col, 'sec': seconds}}, (round(seconds, 9), -"row", -col)) AS b FROM k_occ WHERE seconds > 0 GROUP BY s) q {JV}""",
)
def figure_busiest_cell(spark: SparkSession, sf: str) -> DataFrame:
    o = FG.occupancy(_path(spark, sf), C.clean(spark, sf)["geometry"], 2.5)
    return FG.busiest(o).select(*KEY, "row", "column", rd("seconds").alias("seconds"))


@query(
    "figure_path_runs",
    f"""SELECT {V}, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS frames FROM (SELECT *, frame_index - row_number() OVER (PARTITION BY s ORDER BY pos) AS g FROM k_path) q {JV} GROUP BY {V}, g""",
)
def figure_path_runs(spark: SparkSession, sf: str) -> DataFrame:
    return FG.path_runs(_path(spark, sf))


cte(
    "k_state_runs",
    """SELECT s, any_value(state) AS state, min(frame_index) AS start_no, max(frame_index) AS end_no, min(t) AS start_t, max(t) AS end_t, count(*) AS frames
    FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY pos) - row_number() OVER (PARTITION BY s, state ORDER BY pos) AS g FROM k_clean WHERE v = 'c') GROUP BY s, state, g""",
)


@query("figure_state_runs", f"SELECT {V}, state, start_no AS start_frame, end_no AS end_frame, {srd('start_t', 'start_t')}, {srd('end_t', 'end_t')}, frames FROM k_state_runs q {JV}")
def figure_state_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = FG.state_runs(C.clean(spark, sf)["clean"])
    return r.select(*KEY, "state", "start_frame", "end_frame", rd("start_t").alias("start_t"), rd("end_t").alias("end_t"), "frames")


@query("figure_hole_raster", f"SELECT {V}, hole AS hole_index, is_target, kind, {srd('start_t', 'start_t')}, {srd('duration_s', 'duration_s')}, source FROM k_events q {JV} WHERE kind <> 'tracking_failure' AND hole IS NOT NULL")
def figure_hole_raster(spark: SparkSession, sf: str) -> DataFrame:
    r = FG.hole_raster(C.derived(spark, sf).events)
    return r.select(*KEY, "hole_index", "is_target", "kind", rd("start_t").alias("start_t"), rd("duration_s").alias("duration_s"), "source")


@query(
    "figure_sector_counts",
    f"""SELECT {V}, count(*) FILTER (WHERE NOT (x = {CX} AND y = {CY}) AND least({TD._ang}, 360 - {TD._ang}) <= 45) AS inside, count(*) AS positions FROM k_path q JOIN k_sector USING (s) {JV} GROUP BY {V}""",
)
def figure_sector_counts(spark: SparkSession, sf: str) -> DataFrame:
    return FG.sector_counts(_path(spark, sf), C.clean(spark, sf)["geometry"])


cte(
    "k_speed",
    f"""SELECT s, pos, CASE WHEN t1 - t0 > 0 THEN d / {PXCM} / (t1 - t0) ELSE 0 END AS speed FROM (SELECT s, pos, max(t) OVER f AS t1, min(t) OVER f AS t0,
      coalesce(sum(step) OVER (PARTITION BY s ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), 0) - CASE WHEN rn = 1 THEN 0 ELSE 0 END AS d
      FROM (SELECT s, pos, t, row_number() OVER w AS rn, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM k_path WINDOW w AS (PARTITION BY s ORDER BY pos))
      WINDOW f AS (PARTITION BY s ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))""",
)


@query("figure_display_speed", f"SELECT {V}, pos, {srd('speed', 'speed_cm_s', 4)} FROM k_speed q {JV}")
def figure_display_speed(spark: SparkSession, sf: str) -> DataFrame:
    """Speed along the path, across gaps."""
    s = FG.display_speed(_path(spark, sf), C.clean(spark, sf)["geometry"], C.params(), chunk_frames(spark))
    return s.select(*KEY, "pos", rd("speed_cm_s", 4).alias("speed_cm_s"))


@query(
    "figure_speed_distribution",
    f"""SELECT {V}, count(*) AS positions, round(list_sort(list(speed))[(floor(0.5 * (count(*) - 1) + 0.5) + 1)::INT], 4) + 0.0::DOUBLE AS median_cm_s,
    round(list_sort(list(speed))[(floor(0.95 * (count(*) - 1) + 0.5) + 1)::INT], 4) + 0.0::DOUBLE AS p95_cm_s, {srd('max(speed)', 'fastest_cm_s', 4)},
    {srd('any_value(mean_speed_cm_s)', 'mean_cm_s', 4)} FROM k_speed q {JV} LEFT JOIN (SELECT s AS ms, mean_speed_cm_s FROM k_metrics) m ON m.ms = q.s GROUP BY {V}""",
)
def figure_speed_distribution(spark: SparkSession, sf: str) -> DataFrame:
    s = FG.display_speed(_path(spark, sf), C.clean(spark, sf)["geometry"], C.params(), chunk_frames(spark))
    d = FG.speed_distribution(s, C.derived(spark, sf).metrics)
    return d.select(*KEY, "positions", rd("median_cm_s", 4).alias("median_cm_s"), rd("p95_cm_s", 4).alias("p95_cm_s"), rd("fastest_cm_s", 4).alias("fastest_cm_s"), rd("mean_cm_s", 4).alias("mean_cm_s"))


@query(
    "figure_quartile_places",
    f"""SELECT {V}, place, {srd('t', 't')}, (SELECT arg_min(k, ((x - hx) * (x - hx) + (y - hy) * (y - hy), k)) FROM k_holes) AS hole_index FROM (
    SELECT p.*, place FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM k_path) p
    JOIN (VALUES ('start', 0.0::DOUBLE), ('25%', 0.25), ('50%', 0.5), ('75%', 0.75), ('last seen', 1.0)) z(place, f) ON p.i = floor(f * (n - 1))) q {JV}""",
)
def figure_quartile_places(spark: SparkSession, sf: str) -> DataFrame:
    q = FG.quartile_places(_path(spark, sf), C.clean(spark, sf)["geometry"], chunk_frames(spark))
    return q.select(*KEY, "place", rd("t").alias("t"), "hole_index")


@query(
    "figure_trajectory",
    f"""SELECT {V}, coalesce(np, 0) AS positions, 0::BIGINT AS filled, coalesce(nr, 0) AS runs, {srd('path_cm', 'path_length_cm', 4)} FROM (SELECT m.s, np, nr, path_cm FROM k_metrics m
    LEFT JOIN (SELECT s, count(*) AS np, count(DISTINCT g) AS nr FROM (SELECT s, frame_index - row_number() OVER (PARTITION BY s ORDER BY pos) AS g FROM k_path) GROUP BY s) c ON c.s = m.s) q {JV}""",
)
def figure_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    p = _path(spark, sf)
    t = FG.trajectory(p, FG.path_runs(p), C.derived(spark, sf).metrics)
    return t.select(*KEY, "positions", "filled", "runs", rd("path_length_cm", 4).alias("path_length_cm"))


@query(
    "figure_trial_labels",
    f"""SELECT {V}, coalesce(nullif(concat_ws(' · ', nullif(animal, ''), 'day ' || nullif(day, ''), 'trial ' || nullif(trial, '')), ''), filename) AS label FROM k_videos""",
)
def figure_trial_labels(spark: SparkSession, sf: str) -> DataFrame:
    return C.inputs(spark, sf).videos.select(*KEY, FG.trial_label(C.inputs(spark, sf).videos).alias("label"))


# review
cte(
    "k_queue",
    """SELECT *, row_number() OVER (PARTITION BY s ORDER BY start_no, event_id) - 1 AS place FROM (SELECT e.s, e.event_id, e.kind, e.start_no FROM k_events e WHERE source <> 'corrected'
    AND (EXISTS (SELECT 1 FROM k_flags f WHERE f.s = e.s AND f.event_id = e.event_id) OR EXISTS (SELECT 1 FROM k_state_runs r WHERE r.s = e.s AND r.state <> 'tracked' AND r.end_no >= e.start_no AND r.start_no <= e.end_no)))""",
)


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    d = C.derived(spark, sf)
    return RV.events_to_check(d.events, d.flags, FG.state_runs(d.clean))


@query("review_queue", f"SELECT {V}, event_id, kind, start_no AS start_frame, place FROM k_queue q {JV}")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Events a reviewer should look at, in order."""
    return _queue(spark, sf)


@query(
    "review_queue_steps",
    f"""SELECT {V}, event_id, coalesce(lead(event_id) OVER w, first_value(event_id) OVER u) AS next_id, coalesce(lag(event_id) OVER w, last_value(event_id) OVER u) AS previous_id FROM k_queue q {JV}
    WINDOW w AS (PARTITION BY s ORDER BY place), u AS (PARTITION BY s ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def review_queue_steps(spark: SparkSession, sf: str) -> DataFrame:
    return RV.queue_steps(_queue(spark, sf))


@query(
    "review_flagged_runs",
    f"""SELECT {V}, start_frame, end_frame, reason FROM (SELECT r.s, greatest(lo, start_no) AS start_frame, least(hi, end_no) AS end_frame, replace(state, '_', ' ') AS reason FROM k_state_runs r
    JOIN (SELECT e.s, coalesce(from_no, off) AS lo, coalesce(end_no, off + e.n - 1) AS hi FROM k_ends e JOIN k_sup k ON k.s = e.s WHERE v = 'c') w ON w.s = r.s WHERE state <> 'tracked' AND end_no >= lo AND start_no <= hi
    UNION ALL SELECT s, frame_index, frame_index, code FROM k_flags WHERE frame_index IS NOT NULL) q {JV}""",
)
def review_flagged_runs(spark: SparkSession, sf: str) -> DataFrame:
    d = C.derived(spark, sf)
    return RV.flagged_runs(FG.state_runs(d.clean), d.flags, d.bounds)


@query(
    "review_spans_at_frame",
    f"""SELECT {V}, a.frame_index, e.event_id FROM k_clean a JOIN k_events e ON e.s = a.s AND a.frame_index BETWEEN e.start_no AND e.end_no JOIN k_sup q ON q.s = a.s WHERE a.v = 'c'""",
)
def review_spans_at_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The events at every frame of the cohort."""
    d = C.derived(spark, sf)
    frames = C.final(d.clean).select(*KEY, "frame_index")
    return RV.spans_at(frames, d.events, ["event_id"]).select(*KEY, "frame_index", "event_id")


@query(
    "review_next_spans",
    f"""SELECT {V}, a.fi AS frame_index, (SELECT arg_min(event_id, (start_no, event_id)) FROM k_events e WHERE e.s = a.s AND start_no > a.fi) AS next_id,
    (SELECT arg_max(event_id, (start_no, event_id)) FROM k_events e WHERE e.s = a.s AND start_no < a.fi) AS previous_id
    FROM (SELECT DISTINCT s, frame_index AS fi FROM k_flags WHERE frame_index IS NOT NULL) a JOIN k_sup q ON q.s = a.s""",
)
def review_next_spans(spark: SparkSession, sf: str) -> DataFrame:
    """From every flagged frame, the next and the previous event."""
    d = C.derived(spark, sf)
    asked = d.flags.filter(F.col("frame_index").isNotNull()).select(*KEY, "frame_index").distinct()
    return RV.next_spans(asked, d.events, "event_id")


@query(
    "review_correction_marks",
    f"""SELECT {V}, id, kind, a AS start_frame, coalesce(z, a) AS end_frame FROM (SELECT c.s, c.id, c.kind, CASE WHEN c.kind = 'strategy_override' THEN coalesce(k.from_pos, 0) WHEN c.kind = 'event' THEN coalesce(e.start_no, lo_no, CASE WHEN what = 'delete' THEN 1 END) ELSE lo_no END AS a,
    CASE WHEN c.kind = 'event' THEN coalesce(e.end_no, hi_no) WHEN c.kind = 'range' THEN hi_no END AS z FROM k_corr c LEFT JOIN k_cut k ON k.s = c.s AND k.v = 'c' LEFT JOIN k_events e ON e.s = c.s AND e.event_id = 'user-' || c.id WHERE c.kind <> 'no_escape') q {JV}""",
)
def review_correction_marks(spark: SparkSession, sf: str) -> DataFrame:
    d = C.derived(spark, sf)
    return RV.correction_marks(C.inputs(spark, sf).corrections, d.events, d.bounds)


@query(
    "review_event_wording",
    f"""SELECT {V}, event_id, CASE WHEN kind = 'escape_entry' THEN CASE WHEN source = 'corrected' AND auto_lo IS NOT NULL THEN 'Escape entry, edited' WHEN source = 'corrected' THEN 'Escape entry, marked' ELSE 'Escape entry, inferred' END
    WHEN kind = 'tracking_failure' THEN 'Tracking failure' ELSE 'Investigation' END AS wording FROM k_events q {JV}""",
)
def review_event_wording(spark: SparkSession, sf: str) -> DataFrame:
    return RV.event_wording(C.derived(spark, sf).events, C.inputs(spark, sf).corrections)


@query(
    "review_ending_entry",
    f"""SELECT {V}, arg_min(event_id, start_no) AS event_id, min(start_no) AS start_frame FROM k_in_trial q JOIN k_bounds b ON b.s = q.s AND b.v = 'c' {JV} WHERE kind = 'escape_entry' AND (last_pos = b.n - 1 OR duration_s >= 3) GROUP BY {V}""",
)
def review_ending_entry(spark: SparkSession, sf: str) -> DataFrame:
    d = C.derived(spark, sf)
    return RV.ending_entry(M.events_in_trial(d.events, d.bounds), d.bounds, C.params())


_why = {
    "escaped": ("escaped", "not available for this trial"), "primary_latency_s": ("primary_latency_s", "target not reached"),
    "total_latency_s": ("total_latency_s", "no ending entry"), "primary_errors": ("primary_errors", "not available for this trial"),
    "total_errors": ("total_errors", "not available for this trial"), "path_length_cm": ("path_cm", "not available for this trial"),
    "mean_speed_cm_per_s": ("mean_speed_cm_s", "no tracked time in the trial"), "tracked_fraction": ("tracked_fraction", "not available for this trial"),
}


@query(
    "review_unavailable",
    " UNION ALL ".join(
        f"""SELECT m.session_id, m.video_id, '{n}' AS measure, CASE {"WHEN trial_type = 'probe' THEN 'probe trials end without a box'" if n in ('escaped', 'total_latency_s') else ''}
        WHEN status = 'unresolved' THEN 'no trial start could be found' ELSE '{w}' END AS reason FROM k_metrics m JOIN k_videos v ON v.s = m.s WHERE {c} IS NULL"""
        for n, (c, w) in _why.items()
    ),
)
def review_unavailable(spark: SparkSession, sf: str) -> DataFrame:
    return RV.unavailable(C.derived(spark, sf).metrics, C.inputs(spark, sf).videos)


@query(
    "review_event_counts",
    f"""SELECT {V}, count(*) FILTER (WHERE kind = 'investigation') AS investigations, count(*) FILTER (WHERE kind = 'escape_entry') AS escape_entries, count(*) FILTER (WHERE kind = 'tracking_failure') AS tracking_failures FROM k_events q {JV} GROUP BY {V}""",
)
def review_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return RV.event_counts(C.derived(spark, sf).events)


@query(
    "review_event_deltas",
    f"""SELECT {V}, kind, count(*) FILTER (WHERE a_s IS NULL) AS added, count(*) FILTER (WHERE b_s IS NULL) AS removed, count(*) FILTER (WHERE a_s <> b_s OR a_e <> b_e) AS retimed FROM
    (SELECT coalesce(a.s, b.s) AS s, coalesce(b.kind, a.kind) AS kind, a.start_no AS a_s, a.end_no AS a_e, b.start_no AS b_s, b.end_no AS b_e
     FROM (SELECT * FROM k_ev_text WHERE v = 'a') a FULL OUTER JOIN (SELECT * FROM k_events WHERE s IN (SELECT s FROM k_edits)) b ON b.s = a.s AND b.event_id = a.event_id) q {JV}
    GROUP BY {V}, kind HAVING count(*) FILTER (WHERE a_s IS NULL OR b_s IS NULL OR a_s <> b_s OR a_e <> b_e) > 0""",
)
def review_event_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Events the corrections added, removed and re-timed, against the automatic analysis of the edited videos."""
    d = C.derived(spark, sf)
    auto = d.stages["auto_events"]
    both = d.stages["edits"].select(*KEY).distinct()
    return RV.event_deltas(auto, d.events.join(both, KEY, "left_semi"))


@query(
    "review_readiness",
    """SELECT v.session_id, count(*) AS videos, count(*) AS maze_set, count(*) AS tracked, count(*) AS analysed, 0::BIGINT AS not_analysed FROM k_videos v JOIN k_metrics m ON m.s = v.s GROUP BY 1""",
)
def review_readiness(spark: SparkSession, sf: str) -> DataFrame:
    i = C.inputs(spark, sf)
    return RV.readiness(i.videos, i.frames.select(*KEY), C.derived(spark, sf).metrics, i.maze_maps)


@query(
    "review_frame_ranges",
    """SELECT s AS supplier, array_to_string(list_transform(list_reduce(list_sort([{'a': least(s * 7 % 50, s * 11 % 90)::BIGINT, 'z': greatest(s * 7 % 50, s * 11 % 90)::BIGINT}, {'a': (s % 60)::BIGINT, 'z': (s % 60)::BIGINT}, {'a': (100 + s % 5)::BIGINT, 'z': 120::BIGINT}]),
    lambda acc, e: CASE WHEN len(acc) > 0 AND e.a <= acc[len(acc)].z + 1 THEN list_append(acc[:len(acc) - 1], {'a': acc[len(acc)].a, 'z': greatest(acc[len(acc)].z, e.z)}) ELSE list_append(acc, e) END, []::STRUCT(a BIGINT, z BIGINT)[]), lambda r: r.a || '-' || r.z), ', ') AS ranges FROM k_sup""",
)
def review_frame_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of frame ranges parsed, joined and written again."""
    s = F.col("s")
    text = F.format_string("%d-%d, %d; %d .. 120", s * 7 % 50, s * 11 % 90, s % 60, 100 + s % 5)
    return B.suppliers(spark, sf).select(s.alias("supplier"), RV.format_ranges(RV.parse_ranges(text)).alias("ranges"))




@query(
    "review_metric_changes",
    """WITH m AS (SELECT session_id, video_id, path_cm, total_errors, status, video_id[2:]::INT AS n FROM k_metrics)
    SELECT session_id, video_id, 'path_length_cm' AS measure, printf('%.1f', path_cm) AS "before", printf('%.1f', path_cm + 7) AS "after" FROM m WHERE n % 5 = 1 AND path_cm IS NOT NULL
    UNION ALL SELECT session_id, video_id, 'total_errors', total_errors::VARCHAR, '—' FROM m WHERE n % 7 = 2 AND total_errors IS NOT NULL
    UNION ALL SELECT session_id, video_id, 'status', status, 'ok' FROM m WHERE n % 4 = 3 AND status <> 'ok'""",
)
def review_metric_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Measures that read differently between two analyses: the second has some paths, errors and states changed by rule."""
    before = C.derived(spark, sf).metrics
    n = F.substring("video_id", 2, 12).cast("int")
    after = (
        before.withColumn("path_length_cm", F.when(n % 5 == 1, F.col("path_length_cm") + 7).otherwise(F.col("path_length_cm")))
        .withColumn("total_errors", F.when(n % 7 != 2, F.col("total_errors")))
        .withColumn("status", F.when(n % 4 == 3, "ok").otherwise(F.col("status")))
    )
    return RV.metric_changes(before, after)
