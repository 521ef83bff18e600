"""The SQL twin of the derived layer: edits, cleaning, events, provenance, measures and quality."""

from __future__ import annotations

from wayfare import params as P
from catalog.twin import CX, CY, PXCM, R, cte
from catalog import benchmark as B

D = P.DEFAULTS
INV = D["holeInvestigation"]
ESC = D["escapeEntry"]
KIN = D["kinematics"]
HR = B.HOLE_RADIUS_PX
INV_PX = f"({INV['radiusFactor']} * {HR})"
ESC_PX = f"({ESC['radiusFactor']} * {HR})"
_z = B.zone_points()


def half_up(x: str, digits: int) -> str:
    f = f"{10.0 ** digits}"
    return f"(floor(({x}) * {f}::DOUBLE + 0.5) / {f}::DOUBLE)"


cte("k_holes", f"""
SELECT k, {CX} + {R} * {B.RING_RATIO} * cos(radians((k * 360.0::DOUBLE / 20))) AS hx,
          {CY} + {R} * {B.RING_RATIO} * sin(radians((k * 360.0::DOUBLE / 20))) AS hy
FROM (SELECT unnest(range(20))::INT AS k)
""")

_rows = [
    ("pt", "s % 6 = 1", "02", "point", "off + 180", "centroid", 0.0, 0.0, 0.0, "false", None),
    ("pv", "s % 6 = 1", "04", "point", "off + 150", "centroid", _z[20][0], _z[20][1], 1.0, "true", None),
    ("ns", "s % 6 = 1", "03", "point", "off + 181", "nose", _z[4][0], _z[4][1], 1.0, "true", None),
    ("rh", "s % 12 = 2", "03", "point", "off + 230", "centroid", _z[3][2], _z[3][3], 1.0, "true", None),
    ("oo", "s % 25 = 6", "06", "point", "off + n + 500", "nose", 1.0, 1.0, 1.0, "true", None),
    ("rg", "s % 6 = 2", "02", "range", ("off + 222", "off + 240"), None, 0, 0, 0, "NULL", "not_visible"),
    ("eb", "s % 12 = 4", "05", "range", ("off + n - 60", "off + n + 20"), None, 0, 0, 0, "NULL", "in_escape_box"),
    ("ts", "s % 9 = 4", "02", "trial_start", "off + 70", None, 0, 0, 0, "NULL", None),
    ("tx", "s % 27 = 13", "03", "trial_start", "1000000", None, 0, 0, 0, "NULL", None),
    ("so", "s % 8 = 5", "02", "strategy_override", "NULL", None, 0, 0, 0, "NULL", None),
    ("ne", "s % 4 = 1", "02", "no_escape", "NULL", None, 0, 0, 0, "NULL", None),
    ("ad", "s % 20 = 8", "07", "event", ("off + 250", "off + 265"), "add", 0, 0, 0, "NULL", None),
    ("dl", "s % 20 = 9", "07", "event", ("NULL", "NULL"), "delete", 0, 0, 0, "NULL", None),
]


def _correction(r: tuple) -> str:
    tag, when, day, kind, at, what, x, y, conf, valid, rt = r
    lo, hi = at if isinstance(at, tuple) else (at, at)
    what = f"'{what}'" if what else "NULL"
    rt = f"'{rt}'" if rt else "NULL"
    return (
        f"SELECT s, session_id, video_id, n, off, '{tag}-' || s AS id, '2026-01-{day}T10:00:00Z' AS ts, '{kind}' AS kind, "
        f"CASE WHEN s % 3 <> 2 THEN 'rev-' || (s % 3) END AS reviewer, ({lo})::INT AS lo_no, ({hi})::INT AS hi_no, "
        f"{what} AS what, {x}::DOUBLE AS x, {y}::DOUBLE AS y, {conf}::DOUBLE AS conf, {valid}::BOOLEAN AS valid, {rt} AS range_type "
        f"FROM k_sup WHERE {when}"
    )


cte("k_corr", "\nUNION ALL ".join(_correction(r) for r in _rows))

cte("k_edits", """
SELECT *, CASE WHEN off = 0 THEN lo_no WHEN lo_no BETWEEN off AND off + n - 1 THEN lo_no - off ELSE -1 END AS lo_p,
       CASE WHEN off = 0 THEN hi_no WHEN hi_no BETWEEN off AND off + n - 1 THEN hi_no - off ELSE -1 END AS hi_p
FROM k_corr WHERE kind IN ('point', 'range')
""")
cte("k_edits_ok", """
SELECT *, greatest(0, lo_p) AS lo, least(n - 1, hi_p) AS hi FROM k_edits
WHERE CASE WHEN kind = 'point' THEN lo_p >= 0 AND lo_p < n ELSE lo_no <= hi_no AND hi_p >= 0 AND lo_p < n END
""")
cte("k_edit_frames", "SELECT *, unnest(range(lo, hi + 1)) AS pos FROM k_edits_ok")
_val = """{'x': CASE WHEN kind = 'range' THEN 0.0 ELSE x END, 'y': CASE WHEN kind = 'range' THEN 0.0 ELSE y END,
 'conf': CASE WHEN kind = 'range' THEN 0.0 ELSE conf END, 'valid': CASE WHEN kind = 'range' THEN false ELSE valid END,
 'state': CASE WHEN kind = 'range' OR NOT valid THEN 'not_detected' ELSE 'tracked' END,
 'reason': CASE WHEN kind = 'range' THEN range_type ELSE 'corrected' END}"""
cte("k_edit_fields", f"""
SELECT s, pos, arg_max({_val}, ts || '|' || id) FILTER (WHERE kind = 'range' OR what = 'centroid') AS c,
       arg_max({_val}, ts || '|' || id) FILTER (WHERE kind = 'range' OR what = 'nose') AS e
FROM k_edit_frames GROUP BY s, pos
""")
cte("k_corrected", """
SELECT f.s, 'c' AS v, f.pos, frame_index, t_s AS t,
  CASE WHEN c IS NOT NULL THEN c.x ELSE f.x END AS x, CASE WHEN c IS NOT NULL THEN c.y ELSE f.y END AS y,
  CASE WHEN c IS NOT NULL THEN c.conf ELSE c_conf END AS c_conf,
  CASE WHEN c IS NOT NULL THEN c.valid ELSE c_valid END AS c_valid, c IS NOT NULL AS c_hand,
  CASE WHEN e IS NOT NULL THEN e.x ELSE nx END AS nx, CASE WHEN e IS NOT NULL THEN e.y ELSE ny END AS ny,
  CASE WHEN e IS NOT NULL THEN e.valid ELSE n_valid END AS n_valid, e IS NOT NULL AS n_hand,
  CASE WHEN c IS NOT NULL THEN c.state ELSE state END AS state, CASE WHEN c IS NOT NULL THEN c.reason ELSE reason END AS reason,
  area, nose_conf
FROM k_frames f LEFT JOIN k_edit_fields ef ON ef.s = f.s AND ef.pos = f.pos
""")
cte("k_both", """
SELECT * FROM k_corrected UNION ALL
SELECT s, 'a', pos, frame_index, t_s, x, y, c_conf, c_valid, false, nx, ny, n_valid, false, state, reason, area, nose_conf
FROM k_frames WHERE s IN (SELECT s FROM k_edits)
""")
cte("k_nominal", """
SELECT s, median(dt) AS nominal FROM (SELECT s, t_s - lag(t_s) OVER (PARTITION BY s ORDER BY pos) AS dt FROM k_frames)
WHERE dt > 0 GROUP BY s
""")
cte("k_ref", """
SELECT b.*, nominal, lag(t) OVER w AS prev_t,
  last_value(CASE WHEN c_valid THEN {'pos': pos, 't': t, 'x': x, 'y': y} END IGNORE NULLS) OVER
    (PARTITION BY s, v ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ok
FROM k_both b LEFT JOIN k_nominal USING (s) WINDOW w AS (PARTITION BY s, v ORDER BY pos)
""")
cte("k_out", f"""
SELECT *, coalesce(c_valid AND prev_ok IS NOT NULL AND NOT c_hand AND t - prev_ok.t >= {KIN['duplicateTimestampFactor']} * nominal
  AND t - prev_ok.t > 0 AND sqrt((x - prev_ok.x) ** 2 + (y - prev_ok.y) ** 2) / (t - prev_ok.t)
      > {D['outlierVelocityThreshold_cmPerS']} * {PXCM}, false) AS outlier FROM k_ref
""")
cte("k_clean0", f"""
SELECT s, v, pos, frame_index, t, t - prev_t AS dt, nominal, prev_ok, c_valid AS seen_raw, x, y, c_conf, nx, ny, c_hand,
  c_valid AND NOT outlier AS c_valid, n_valid AND NOT outlier AS n_valid, outlier,
  CASE WHEN outlier THEN 'ambiguous' ELSE state END AS state, CASE WHEN outlier THEN 'outlier_velocity' ELSE reason END AS reason,
  area, nose_conf, (c_valid AND NOT outlier AND n_valid AND (n_hand OR nose_conf >= {D['noseConfidenceCutoff']})) AS use_nose
FROM k_out
""")
cte("k_near", f"""
SELECT s, v, pos, ex, ey, arg_min(k, (d2, k)) AS nearest, sqrt(min(d2)) AS near_px
FROM (SELECT s, v, pos, ex, ey, k, (ex - hx) * (ex - hx) + (ey - hy) * (ey - hy) AS d2
      FROM (SELECT s, v, pos, CASE WHEN use_nose THEN nx ELSE x END AS ex, CASE WHEN use_nose THEN ny ELSE y END AS ey
            FROM k_clean0 WHERE c_valid), k_holes)
GROUP BY s, v, pos, ex, ey
""")
cte("k_clean", f"""
SELECT c.*, ex, ey, nearest, near_px, CASE WHEN near_px <= {INV_PX} THEN nearest ELSE -1 END AS hole_at,
  CASE WHEN near_px <= {ESC_PX} AND state = 'low_confidence' AND reason IN ('small_blob', 'fragmented') THEN nearest ELSE -1 END AS partial_at,
  c_valid AND sqrt((x - {CX}) ** 2 + (y - {CY}) ** 2) <= {R} AS on_platform
FROM k_clean0 c LEFT JOIN k_near USING (s, v, pos)
""")
# trial start, cutoff
cte("k_start", """
SELECT a.s, a.v, a.n, auto_pos, coalesce(fixed, auto_pos) AS from_pos, fixed IS NOT NULL AS hand_start, fixed_id
FROM (SELECT s, v, max(pos) + 1 AS n, min(pos) FILTER (WHERE state = 'tracked' AND on_platform) AS auto_pos FROM k_clean GROUP BY s, v) a
JOIN k_sup k ON k.s = a.s
LEFT JOIN (SELECT s, arg_max(id, ts || '|' || id) AS fixed_id,
           arg_max(CASE WHEN lo_no - off BETWEEN 0 AND n - 1 THEN lo_no - off ELSE least(greatest(0, lo_no), n - 1) END, ts || '|' || id) AS fixed
           FROM k_corr WHERE kind = 'trial_start' GROUP BY s) e ON e.s = a.s
""")
# the automatic variant starts where the corrected one does
cte("k_cut", f"""
SELECT b.*, f.t AS from_t, f.frame_index AS from_no,
  (SELECT max(pos) FROM k_clean c WHERE c.s = b.s AND c.v = b.v AND c.t <= f.t + {D['trialCutoff_s']} + {P.CUTOFF_TOLERANCE_S}) AS cut_pos
FROM (SELECT s, v, n, first_value(from_pos) OVER (PARTITION BY s ORDER BY v DESC) AS from_pos, auto_pos, hand_start FROM k_start) b
LEFT JOIN k_clean f ON f.s = b.s AND f.v = b.v AND f.pos = b.from_pos
""")
# entry runs over frames
cte("k_mem", """
SELECT c.*, n, from_pos, cut_pos, NOT c_valid OR partial_at >= 0 AS member,
  lag(NOT c_valid OR partial_at >= 0) OVER w AS prev_member,
  last_value(CASE WHEN c_valid THEN partial_at END IGNORE NULLS) OVER
    (PARTITION BY c.s, c.v ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_part
FROM k_clean c JOIN k_cut k ON k.s = c.s AND k.v = c.v AND c.pos >= k.from_pos
WINDOW w AS (PARTITION BY c.s, c.v ORDER BY pos)
""")
cte("k_run_frames", """
SELECT *, max(CASE WHEN begins THEN pos END) OVER (PARTITION BY s, v ORDER BY pos) AS run_pos FROM
(SELECT *, member AND (prev_member IS NULL OR NOT prev_member OR (partial_at >= 0 AND seen_part >= 0 AND seen_part <> partial_at)) AS begins FROM k_mem)
""")
cte("k_run0", """
SELECT s, v, run_pos AS run, max(pos) AS end_pos, max(partial_at) AS partial_hole,
  count(*) FILTER (WHERE partial_at >= 0) AS partial_frames, count(*) FILTER (WHERE NOT c_valid) AS absent_frames,
  min(pos) FILTER (WHERE NOT c_valid AND reason = 'in_escape_box') AS box_pos, any_value(n) AS n, any_value(from_pos) AS from_pos,
  any_value(cut_pos) AS cut_pos
FROM k_run_frames WHERE member GROUP BY s, v, run_pos
""")
cte("k_run1", f"""
SELECT r.*, a.t AS start_t, a.frame_index AS start_no, z.t AS end_t, z.frame_index AS end_no, bx.t AS box_t, bx.frame_index AS box_no,
  CASE WHEN r.run > r.from_pos AND l.c_valid THEN l.pos END AS seen_pos,
  CASE WHEN r.run > r.from_pos AND l.c_valid THEN l.near_px END AS seen_px,
  CASE WHEN r.run > r.from_pos AND l.c_valid THEN l.nearest END AS seen_hole,
  CASE WHEN r.run > r.from_pos AND l.c_valid THEN l.use_nose END AS seen_nose,
  CASE WHEN r.run > r.from_pos AND l.c_valid THEN l.ex END AS seen_ex,
  CASE WHEN r.run > r.from_pos AND l.c_valid THEN l.ey END AS seen_ey,
  b.pos AS back_pos, b.ex AS back_ex, b.ey AS back_ey, b.nearest AS back_hole, b.near_px AS back_near, b.t AS back_t,
  b.frame_index AS back_no, b.partial_at AS back_part, b.hole_at AS back_hole_at, target, trial_type
FROM k_run0 r JOIN k_videos kv ON kv.s = r.s
JOIN k_clean a ON a.s = r.s AND a.v = r.v AND a.pos = r.run
JOIN k_clean z ON z.s = r.s AND z.v = r.v AND z.pos = r.end_pos
LEFT JOIN k_clean l ON l.s = r.s AND l.v = r.v AND l.pos = r.run - 1
LEFT JOIN k_clean b ON b.s = r.s AND b.v = r.v AND b.pos = r.end_pos + 1
LEFT JOIN k_clean bx ON bx.s = r.s AND bx.v = r.v AND bx.pos = r.box_pos
WHERE r.run <= r.cut_pos
""")
cte("k_run2", f"""
SELECT q.*, sqrt((back_ex - hx) ** 2 + (back_ey - hy) ** 2) AS back_px,
  coalesce(sqrt((back_ex - hx) ** 2 + (back_ey - hy) ** 2) <= {INV_PX}, false) AS back_same,
  end_pos = n - 1 AS to_end, end_t - start_t AS duration,
  (SELECT arg_max(near_px, pos) FROM k_clean c WHERE c.s = q.s AND c.v = q.v AND c.c_valid AND c.pos <= q.box_pos) AS box_px
FROM (SELECT *, CASE WHEN partial_hole >= 0 THEN partial_hole WHEN seen_px <= {ESC_PX} THEN seen_hole ELSE -1 END AS hole FROM k_run1) q
LEFT JOIN k_holes ON k = q.hole
""")
cte("k_runs", f"""
SELECT *, CASE WHEN marked THEN box_pos ELSE run END AS first_pos, CASE WHEN marked THEN box_t ELSE start_t END AS first_t,
  CASE WHEN marked THEN box_no ELSE start_no END AS first_no,
  outcome = 'escape_entry' AND (to_end OR CASE WHEN marked THEN end_t - box_t ELSE duration END >= {ESC['persistCutoff_s']}) AS persistent,
  CASE WHEN marked THEN target WHEN outcome = 'tracking_failure' THEN CASE WHEN seen_px <= {INV_PX} THEN seen_hole END
       WHEN hole >= 0 THEN hole END AS event_hole
FROM (SELECT *, CASE WHEN marked OR (shaped AND at_target) THEN 'escape_entry' WHEN shaped THEN 'investigation'
                     WHEN long_enough AND absent_frames > 0 THEN 'tracking_failure' ELSE 'none' END AS outcome
      FROM (SELECT *, hole >= 0 AND long_enough AND (back_pos IS NULL OR back_same) AS shaped
            FROM (SELECT *, (to_end AND at_target) OR duration >= {ESC['minDuration_s']} AS long_enough
                  FROM (SELECT *, trial_type <> 'probe' AND box_pos IS NOT NULL AS marked,
                               trial_type <> 'probe' AND hole = target AS at_target FROM k_run2))))
""")
cte("k_bounds", """
SELECT k.*, CASE WHEN from_pos IS NULL THEN NULL WHEN esc <= cut_pos THEN esc ELSE cut_pos END AS end_pos,
  CASE WHEN from_pos IS NULL THEN 'no_start' WHEN esc <= cut_pos THEN 'escape' WHEN cut_pos < n - 1 THEN 'cutoff' ELSE 'end_of_video' END AS end_reason
FROM k_cut k LEFT JOIN (SELECT s, v, min(first_pos) AS esc FROM k_runs WHERE persistent GROUP BY s, v) e USING (s, v)
""")
# the corrected end, and for the automatic pass the later of its own and the corrected end
cte("k_ends", """
SELECT b.*, z.t AS end_t, z.frame_index AS end_no, nx.hole_at AS next_hole FROM
(SELECT s, v, n, from_pos, from_t, from_no, cut_pos, end_reason,
   CASE WHEN v = 'a' THEN greatest(end_pos, first_value(end_pos) OVER (PARTITION BY s ORDER BY v DESC)) ELSE end_pos END AS end_pos FROM k_bounds) b
LEFT JOIN k_clean z ON z.s = b.s AND z.v = b.v AND z.pos = b.end_pos
LEFT JOIN k_clean nx ON nx.s = b.s AND nx.v = b.v AND nx.pos = b.end_pos + 1
""")
# visits
cte("k_visit_frames", """
SELECT c.s, c.v, c.pos, c.t, c.frame_index,
  CASE WHEN r.run IS NOT NULL THEN -1 ELSE c.hole_at END AS h
FROM k_run_frames c JOIN k_ends e ON e.s = c.s AND e.v = c.v AND c.pos <= e.end_pos
LEFT JOIN k_runs r ON r.s = c.s AND r.v = c.v AND c.member AND r.run = c.run_pos
  AND r.outcome IN ('escape_entry', 'investigation') AND r.partial_frames > 0
""")
cte("k_bouts", """
SELECT s, v, h, min(pos) AS lo, max(pos) AS hi, min(t) AS t0, max(t) AS t1, NULL::INT AS run FROM
(SELECT *, pos - row_number() OVER (PARTITION BY s, v, h ORDER BY pos) AS g FROM k_visit_frames WHERE h >= 0)
GROUP BY s, v, h, g
UNION ALL
SELECT r.s, r.v, event_hole, run, r.end_pos, start_t, r.end_t, run FROM k_runs r JOIN k_ends e ON e.s = r.s AND e.v = r.v
WHERE outcome = 'investigation' AND run <= e.end_pos
""")
cte("k_merged", f"""
SELECT s, v, h, min(lo) AS lo, max(hi) AS hi, count(*) AS bouts,
  greatest(0.0, max(gap) FILTER (WHERE fresh = 0)) AS largest_gap, min(run) AS run
FROM (SELECT *, sum(fresh) OVER (PARTITION BY s, v, h ORDER BY lo) AS g
      FROM (SELECT *, CASE WHEN gap < {INV['mergeGap_s']} THEN 0 ELSE 1 END AS fresh
            FROM (SELECT *, t0 - max(t1) OVER (PARTITION BY s, v, h ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM k_bouts)))
GROUP BY s, v, h, g
""")
cte("k_approach", """
SELECT r.s, r.v, r.run, coalesce(max(c.pos) FILTER (WHERE c.hole_at <> r.event_hole) + 1, any_value(r.from_pos)) AS lo
FROM k_runs r JOIN k_clean c ON c.s = r.s AND c.v = r.v AND c.pos >= r.from_pos AND c.pos < r.seen_pos
WHERE r.event_hole IS NOT NULL AND r.outcome IN ('escape_entry', 'tracking_failure') GROUP BY r.s, r.v, r.run
""")
cte("k_ev0", f"""
SELECT s, v, 'investigation' AS kind, h AS hole, lo AS first_pos, hi AS last_pos, lo, hi, run, bouts, largest_gap, NULL::VARCHAR AS point_at_loss
FROM k_merged m
WHERE (SELECT t FROM k_clean c WHERE c.s = m.s AND c.v = m.v AND c.pos = m.hi) - (SELECT t FROM k_clean c WHERE c.s = m.s AND c.v = m.v AND c.pos = m.lo) >= {INV['minDuration_s']}
UNION ALL
SELECT r.s, r.v, outcome, event_hole, first_pos, r.end_pos,
  CASE WHEN seen_pos IS NOT NULL AND event_hole IS NOT NULL THEN coalesce(a.lo, seen_pos) END,
  CASE WHEN partial_frames > 0 THEN r.end_pos ELSE seen_pos END, r.run, NULL, NULL,
  CASE WHEN seen_nose THEN 'nose' ELSE 'centroid' END
FROM k_runs r JOIN k_ends e ON e.s = r.s AND e.v = r.v LEFT JOIN k_approach a ON a.s = r.s AND a.v = r.v AND a.run = r.run
WHERE outcome IN ('escape_entry', 'tracking_failure') AND first_pos <= e.end_pos
""")
cte("k_ev1", f"""
SELECT e.s, e.v, e.kind, e.hole, e.first_pos, e.last_pos, e.lo, e.hi, any_value(e.run) AS run, any_value(e.bouts) AS bouts,
  any_value(e.largest_gap) AS largest_gap, any_value(point_at_loss) AS point_at_loss,
  min(sqrt((c.nx - hx) ** 2 + (c.ny - hy) ** 2) / {PXCM}) FILTER (WHERE use_nose) AS min_nose_cm,
  min(sqrt((c.x - hx) ** 2 + (c.y - hy) ** 2) / {PXCM}) AS min_centroid_cm,
  count(c.pos) FILTER (WHERE use_nose) AS nose_frames, count(c.pos) FILTER (WHERE NOT use_nose) AS centroid_frames
FROM k_ev0 e LEFT JOIN k_holes ON k = e.hole
LEFT JOIN k_clean c ON c.s = e.s AND c.v = e.v AND c.c_valid AND k IS NOT NULL AND c.pos BETWEEN e.lo AND e.hi
GROUP BY e.s, e.v, e.kind, e.hole, e.first_pos, e.last_pos, e.lo, e.hi
""")
cte("k_ev", """
SELECT e.*, 'auto-' || e.kind || '-h' || coalesce(hole::VARCHAR, 'x') || '-f' || a.frame_index AS event_id,
  coalesce(hole = target, false) AS is_target, a.frame_index AS start_no, z.frame_index AS end_no, a.t AS start_t, z.t AS end_t,
  z.t - a.t AS duration_s, coalesce(point_at_loss, CASE WHEN nose_frames > centroid_frames THEN 'nose' ELSE 'centroid' END) AS point_used
FROM k_ev1 e JOIN k_videos kv ON kv.s = e.s
JOIN k_clean a ON a.s = e.s AND a.v = e.v AND a.pos = first_pos JOIN k_clean z ON z.s = e.s AND z.v = e.v AND z.pos = last_pos
""")

# evidence text
_hole = "('hole ' || {k} || CASE WHEN {k} = target THEN ' (target)' ELSE ' (non-target)' END)"


def _s(x: str) -> str:
    return f"printf('%.2f s', {x})"


def _cm(px: str) -> str:
    return f"coalesce(printf('%.1f cm', {px} / {PXCM}), 'n/a')"


cte("k_trend", """
SELECT r.s, r.v, r.run, count(c.pos) AS tn, arg_min(c.area, c.pos) AS a0, arg_max(c.area, c.pos) AS a1
FROM k_runs r JOIN k_clean c ON c.s = r.s AND c.v = r.v AND c.c_valid AND c.pos BETWEEN greatest(0, r.seen_pos - 9) AND r.seen_pos
WHERE r.seen_pos IS NOT NULL GROUP BY r.s, r.v, r.run
""")
_lasted = f"('lasted ' || {_s('duration')} || CASE WHEN to_end THEN ' to the end of the video' ELSE '' END)"
cte("k_run_text", f"""
SELECT s, v, run, concat_ws(' ',
  CASE WHEN partial_frames > 0 THEN 'Small or split blob on ' || partial_frames || ' frames'
    || CASE WHEN absent_frames > 0 THEN ', absent on ' || absent_frames ELSE '' END
    || printf(', frames %d–%d (%.2f s–%.2f s), within ', start_no, end_no, start_t, end_t) || {_cm(ESC_PX)} || ' of '
    || {_hole.format(k='partial_hole')} || '; ' || {_lasted} || '.'
  ELSE 'Lost at frame ' || start_no || ' (' || {_s('start_t')} || '), '
    || CASE WHEN seen_pos IS NOT NULL THEN 'last seen ' || {_cm('seen_px')} || ' from ' || {_hole.format(k='seen_hole')}
         || printf(' (%.2f × hole radius), ', seen_px / {HR}) || {_cm(f'sqrt((seen_ex - {CX}) ** 2 + (seen_ey - {CY}) ** 2)')} || ' off the centre; '
       ELSE 'nothing positioned earlier in the trial; ' END || {_lasted} || '.' END,
  CASE WHEN back_pos IS NOT NULL THEN CASE WHEN back_part >= 0 THEN 'Seen again as a partial blob' ELSE 'Seen full-size again' END
    || ' at frame ' || back_no || ' (' || {_s('back_t')} || ') '
    || CASE WHEN hole >= 0 THEN {_cm('back_px')} || ' from ' || {_hole.format(k='hole')} || CASE WHEN back_same THEN ' (the same hole)' ELSE ' (elsewhere)' END
       ELSE {_cm('back_near')} || ' from its nearest hole ' || back_hole END
    || CASE WHEN seen_pos IS NOT NULL THEN ', ' || {_cm('sqrt((back_ex - seen_ex) ** 2 + (back_ey - seen_ey) ** 2)')} || ' from where last seen' ELSE '' END || '.' END,
  CASE WHEN seen_pos IS NOT NULL THEN CASE WHEN tn >= 2 THEN 'Blob area '
      || CASE WHEN (CASE WHEN a0 > 0 THEN a1 / a0 ELSE 1 END) < {P.BLOB_TREND_FALL} THEN 'fell'
              WHEN (CASE WHEN a0 > 0 THEN a1 / a0 ELSE 1 END) > {P.BLOB_TREND_RISE} THEN 'rose' ELSE 'was steady' END
      || printf(' from %.0f to %.0f px² over %d frames before the loss.', a0, a1, tn)
    ELSE printf('No blob-area trend (%d positioned frames before the loss).', coalesce(tn, 0)) END END) AS run_text
FROM k_runs LEFT JOIN k_trend USING (s, v, run)
""")
_measure = f"""concat_ws(' ', CASE WHEN nose_frames + centroid_frames = 0 THEN 'The span has no position.'
  ELSE printf('Nose in %d of %d positions, else the centroid.', nose_frames, nose_frames + centroid_frames) END,
  CASE WHEN min_nose_cm IS NOT NULL THEN 'Least distance to the hole: nose ' || printf('%.1f cm', min_nose_cm) || ', centroid ' || coalesce(printf('%.1f cm', min_centroid_cm), 'n/a') || '.'
  ELSE 'Least distance to the hole: centroid ' || coalesce(printf('%.1f cm', min_centroid_cm), 'n/a') || ' (the nose was never seen).' END)"""
cte("k_ev_text", f"""
SELECT e.*, CASE WHEN kind = 'investigation' THEN concat_ws(' ',
    CASE WHEN e.run IS NOT NULL THEN 'Kept as an investigation, since no escape box is there to enter. ' || run_text END,
    {_hole.format(k='e.hole')} || ': within {INV['radiusFactor']} × hole radius (' || {_cm(INV_PX)} || ') for ' || {_s('duration_s')}
      || printf(', frames %d–%d (%.2f s–%.2f s)', e.start_no, e.end_no, e.start_t, e.end_t)
      || CASE WHEN last_pos = b.end_pos AND b.next_hole = e.hole THEN printf(' (still there when the trial ended at %.2f s)', b.end_t) ELSE '' END || '.',
    {_measure},
    CASE WHEN bouts > 1 THEN printf('Merged from %d bouts, the largest gap %.2f s.', bouts, largest_gap) END)
  WHEN kind = 'escape_entry' THEN concat_ws(' ',
    CASE WHEN marked THEN 'A reviewer marked an entry at frame ' || e.start_no || ' (' || {_s('e.start_t')} || ').'
        || CASE WHEN box_px > {ESC_PX} THEN ' Last positioned ' || {_cm('box_px')} || ' from its nearest hole: kept as marked, for review.' ELSE '' END
      ELSE 'Escape-box entry at the target hole. ' || run_text END,
    CASE WHEN persistent THEN 'Persistent: the trial ends at its first frame.' ELSE 'Not persistent: the trial continues.' END,
    CASE WHEN nose_frames + centroid_frames > 0 THEN {_measure} END)
  ELSE concat_ws(' ', 'Tracking failure ' || CASE WHEN e.hole IS NULL THEN 'away from every hole' ELSE 'at ' || {_hole.format(k='e.hole')} END || '.',
    run_text, CASE WHEN e.hole IS NOT NULL THEN 'The track ends at a hole, so look at the video for an entry.' END) END AS evidence
FROM k_ev e JOIN k_ends b ON b.s = e.s AND b.v = e.v
JOIN (SELECT s, target FROM k_videos) kv ON kv.s = e.s
LEFT JOIN (SELECT s, v, run, marked, persistent, box_px, duration AS run_s FROM k_runs) r ON r.s = e.s AND r.v = e.v AND r.run = e.run
LEFT JOIN k_run_text t ON t.s = e.s AND t.v = e.v AND t.run = e.run
""")
# provenance
_greedy = """
SELECT s, unnest(list_zip(m.c, m.a)) AS p FROM (
 SELECT s, list_reduce(pairs, lambda acc, x: CASE WHEN list_contains(acc.c, x.ci) OR list_contains(acc.a, x.ai) THEN acc
     ELSE {{'c': list_append(acc.c, x.ci), 'a': list_append(acc.a, x.ai)}} END, {{'c': []::VARCHAR[], 'a': []::VARCHAR[]}}) AS m
 FROM (SELECT c.s, list({{'ci': c.event_id, 'ai': a.event_id}} ORDER BY least(c.end_no, a.end_no) - greatest(c.start_no, a.start_no) DESC,
              c.start_no, a.start_no, c.event_id, a.event_id) AS pairs
       FROM {c} c JOIN {a} a ON a.s = c.s AND coalesce(a.hole, -1) = coalesce(c.hole, -1) {same}
        AND least(c.end_no, a.end_no) - greatest(c.start_no, a.start_no) + 1 > 0 GROUP BY c.s))
"""
cte("k_evc", "SELECT * FROM k_ev_text WHERE v = 'c'")
cte("k_eva", "SELECT * FROM k_ev_text WHERE v = 'a' AND s IN (SELECT s FROM k_bounds WHERE v = 'c' AND end_pos IS NOT NULL)")
cte("k_pair1", _greedy.format(c="k_evc", a="k_eva", same="AND a.kind = c.kind"))
cte("k_leftc", "SELECT * FROM k_evc e WHERE NOT EXISTS (SELECT 1 FROM k_pair1 q WHERE q.s = e.s AND q.p[1] = e.event_id)")
cte("k_lefta", "SELECT * FROM k_eva e WHERE NOT EXISTS (SELECT 1 FROM k_pair1 q WHERE q.s = e.s AND q.p[2] = e.event_id)")
cte("k_pair2", _greedy.format(c="k_leftc", a="k_lefta", same=""))
cte("k_pairs", """
SELECT s, p[1] AS event_id, p[2] AS auto_id, false AS changed FROM k_pair1
UNION ALL SELECT s, p[1], p[2], true FROM k_pair2
""")
cte("k_spans", """
SELECT s, id, ts, least(lo_no, hi_no) AS span_lo, greatest(lo_no, hi_no) AS span_hi FROM k_corr WHERE kind IN ('point', 'range')
""")
cte("k_lab0", """
SELECT e.*, q.auto_id, q.changed, a.hole AS a_hole, a.start_no AS a_lo, a.end_no AS a_hi, a.kind AS a_kind,
  e.s IN (SELECT s FROM k_edits) AS has_edits,
  coalesce(NOT q.changed AND e.kind = a.kind AND e.hole IS NOT DISTINCT FROM a.hole AND e.start_no = a.start_no AND e.end_no = a.end_no
   AND e.point_used = a.point_used AND e.min_nose_cm IS NOT DISTINCT FROM a.min_nose_cm
   AND e.min_centroid_cm IS NOT DISTINCT FROM a.min_centroid_cm AND e.evidence = a.evidence, false) AS same
FROM k_evc e LEFT JOIN k_pairs q ON q.s = e.s AND q.event_id = e.event_id
LEFT JOIN k_eva a ON a.s = e.s AND a.event_id = q.auto_id
""")
cte("k_lab", """
SELECT l.s, l.event_id, l.kind, l.hole, l.is_target, l.first_pos, l.last_pos, l.start_no, l.end_no, l.start_t, l.end_t, l.duration_s, l.point_used,
  l.min_nose_cm, l.min_centroid_cm,
  CASE WHEN changed THEN l.evidence || ' Was an automatic ' || replace(a_kind, '_', ' ') || ' '
     || CASE WHEN a_hole IS NULL THEN 'away from any hole' ELSE 'at hole ' || a_hole END || printf(', frames %d–%d, before the corrections changed its kind.', a_lo, a_hi)
   ELSE l.evidence END AS evidence,
  CASE WHEN NOT has_edits OR (auto_id IS NOT NULL AND NOT changed) THEN 'auto' ELSE 'corrected' END AS source,
  has_edits AND auto_id IS NOT NULL AND NOT changed AND NOT same AS evidence_corrected,
  CASE WHEN has_edits AND NOT same THEN coalesce((SELECT string_agg(id, ';' ORDER BY ts, id) FROM k_spans p WHERE p.s = l.s
     AND p.span_lo <= greatest(l.end_no, coalesce(a_hi, l.end_no)) AND least(l.start_no, coalesce(a_lo, l.start_no)) <= p.span_hi), '') ELSE '' END AS correction_ids,
  CASE WHEN auto_id IS NOT NULL AND NOT same THEN a_hole END AS auto_hole,
  CASE WHEN auto_id IS NOT NULL AND NOT same THEN a_lo END AS auto_lo,
  CASE WHEN auto_id IS NOT NULL AND NOT same THEN a_hi END AS auto_hi
FROM k_lab0 l
""")
# the one event correction the data applies: an added investigation
cte("k_added", f"""
SELECT x.s, 'user-' || x.id AS event_id, (x.s % 20)::INT AS hole, x.lo_no, x.hi_no, x.id, target,
  min(c.t) AS t0, max(c.t) AS t1, min(c.pos) AS p0, max(c.pos) AS p1,
  min(sqrt((c.nx - hx) ** 2 + (c.ny - hy) ** 2) / {PXCM}) FILTER (WHERE c.c_valid AND use_nose) AS min_nose_cm,
  min(sqrt((c.x - hx) ** 2 + (c.y - hy) ** 2) / {PXCM}) FILTER (WHERE c.c_valid) AS min_centroid_cm,
  count(*) FILTER (WHERE c.c_valid AND use_nose) AS nose_frames, count(*) FILTER (WHERE c.c_valid AND NOT use_nose) AS centroid_frames
FROM k_corr x JOIN k_videos kv ON kv.s = x.s JOIN k_holes ON k = x.s % 20
JOIN k_clean c ON c.s = x.s AND c.v = 'c' AND c.frame_index BETWEEN x.lo_no AND x.hi_no
WHERE x.kind = 'event' AND x.what = 'add' GROUP BY ALL
""")
cte("k_events", f"""
SELECT * FROM k_lab UNION ALL
SELECT s, event_id, 'investigation', hole, hole = target, p0, p1, lo_no, hi_no, t0, t1, t1 - t0,
  CASE WHEN nose_frames > centroid_frames THEN 'nose' ELSE 'centroid' END, min_nose_cm, min_centroid_cm,
  printf('New investigation from a reviewer: hole %d, frames %d–%d. ', hole, lo_no, hi_no) || {_measure}, 'corrected', false,
  coalesce((SELECT string_agg(id, ';' ORDER BY ts, id) FROM k_spans p WHERE p.s = a.s AND p.span_lo <= a.hi_no AND a.lo_no <= p.span_hi), ''), NULL, NULL, NULL
FROM k_added a
""")
cte("k_removed", """
SELECT a.s, a.event_id, a.kind, a.hole, a.start_no, a.end_no, a.start_t, a.end_t,
  EXISTS (SELECT 1 FROM k_evc c WHERE c.s = a.s AND c.event_id = a.event_id) AS carried,
  coalesce((SELECT string_agg(id, ';' ORDER BY ts, id) FROM k_spans p WHERE p.s = a.s
    AND p.span_lo <= greatest(a.end_no, coalesce((SELECT max(c.end_no) FROM k_evc c WHERE c.s = a.s AND c.start_no <= a.end_no AND a.start_no <= c.end_no), a.end_no))
    AND p.span_hi >= least(a.start_no, coalesce((SELECT min(c.start_no) FROM k_evc c WHERE c.s = a.s AND c.start_no <= a.end_no AND a.start_no <= c.end_no), a.start_no))), '') AS correction_ids
FROM k_lefta a JOIN k_ends e ON e.s = a.s AND e.v = 'c'
WHERE a.kind <> 'tracking_failure' AND a.start_no <= e.end_no AND a.end_no >= e.from_no
  AND NOT EXISTS (SELECT 1 FROM k_pair2 q WHERE q.s = a.s AND q.p[2] = a.event_id)
""")
# motion
cte("k_trial", """
SELECT c.*, e.from_pos, e.end_pos FROM k_clean c JOIN k_ends e ON e.s = c.s AND e.v = c.v
WHERE c.v = 'c' AND c.pos BETWEEN e.from_pos AND e.end_pos
""")
cte("k_motion", f"""
SELECT *, CASE WHEN lead(pos) OVER w = pos + 1 THEN lead(t) OVER w - t END AS step_dt,
  CASE WHEN lead(pos) OVER w = pos + 1 THEN sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) END AS step_px,
  CASE WHEN lead(pos) OVER w = pos + 1 THEN sqrt((lead(sx) OVER w - sx) ** 2 + (lead(sy) OVER w - sy) ** 2) END AS step_smooth_px
FROM (SELECT *, CASE WHEN whole THEN list_sort([px, x, nx1])[2] ELSE x END AS sx, CASE WHEN whole THEN list_sort([py, y, ny1])[2] ELSE y END AS sy
      FROM (SELECT *, coalesce(lag(pos) OVER w = pos - 1 AND lead(pos) OVER w = pos + 1, false) AS whole,
               lag(x) OVER w AS px, lead(x) OVER w AS nx1, lag(y) OVER w AS py, lead(y) OVER w AS ny1
            FROM k_trial WHERE c_valid WINDOW w AS (PARTITION BY s ORDER BY pos)))
WINDOW w AS (PARTITION BY s ORDER BY pos)
""")
cte("k_sector", f"""
SELECT s, target, atan2(hy - {CY}, hx - {CX}) * 180 / pi() AS deg FROM k_videos JOIN k_holes ON k = target
""")
_ang = f"(((atan2(y - {CY}, x - {CX}) * 180 / pi() - deg) % 360 + 360) % 360)"
_in_sector = f"((x = {CX} AND y = {CY}) OR least({_ang}, 360 - {_ang}) <= {D['targetQuadrant']['holeSpan']} * 360 / 20)"
cte("k_kin", f"""
SELECT e.s, e.end_t - e.from_t AS trial_s, coalesce(path_px, 0) / {PXCM} AS path_cm, coalesce(smooth_px, 0) / {PXCM} AS path_smoothed_cm,
  coalesce(tracked, 0) AS tracked_time_s, greatest(0, e.end_t - e.from_t - coalesce(tracked, 0)) AS gap_time_s,
  coalesce(sector, 0) AS sector_time_s, coalesce(dup, 0) AS duplicate_pairs, coalesce(drops, 0) AS dropped_pairs,
  CASE WHEN tracked > 0 THEN smooth_px / {PXCM} / tracked END AS mean_speed_cm_s,
  CASE WHEN smooth_px > 0 THEN CASE WHEN npos > 1 THEN sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) ELSE 0 END / smooth_px END AS path_efficiency
FROM k_ends e LEFT JOIN
 (SELECT s, sum(step_px) AS path_px, sum(step_smooth_px) AS smooth_px, sum(step_dt) AS tracked, sum(step_dt) FILTER (WHERE {_in_sector}) AS sector,
    arg_min(x, pos) AS x0, arg_max(x, pos) AS x1, arg_min(y, pos) AS y0, arg_max(y, pos) AS y1, count(*) AS npos FROM k_motion JOIN k_sector USING (s) GROUP BY s) m ON m.s = e.s
LEFT JOIN (SELECT s, count(*) FILTER (WHERE dt < {KIN['duplicateTimestampFactor']} * nominal) AS dup, count(*) FILTER (WHERE dt > {KIN['dropGapFactor']} * nominal) AS drops
    FROM k_trial WHERE pos > from_pos GROUP BY s) d ON d.s = e.s
WHERE e.v = 'c' AND e.end_pos IS NOT NULL
""")
# strategy
cte("k_target", """
SELECT s, arg_min({'p': first_pos, 'f': start_no, 't': start_t, 'kind': kind, 'id': event_id},
  (start_no, CASE kind WHEN 'investigation' THEN 0 WHEN 'escape_entry' THEN 1 ELSE 2 END, hole, event_id)) AS te
FROM k_events WHERE is_target AND kind <> 'tracking_failure' GROUP BY s
""")
cte("k_phase", """
SELECT e.s, e.from_pos, e.end_pos, te, CASE WHEN te IS NULL THEN e.end_pos ELSE least(e.end_pos, greatest(e.from_pos, te.p)) END AS phase_end
FROM k_ends e LEFT JOIN k_target t ON t.s = e.s WHERE e.v = 'c' AND e.end_pos IS NOT NULL
""")
cte("k_seq", """
SELECT p.s, any_value(p.from_pos) AS from_pos, any_value(p.phase_end) AS phase_end, any_value(te) IS NOT NULL AS reached,
  list({'hole': hole, 'p0': first_pos, 'p1': last_pos, 'tgt': is_target}
    ORDER BY CASE WHEN first_pos <= phase_end AND (te IS NULL OR start_no <= te.f) THEN 0 ELSE 1 END, start_no, hole, event_id)
    FILTER (WHERE kind = 'investigation' AND ((first_pos <= phase_end AND (te IS NULL OR start_no <= te.f)) OR event_id = te.id)) AS seq
FROM k_phase p LEFT JOIN k_events e ON e.s = p.s GROUP BY p.s
""")
cte("k_cross", f"""
SELECT s, list(pos ORDER BY pos) FILTER (WHERE inside AND NOT was) AS crossings FROM
(SELECT *, lag(inside) OVER (PARTITION BY s ORDER BY pos) AS was FROM
 (SELECT m.s, m.pos, sqrt((x - {CX}) ** 2 + (y - {CY}) ** 2) < {D['strategy']['centreZoneRadiusFraction']} * {R} AS inside
  FROM k_motion m JOIN k_seq q ON q.s = m.s AND len(seq) > 0
   AND m.pos BETWEEN greatest(q.from_pos, seq[1].p0) AND least(q.phase_end, seq[len(seq)].p0)))
GROUP BY s
""")
_rd = "least(abs({a} - {b}) % 20, 20 - abs({a} - {b}) % 20)"
cte("k_feat", f"""
SELECT q.s, reached, coalesce(seq, []) AS seq, coalesce(crossings, []) AS crossings,
  len(list_filter(coalesce(seq, []), lambda e: NOT e.tgt)) AS errors,
  coalesce(list_max(list_transform(list_filter(seq, lambda e: NOT e.tgt), lambda e: {_rd.format(a='e.hole', b='target')})), 0) AS max_hole_distance,
  len(coalesce(crossings, [])) AS centre_crossings, path_efficiency, target
FROM k_seq q LEFT JOIN k_cross c ON c.s = q.s LEFT JOIN k_kin k ON k.s = q.s JOIN k_videos kv ON kv.s = q.s
""")
_turn = "(CASE WHEN (e.hole - acc.run[len(acc.run)] + 20) % 20 = 1 THEN 1 WHEN (acc.run[len(acc.run)] - e.hole + 20) % 20 = 1 THEN -1 ELSE 0 END)"
_crossed = "len(list_filter(crossings, lambda c: c > acc.upto AND c < e.p0)) > 0"
_fresh = f"(len(acc.run) = 0 OR (e.hole <> acc.run[len(acc.run)] AND (({_crossed}) OR {_turn} = 0)))"
_new_run = f"""(CASE WHEN {_fresh} THEN [e.hole] WHEN e.hole = acc.run[len(acc.run)] THEN acc.run
  WHEN acc.dir = 0 OR {_turn} = acc.dir THEN list_append(acc.run, e.hole) ELSE [acc.run[len(acc.run)], e.hole] END)"""
cte("k_run_fold", f"""
SELECT s, list_reduce(list_filter(seq, lambda e: {_rd.format(a='e.hole', b='target')} > 1), lambda acc, e: 
  {{'run': {_new_run}, 'dir': (CASE WHEN {_fresh} THEN 0 WHEN e.hole = acc.run[len(acc.run)] THEN acc.dir ELSE {_turn} END)::INT,
    'upto': greatest(acc.upto, e.p1)::INT, 'best': CASE WHEN len({_new_run}) > len(acc.best) THEN {_new_run} ELSE acc.best END}},
  {{'run': []::INT[], 'dir': 0::INT, 'upto': (-1)::INT, 'best': []::INT[]}}).best AS best FROM k_feat
""")
_st = D["strategy"]
cte("k_class", f"""
SELECT *, CASE WHEN NOT searched THEN 'unclassified' WHEN spatial THEN 'spatial' WHEN serial THEN 'serial' ELSE 'random' END AS auto_strategy,
  CASE WHEN NOT searched THEN 'unclassified' WHEN spatial THEN CASE WHEN serial THEN 'serial' ELSE 'random' END WHEN serial THEN 'random'
    WHEN longest_run / {float(_st['serialMinRun'])} > spatial_close THEN 'serial' ELSE 'spatial' END AS runner_up
FROM (SELECT v.s, f.reached, errors, max_hole_distance, centre_crossings, path_efficiency, seq, best, coalesce(len(best), 0) AS longest_run,
   coalesce(f.s IS NOT NULL AND (reached OR len(seq) > 0), false) AS searched,
   coalesce((reached AND errors = 0) OR (errors <= {_st['spatialMaxErrors']} AND max_hole_distance <= {_st['spatialMaxHoleDistance']} AND centre_crossings <= {_st['spatialMaxCentreCrossings']}), false) AS spatial,
   coalesce(len(best) >= {_st['serialMinRun']}, false) AS serial,
   CASE WHEN reached AND errors = 0 THEN 1 ELSE (CASE WHEN errors <= {_st['spatialMaxErrors']} THEN 1 ELSE {float(_st['spatialMaxErrors'])} / errors END
     + CASE WHEN max_hole_distance <= {_st['spatialMaxHoleDistance']} THEN 1 ELSE {float(_st['spatialMaxHoleDistance'])} / max_hole_distance END
     + CASE WHEN centre_crossings <= {_st['spatialMaxCentreCrossings']} THEN 1 ELSE {float(_st['spatialMaxCentreCrossings'])} / centre_crossings END) / 3 END AS spatial_close,
   o.s IS NOT NULL AS overridden
  FROM k_videos v LEFT JOIN k_feat f ON f.s = v.s LEFT JOIN k_run_fold r ON r.s = v.s
  LEFT JOIN (SELECT DISTINCT s FROM k_corr WHERE kind = 'strategy_override') o ON o.s = v.s)
""")
# quality
cte("k_win", """
SELECT s, v, n, CASE WHEN end_pos IS NULL THEN 0 ELSE from_pos END AS lo, CASE WHEN end_pos IS NULL THEN n - 1 ELSE end_pos END AS hi,
  end_pos IS NOT NULL AS has_trial FROM k_ends WHERE v = 'c'
""")
cte("k_scan", f"""
SELECT c.s, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, count(*) FILTER (WHERE pos BETWEEN lo AND hi) AS frames_in,
  {', '.join(f"count(*) FILTER (WHERE pos BETWEEN lo AND hi AND state = '{x}') AS {x}_in" for x in P.STATES)},
  {', '.join(f"count(*) FILTER (WHERE state = '{x}') AS {x}_all" for x in P.STATES)},
  count(*) FILTER (WHERE dt < {KIN['duplicateTimestampFactor']} * nominal) AS duplicates, count(*) FILTER (WHERE dt > {KIN['dropGapFactor']} * nominal) AS drops,
  max(t) - min(t) - (any_value(n) - 1) * any_value(nominal) AS drift,
  count(*) FILTER (WHERE pos BETWEEN lo AND hi AND has_trial AND reason = 'oversized_blob') AS oversized_in,
  arg_min(frame_index, pos) FILTER (WHERE pos BETWEEN lo AND hi AND has_trial AND reason = 'oversized_blob') AS oversized_no,
  {', '.join(f"count(*) FILTER (WHERE pos BETWEEN lo AND hi AND c_valid AND least(4, floor(greatest(0, least(1, nose_conf)) * 5)) = {i}) AS nose_bin_{i}" for i in range(5))}
FROM k_clean c JOIN k_win w ON w.s = c.s AND w.v = c.v GROUP BY c.s
""")
cte("k_gap0", """
SELECT c.s, g, min(pos) AS start_pos, max(pos) AS end_pos, any_value(n) AS n FROM
(SELECT c.*, n, pos - row_number() OVER (PARTITION BY c.s ORDER BY pos) AS g FROM k_clean c JOIN k_win w ON w.s = c.s AND w.v = c.v
 WHERE NOT seen_raw AND pos BETWEEN lo AND hi) c GROUP BY c.s, g
""")
cte("k_gaps", f"""
SELECT q.s, q.start_pos, q.end_pos, a.frame_index AS start_no, z.frame_index AS end_no, aft.t - bef.t AS duration_s,
  CASE WHEN d <= {INV_PX} THEN 'hole' WHEN sqrt((rx - {CX}) ** 2 + (ry - {CY}) ** 2) > {R} * {B.RING_RATIO} THEN 'rim' ELSE 'open_platform' END AS location_class,
  CASE WHEN d <= {INV_PX} THEN hk END AS hole_index
FROM (SELECT r.*, (SELECT min(sqrt((rx - hx) ** 2 + (ry - hy) ** 2)) FROM k_holes) AS d, (SELECT arg_min(k, ((rx - hx) ** 2 + (ry - hy) ** 2, k)) FROM k_holes) AS hk
      FROM (SELECT g.*, coalesce(b.x, f.x) AS rx, coalesce(b.y, f.y) AS ry
            FROM (SELECT g.*, (SELECT max(pos) FROM k_clean c WHERE c.s = g.s AND v = 'c' AND seen_raw AND pos < start_pos) AS bp,
                         (SELECT min(pos) FROM k_clean c WHERE c.s = g.s AND v = 'c' AND seen_raw AND pos > end_pos) AS fp FROM k_gap0 g) g
            LEFT JOIN k_clean b ON b.s = g.s AND b.v = 'c' AND b.pos = bp LEFT JOIN k_clean f ON f.s = g.s AND f.v = 'c' AND f.pos = fp) r) q
JOIN k_clean a ON a.s = q.s AND a.v = 'c' AND a.pos = q.start_pos JOIN k_clean z ON z.s = q.s AND z.v = 'c' AND z.pos = q.end_pos
JOIN k_clean bef ON bef.s = q.s AND bef.v = 'c' AND bef.pos = greatest(0, q.start_pos - 1)
JOIN k_clean aft ON aft.s = q.s AND aft.v = 'c' AND aft.pos = least(q.n - 1, q.end_pos + 1)
""")
cte("k_quality", f"""
SELECT k.s, {', '.join(f'{x}_in / frames_in AS {x}_fraction' for x in P.STATES)},
  (tracked_in + low_confidence_in) / frames_in AS positioned_fraction, (tracked_all + low_confidence_all) / n AS whole_clip_positioned_fraction,
  nj AS nose_judged_fraction, coalesce(gc, 0) AS gap_count, coalesce(lg, 0) AS longest_gap_s, duplicates, drops, drift,
  CASE WHEN (tracked_in + low_confidence_in) / frames_in >= {D['quality']['goodMinPositionedFraction']} THEN 'GOOD'
       WHEN (tracked_in + low_confidence_in) / frames_in < {D['quality']['poorMaxPositionedFraction']} THEN 'POOR' ELSE 'REVIEW' END AS tier
FROM k_scan k LEFT JOIN (SELECT s, count(*) AS gc, greatest(0, max(duration_s)) AS lg FROM k_gaps GROUP BY s) g ON g.s = k.s
LEFT JOIN (SELECT s, avg(CASE WHEN point_used = 'nose' THEN 1.0 ELSE 0.0 END) AS nj FROM k_events WHERE kind <> 'tracking_failure' GROUP BY s) j ON j.s = k.s
""")
# flags
cte("k_flags", f"""
SELECT s, 'correction_out_of_range' AS code, lo_no AS frame_index, NULL::VARCHAR AS event_id, id AS correction_id FROM k_edits e
 WHERE NOT EXISTS (SELECT 1 FROM k_edits_ok o WHERE o.s = e.s AND o.id = e.id)
UNION ALL SELECT c.s, 'correction_out_of_range', lo_no, NULL, id FROM k_corr c JOIN k_start t ON t.s = c.s AND t.v = 'c' AND t.fixed_id = c.id
 WHERE kind = 'trial_start' AND lo_no - off NOT BETWEEN 0 AND c.n - 1
UNION ALL SELECT e.s, CASE WHEN e.kind = 'tracking_failure' THEN 'tracking_failure_at_hole' ELSE 'physically_unlikely_entry' END, e.start_no, e.event_id, NULL
 FROM k_evc e JOIN k_runs r ON r.s = e.s AND r.v = e.v AND r.run = e.run
 WHERE e.kind = 'investigation' OR (e.kind = 'escape_entry' AND marked AND box_px > {ESC_PX}) OR (e.kind = 'tracking_failure' AND e.hole IS NOT NULL)
UNION ALL SELECT s, 'auto_event_removed_by_correction', start_no, event_id, NULL FROM k_removed
UNION ALL SELECT s, 'oversized_in_trial', oversized_no, NULL, NULL FROM k_scan WHERE oversized_in > 0
UNION ALL SELECT c.s, 'orphaned_correction', CASE WHEN kind = 'range' THEN lo_no END, NULL, id FROM k_corr c JOIN k_videos v ON v.s = c.s
 WHERE trial_type = 'probe' AND (range_type = 'in_escape_box' OR kind = 'no_escape')
UNION ALL SELECT s, 'orphaned_correction', NULL, 'auto-investigation-hx-f1', id FROM k_corr WHERE kind = 'event' AND what = 'delete'
UNION ALL SELECT c.s, CASE WHEN any_value(b.end_reason) = 'escape' OR bool_or(e.duration_s >= {ESC['persistCutoff_s']} OR e.last_pos = b.n - 1)
   THEN 'no_escape_contradicted' ELSE 'non_persistent_entry_noted' END, min(e.start_no), NULL, any_value(c.id)
 FROM k_corr c JOIN k_videos v ON v.s = c.s AND trial_type <> 'probe' JOIN k_events e ON e.s = c.s AND e.kind = 'escape_entry'
 JOIN k_bounds b ON b.s = c.s AND b.v = 'c' WHERE c.kind = 'no_escape' GROUP BY c.s
""")
cte("k_counts", """
SELECT s, sum(k)::INT AS correction_count FROM (SELECT s, count(*) AS k FROM k_corr GROUP BY s UNION ALL SELECT s, count(*) FROM k_removed GROUP BY s) GROUP BY s
""")
cte("k_in_trial", """
SELECT e.*, b.from_t, b.end_t AS trial_end_t FROM k_events e JOIN k_ends b ON b.s = e.s AND b.v = 'c' AND e.start_t BETWEEN b.from_t AND b.end_t
""")
cte("k_errors", """
SELECT s, min(start_t) FILTER (WHERE is_target AND kind <> 'tracking_failure') - any_value(from_t) AS primary_latency_s,
  count(*) FILTER (WHERE kind = 'investigation' AND NOT is_target) AS total_errors,
  count(*) FILTER (WHERE kind = 'investigation' AND NOT is_target AND (tf IS NULL OR start_no < tf)) AS primary_errors
FROM (SELECT *, min(start_no) FILTER (WHERE is_target AND kind <> 'tracking_failure') OVER (PARTITION BY s) AS tf FROM k_in_trial) GROUP BY s
""")
cte("k_metrics", f"""
SELECT v.s, v.session_id, v.video_id, b.from_t AS trial_start_s, primary_latency_s,
  CASE WHEN v.trial_type <> 'probe' AND e.end_reason = 'escape' THEN e.end_t - e.from_t END AS total_latency_s,
  CASE WHEN e.end_pos IS NOT NULL THEN coalesce(primary_errors, 0) END::INT AS primary_errors,
  CASE WHEN e.end_pos IS NOT NULL THEN coalesce(total_errors, 0) END::INT AS total_errors,
  path_cm, path_smoothed_cm, mean_speed_cm_s, sector_time_s,
  CASE WHEN overridden THEN 'serial' ELSE auto_strategy END AS strategy, CASE WHEN overridden THEN 'corrected' ELSE 'auto' END AS strategy_source,
  CASE WHEN v.trial_type <> 'probe' AND e.end_pos IS NOT NULL THEN e.end_reason = 'escape' END AS escaped,
  CASE WHEN v.trial_type <> 'probe' THEN ne.s IS NOT NULL END AS no_escape_confirmed, ne.reviewer AS confirmed_by,
  CASE WHEN e.end_pos IS NULL THEN 'unresolved'
       WHEN coalesce(hard, 0) > 0 OR (v.trial_type <> 'probe' AND e.end_reason <> 'escape' AND ne.s IS NULL) THEN 'review' ELSE 'ok' END AS status,
  CASE WHEN e.end_pos IS NOT NULL THEN tracked_in / frames_in END AS tracked_fraction, coalesce(correction_count, 0) AS correction_count
FROM k_videos v JOIN k_cut b ON b.s = v.s AND b.v = 'c' JOIN k_ends e ON e.s = v.s AND e.v = 'c' LEFT JOIN k_errors er ON er.s = v.s
LEFT JOIN k_kin kk ON kk.s = v.s LEFT JOIN k_class kc ON kc.s = v.s LEFT JOIN k_scan ks ON ks.s = v.s LEFT JOIN k_counts cc ON cc.s = v.s
LEFT JOIN (SELECT s, reviewer FROM k_corr WHERE kind = 'no_escape') ne ON ne.s = v.s
LEFT JOIN (SELECT s, count(*) AS hard FROM k_flags WHERE code NOT IN ('auto_event_removed_by_correction', 'non_persistent_entry_noted') GROUP BY s) h ON h.s = v.s
""")
