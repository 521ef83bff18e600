"""Queries over candidates, pixels, sample tables, fits, documents, the corrections layer and incremental runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import cohort as C
from catalog import twin_derive as TD
from catalog.derived import JV, V
from catalog.registry import query, rd, rp, srd, srp
from catalog.twin import CX, CY, PXCM, R, cte
from wayfare import params as P
from wayfare.functions import geometry as G
from wayfare.operators import background as BG
from wayfare.operators import correction_edits as CE
from wayfare.operators import corrections as CO
from wayfare.operators import fits as FT
from wayfare.operators import geometry as GE
from wayfare.operators import selection as SE
from wayfare.operators import timebase as TB
from wayfare.operators.timeline import KEY
from wayfare.plans import incremental as INC
from wayfare.session import chunk_frames, materialise, materialise_plain
from catalog import benchmark as B
from wayfare.sources import exports as EX
from wayfare.sources import intake as IN
from wayfare.sources import session_json as SJ
from wayfare.sources import session_parts as SP

# candidates
_blob = [
    (0, "ok", "area", 0.0, 0.0), (1, "ok AND ((n + s) % 23 = 0 OR n % 200 BETWEEN 100 AND 119)", "300.0", 60.0, 5.0),
    (2, "ok AND n % 200 = 110", "200.0", 15.0, -20.0), (3, "ok AND (n + 2 * s) % 31 = 0", "150.0", 12.0, 7.0),
    (4, "ok AND (n + 3 * s) % 101 = 0", "3000.0", -40.0, 0.0),
]
_blob_sql = " UNION ALL ".join(
    f"SELECT s, n, t, {i} AS fi, ({a})::DOUBLE AS area, x + {dx}::DOUBLE AS cx, y + {dy}::DOUBLE AS cy FROM f WHERE {w}" for i, w, a, dx, dy in _blob
)
cte("k_blob0", f"""WITH f AS (SELECT s, pos AS n, t_s AS t, c_valid AS ok, x, y, area FROM k_frames)
{_blob_sql} UNION ALL SELECT s, n, t, 5, 40.0, 322.0, 240.0 FROM f WHERE NOT ok AND n % 13 = 5""")
cte("k_blobs", f"""SELECT *, sqrt((cx - {CX}) ** 2 + (cy - {CY}) ** 2) >= {R} - {B.PX_PER_CM} AS rim, 60.0 + n % 50 AS mean_diff, n % 9 AS tp,
  area * cx AS sum_x, area * cy AS sum_y, area * (area / 20 + cx * cx) AS sum_xx, area * (area / 40 + cy * cy) AS sum_yy, area * (area * ((n % 5 - 2) / 160.0::DOUBLE) + cx * cy) AS sum_xy FROM k_blob0""")
T = P.DEFAULTS["tracking"]
A2 = f"({PXCM} * {PXCM})"
cte("k_cand", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, n ORDER BY area DESC, fi) - 1 AS rank FROM k_blobs WHERE area >= {T['minBlobArea_cm2']} * {A2})""")


def _ellipse(p: str = "") -> str:
    g = lambda c: f"{p}{c}"
    cx, cy = f"({g('sum_x')} / {g('area')})", f"({g('sum_y')} / {g('area')})"
    xx, yy, xy = f"({g('sum_xx')} / {g('area')} - {cx} * {cx} + 1.0::DOUBLE / 12)", f"({g('sum_yy')} / {g('area')} - {cy} * {cy} + 1.0::DOUBLE / 12)", f"({g('sum_xy')} / {g('area')} - {cx} * {cy})"
    spread = f"sqrt((({xx} - {yy}) / 2) ** 2 + {xy} * {xy})"
    return f"""{cx} AS ecx, {cy} AS ecy, cos(0.5::DOUBLE * atan2(2 * {xy}, {xx} - {yy})) AS ux, sin(0.5::DOUBLE * atan2(2 * {xy}, {xx} - {yy})) AS uy,
      2 * sqrt(({xx} + {yy}) / 2 + {spread}) AS major, 2 * sqrt(greatest(0, ({xx} + {yy}) / 2 - {spread})) AS minor"""


cte("k_union", f"""SELECT s, n, area, {_ellipse()}, rim, diff / area AS mean_diff FROM (SELECT s, n, sum(area) AS area, bool_or(rim) AS rim, sum(mean_diff * area) AS diff, sum(sum_x) AS sum_x, sum(sum_y) AS sum_y,
  sum(sum_xx) AS sum_xx, sum(sum_yy) AS sum_yy, sum(sum_xy) AS sum_xy FROM k_cand c WHERE NOT EXISTS (SELECT 1 FROM k_cand a JOIN k_cand b ON b.s = a.s AND b.n = a.n WHERE a.s = c.s AND a.n = c.n
  AND (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 > ({T['fragmentMergeDistance_cm']} * {PXCM}) ** 2) GROUP BY s, n HAVING count(*) >= 2)""")
cte("k_expected", f"""SELECT v.s, list_sort(list(a) FILTER (WHERE a IS NOT NULL))[((count(a) + 1) // 2)::INT] AS expected FROM k_sup v LEFT JOIN
  (SELECT s, n, max(area) AS a FROM k_cand GROUP BY s, n HAVING count(*) = 1 AND max(area) BETWEEN {T['minBlobArea_cm2']} * {A2} AND {T['maxBlobArea_cm2']} * {A2}) c ON c.s = v.s GROUP BY v.s""")
cte("k_obs", f"""SELECT f.s, f.pos AS n, f.t_s AS t, expected, least({T['maxBlobArea_cm2']} * {A2}, coalesce({T['oversizedBlobFactor']} * expected, 1e18)) AS lim,
  coalesce(cs, []) AS cs, u.s IS NOT NULL AS has_u, u.area AS u_area, u.ecx AS u_x, u.ecy AS u_y FROM k_frames f JOIN k_expected e ON e.s = f.s
  LEFT JOIN (SELECT s, n, list({{'r': rank::INT, 'a': area, 'x': cx, 'y': cy, 'rim': rim}} ORDER BY rank) AS cs FROM k_cand GROUP BY s, n) c ON c.s = f.s AND c.n = f.pos
  LEFT JOIN k_union u ON u.s = f.s AND u.n = f.pos""")
_near = f"list_filter(e.cs, lambda c: (c.x - acc.px) ** 2 + (c.y - acc.py) ** 2 <= ({T['proximityRadius_cm']} * {PXCM}) ** 2)"
_pick = f"(CASE WHEN len(e.cs) >= 2 THEN CASE WHEN acc.px IS NOT NULL AND len({_near}) = 1 THEN {_near}[1] END ELSE e.cs[1] END)"
cte("k_sel0", f"""SELECT s, list_reduce(list({{'n': n::INT, 'cs': cs, 'big': len(list_filter(cs, lambda c: c.a > lim)) > 0, 'mer': len(cs) >= 2 AND has_u AND u_area <= lim, 'ux': u_x, 'uy': u_y, 'ex': expected}} ORDER BY n),
  lambda acc, e: CASE WHEN e.big OR len(e.cs) = 0 THEN {{'px': acc.px, 'py': acc.py, 'out': list_append(acc.out, {{'n': e.n, 'r': -1, 'why': CASE WHEN e.big THEN 'oversized_blob' ELSE 'no_foreground' END, 'x': NULL::DOUBLE, 'y': NULL::DOUBLE}})}}
    WHEN e.mer THEN {{'px': e.ux, 'py': e.uy, 'out': list_append(acc.out, {{'n': e.n, 'r': -2, 'why': 'fragmented', 'x': e.ux, 'y': e.uy}})}}
    WHEN {_pick} IS NULL THEN {{'px': acc.px, 'py': acc.py, 'out': list_append(acc.out, {{'n': e.n, 'r': -1, 'why': 'multiple_blobs', 'x': NULL::DOUBLE, 'y': NULL::DOUBLE}})}}
    ELSE {{'px': {_pick}.x, 'py': {_pick}.y, 'out': list_append(acc.out, {{'n': e.n, 'r': {_pick}.r, 'why': CASE WHEN {_pick}.rim THEN 'partial_at_rim' WHEN {_pick}.a < {T['smallBlobFactor']} * e.ex THEN 'small_blob'
       WHEN len(e.cs) >= 2 THEN 'proximity_to_previous' ELSE 'single_blob' END, 'x': {_pick}.x, 'y': {_pick}.y}})}} END,
  {{'px': NULL::DOUBLE, 'py': NULL::DOUBLE, 'out': []::STRUCT(n INT, r INT, why VARCHAR, x DOUBLE, y DOUBLE)[]}}) AS f FROM k_obs GROUP BY s""")
cte("k_sel", "SELECT s, o.n AS n, o.r AS rank, o.why AS reason, o.x AS x, o.y AS y, false AS nearr0 FROM (SELECT s, unnest(f.out) AS o FROM k_sel0)")
_state = "CASE WHEN reason IN ('single_blob', 'proximity_to_previous') THEN 'tracked' WHEN reason = 'no_foreground' THEN 'not_detected' WHEN reason IN ('multiple_blobs', 'oversized_blob') THEN 'ambiguous' ELSE 'low_confidence' END"
cte("k_picked", f"""SELECT q.*, t, {_state} AS state, expected, coalesce(c.area, u.area) AS area, coalesce(c.mean_diff, u.mean_diff) AS mean_diff, coalesce(c.rim, u.rim) AS rim, q.rank >= 0 AND len(o.cs) >= 2 AS nearr,
  coalesce(c.ux, u.ux) AS ux, coalesce(c.uy, u.uy) AS uy, coalesce(c.major, u.major) AS major, CASE WHEN q.rank >= 0 THEN c.tp ELSE 0 END AS tp
  FROM k_sel q JOIN k_obs o ON o.s = q.s AND o.n = q.n LEFT JOIN (SELECT s, n, rank, area, mean_diff, rim, tp, {_ellipse()} FROM k_cand) c ON c.s = q.s AND c.n = q.n AND c.rank = q.rank
  LEFT JOIN k_union u ON u.s = q.s AND u.n = q.n AND q.rank = -2""")

_tracked: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _tracking(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Candidates, their unions and the selection, prepared once per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _tracked:
        i, geo, p = C.inputs(spark, sf), C.clean(spark, sf)["geometry"], C.params()
        px = materialise_plain(SE.pixel_thresholds(geo, p), "thresholds")  # a few numbers a video, read beside all blobs
        cand = materialise(SE.rank_candidates(B.blobs(i.frames), px), "candidates")
        unions = materialise(SE.fragment_unions(cand, px), "unions")
        expected = materialise_plain(SE.expected_areas(cand, px), "expected")
        size = chunk_frames(spark)
        frames = i.frames.select(*KEY, (F.col("pos") / size).cast("int").alias("chunk"), "pos", F.col("pos").alias("frame_index"), F.col("t_s").alias("t"))
        selected = materialise(SE.select(SE.observations(frames, cand, unions), px, expected, p), "selected")
        _tracked[key] = {"px": px, "cand": cand, "unions": unions, "expected": expected, "selected": selected, "picked": _picked(selected, cand, unions, expected)}
    return _tracked[key]


def _picked(selected: DataFrame, cand: DataFrame, unions: DataFrame, expected: DataFrame) -> DataFrame:
    """Each frame's selection with the measures of the chosen blob."""
    e = SE.ellipse(*[F.col(c) for c in ("area", "sum_x", "sum_y", "sum_xx", "sum_yy", "sum_xy")])
    c = cand.withColumn("e", e).select(*KEY, "frame_index", "rank", "area", "mean_diff", "rim", "tail_pixels", "e.ux", "e.uy", "e.major")
    u = unions.select(*KEY, "frame_index", F.lit(-2).alias("rank"), "area", "mean_diff", "rim", F.lit(0).alias("tail_pixels"), "ux", "uy", "major")
    return (
        selected.join(c.unionByName(u), [*KEY, "frame_index", "rank"], "left")
        .join(expected, KEY)
        .withColumn("state", SE.state_of(F.col("reason")))
    )


@query("tracking_pixel_thresholds", f"""SELECT {V}, {srd(f"{R} + {T['platformMaskMargin_cm']} * {PXCM}", 'mask_px')}, {srd(f"{R} - {T['rimContactMargin_cm']} * {PXCM}", 'rim_px')}, {srd(f"{T['minBlobArea_cm2']} * {A2}", 'min_area')},
  {srd(f"{T['maxBlobArea_cm2']} * {A2}", 'max_area')}, {srd(f"{T['proximityRadius_cm']} * {PXCM}", 'near_px')}, {srd(f"{T['fragmentMergeDistance_cm']} * {PXCM}", 'merge_px')}, {srd(f"{T['noseMovingSpeed_cmPerS']} * {PXCM}", 'moving_px_s')} FROM k_sup""")
def tracking_pixel_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    px = SE.pixel_thresholds(C.clean(spark, sf)["geometry"], C.params())
    return px.select(*KEY, *[rd(c).alias(c) for c in ("mask_px", "rim_px", "min_area", "max_area", "near_px", "merge_px", "moving_px_s")])


@query("tracking_candidates", f"SELECT {V}, n AS frame_index, rank, {srp('cx', 'cx')}, {srp('cy', 'cy')}, area FROM k_cand q {JV}")
def tracking_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The ranked blobs of every frame."""
    return _tracking(spark, sf)["cand"].select(*KEY, "frame_index", "rank", rp("cx").alias("cx"), rp("cy").alias("cy"), "area")


@query("tracking_ellipses", f"SELECT {V}, n AS frame_index, rank, {srd('major', 'major', 3)}, {srd('minor', 'minor', 3)}, {srd('abs(ux)', 'ux', 3)}, {srd('abs(uy)', 'uy', 3)} FROM (SELECT s, n, rank, {_ellipse()} FROM k_cand) q {JV}")
def tracking_ellipses(spark: SparkSession, sf: str) -> DataFrame:
    """Body ellipse of every candidate from its moments."""
    e = SE.ellipse(*[F.col(c) for c in ("area", "sum_x", "sum_y", "sum_xx", "sum_yy", "sum_xy")])
    d = _tracking(spark, sf)["cand"].withColumn("e", e)
    return d.select(*KEY, "frame_index", "rank", rd("e.major", 3).alias("major"), rd("e.minor", 3).alias("minor"), rd(F.abs("e.ux"), 3).alias("ux"), rd(F.abs("e.uy"), 3).alias("uy"))


@query("tracking_unions", f"SELECT {V}, n AS frame_index, area, {srd('ecx', 'cx', 3)}, {srd('ecy', 'cy', 3)}, {srd('major', 'major', 3)}, rim, {srd('mean_diff', 'mean_diff', 4)} FROM k_union q {JV}")
def tracking_unions(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments close enough to be one body."""
    u = _tracking(spark, sf)["unions"]
    return u.select(*KEY, "frame_index", "area", rd("cx", 3).alias("cx"), rd("cy", 3).alias("cy"), rd("major", 3).alias("major"), "rim", rd("mean_diff", 4).alias("mean_diff"))


@query("tracking_expected_area", f"SELECT {V}, expected AS expected_area, CASE WHEN expected IS NULL THEN 'unavailable' ELSE 'learned' END AS area_source FROM k_expected q {JV}")
def tracking_expected_area(spark: SparkSession, sf: str) -> DataFrame:
    return _tracking(spark, sf)["expected"]


@query("tracking_selection", f"SELECT {V}, n AS frame_index, reason, rank, {srp('x', 'x')}, {srp('y', 'y')} FROM k_sel q {JV}")
def tracking_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The selection of every frame."""
    s = _tracking(spark, sf)["selected"]
    return s.select(*KEY, "frame_index", "reason", "rank", rp("x").alias("x"), rp("y").alias("y"))


_unit = lambda e: f"greatest(0, least(1, {e}))"
_conf = f"""{_unit('1 - greatest(0, abs(area / expected - 1) - 0.5) / 0.5')} * {_unit('mean_diff / (2.0 * 40)')} * CASE WHEN nearr THEN 0.7 ELSE 1 END * CASE WHEN rim THEN 0.7 ELSE 1 END * CASE WHEN rank = -2 THEN 0.7 ELSE 1 END"""


@query("tracking_confidence", f"SELECT {V}, n AS frame_index, {srd(_conf, 'confidence')} FROM k_picked q {JV} WHERE area IS NOT NULL")
def tracking_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of every chosen blob under a threshold of 40."""
    d = _tracking(spark, sf)["picked"].filter(F.col("area").isNotNull())
    c = SE.confidence(F.col("area"), F.col("mean_diff"), F.col("near"), F.col("rim"), F.col("rank") == -2, F.col("expected_area"), F.lit(40.0))
    return d.select(*KEY, "frame_index", rd(c).alias("confidence"))


def _noses(spark: SparkSession, sf: str) -> DataFrame:
    t = _tracking(spark, sf)
    d = t["picked"]
    x, y, m = F.col("x"), F.col("y"), F.col("major")
    ux, uy, k = F.col("ux"), F.col("uy"), F.col("tail_pixels")
    tail = SE.tail_direction(x, y, (x - 0.8 * m * ux) * k, (y - 0.8 * m * uy) * k, k, m)
    shape = F.when(
        F.col("area").isNotNull(),
        F.struct(
            x.alias("cx"), y.alias("cy"), ux.alias("ux"), uy.alias("uy"), (x + m * ux).alias("ax"), (y + m * uy).alias("ay"),
            (x - m * ux).alias("bx"), (y - m * uy).alias("by"), tail.alias("tail"),
        ),
    )
    shapes = d.select(*KEY, "chunk", "pos", "t", shape.alias("shape"))
    return SE.assign_nose(shapes, t["px"], C.clean(spark, sf)["geometry"], C.params())


cte("k_shape", """SELECT s, n, t, area IS NOT NULL AS ok, x AS cx, y AS cy, ux, uy, x + major * ux AS ax, y + major * uy AS ay, x - major * ux AS bx, y - major * uy AS by_, tp >= 4 AS has_tail FROM k_picked""")
cte("k_cue", f"""SELECT q.*, (zx - ax0) / dt AS vx, (zy - ay0) / dt AS vy, sqrt(((zx - ax0) / dt) ** 2 + ((zy - ay0) / dt) ** 2) AS speed FROM (SELECT c.*, CASE WHEN z.t - a.t > 0 THEN z.t - a.t END AS dt, a.cx AS ax0, a.cy AS ay0, z.cx AS zx, z.cy AS zy
  FROM (SELECT c.*, (SELECT min(n) FROM k_shape b WHERE b.s = c.s AND b.ok AND b.n BETWEEN c.n - 3 AND c.n - 1) AS pa, (SELECT max(n) FROM k_shape b WHERE b.s = c.s AND b.ok AND b.n BETWEEN c.n + 1 AND c.n + 3) AS pz FROM k_shape c) c
  LEFT JOIN k_shape a ON a.s = c.s AND a.n = c.pa LEFT JOIN k_shape z ON z.s = c.s AND z.n = c.pz) q""")
_sg = lambda dx, dy: f"(CASE WHEN abs(ux * {dx} + uy * {dy}) < 0.5 THEN 0 WHEN ux * {dx} + uy * {dy} > 0 THEN 1 ELSE -1 END)"
cte("k_nose", f"""SELECT *, CASE WHEN len(signs) = 0 OR NOT ok THEN 0.0 WHEN len(list_distinct(signs)) > 1 THEN 0.0 WHEN len(signs) >= 2 THEN 1.0 ELSE 0.5 END AS conf FROM (
  SELECT q.*, list_filter([CASE WHEN ok AND has_tail THEN 1 ELSE 0 END, CASE WHEN ok AND speed >= {T['noseMovingSpeed_cmPerS']} * {PXCM} THEN {_sg('vx / speed', 'vy / speed')} ELSE 0 END,
    CASE WHEN ok AND speed < {T['noseMovingSpeed_cmPerS']} * {PXCM} AND bh.d <= 1.5 * {TD.HR} AND sqrt((bh.x - cx) ** 2 + (bh.y - cy) ** 2) > 0 THEN {_sg('(bh.x - cx) / sqrt((bh.x - cx) ** 2 + (bh.y - cy) ** 2)', '(bh.y - cy) / sqrt((bh.x - cx) ** 2 + (bh.y - cy) ** 2)')} ELSE 0 END], lambda v: v <> 0) AS signs
  FROM (SELECT c.*, (SELECT arg_min({{'d': least(sqrt((c.ax - hx) ** 2 + (c.ay - hy) ** 2), sqrt((c.bx - hx) ** 2 + (c.by_ - hy) ** 2)), 'x': hx, 'y': hy}}, (least(sqrt((c.ax - hx) ** 2 + (c.ay - hy) ** 2), sqrt((c.bx - hx) ** 2 + (c.by_ - hy) ** 2)), k)) FROM k_holes) AS bh FROM k_cue c) q)""")


@query("tracking_nose", f"SELECT {V}, n AS frame_index, ok AND len(signs) > 0 AS nose_valid, conf AS heading_confidence, coalesce(ok AND speed >= {T['noseMovingSpeed_cmPerS']} * {PXCM}, false) AS moving, {srd('CASE WHEN ok THEN speed END', 'speed_px_s', 3)} FROM k_nose q {JV}")
def tracking_nose(spark: SparkSession, sf: str) -> DataFrame:
    """Nose end, its confidence and the speed it was judged at."""
    return _noses(spark, sf).select(*KEY, F.col("pos").alias("frame_index"), "nose_valid", "heading_confidence", "moving", rd("speed_px_s", 3).alias("speed_px_s"))


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    d = _tracking(spark, sf)["picked"].join(_noses(spark, sf).drop("chunk"), [*KEY, "pos"])
    return SE.track_summary(d)


_sum_cols = ", ".join(f"count(*) FILTER (WHERE p.state = '{s}') AS n_{s}" for s in P.STATES) + ", " + ", ".join(f"count(*) FILTER (WHERE p.reason = '{r}') AS n_{r}" for r in SE.STATE_OF)


@query("tracking_summary", f"""SELECT {V}, count(*) AS frames, {_sum_cols}, count(*) FILTER (WHERE p.area IS NOT NULL AND conf >= 1) AS nose_c1, count(*) FILTER (WHERE p.area IS NOT NULL AND conf = 0.5) AS nose_c05, count(*) FILTER (WHERE p.area IS NOT NULL AND conf < 0.5) AS nose_c0,
  count(*) FILTER (WHERE p.area IS NOT NULL AND speed >= {T['noseMovingSpeed_cmPerS']} * {PXCM}) AS moving_frames, list_sort(list(p.area) FILTER (WHERE p.state = 'tracked'))[((count(*) FILTER (WHERE p.state = 'tracked') + 1) // 2)::INT] AS median_area
  FROM k_picked p JOIN k_nose q ON q.s = p.s AND q.n = p.n {JV} GROUP BY {V}""")
def tracking_summary(spark: SparkSession, sf: str) -> DataFrame:
    """States, reasons, nose confidence and median area of each track."""
    return _summary(spark, sf).drop("moving_c1", "moving_c05", "moving_c0")


@query("tracking_learned_area", f"""SELECT session_id, round(arg_min(m / {A2}, s), 6) + 0.0::DOUBLE AS area_cm2 FROM (SELECT v.session_id, v.s, list_sort(list(p.area) FILTER (WHERE p.state = 'tracked'))[((count(*) FILTER (WHERE p.state = 'tracked') + 1) // 2)::INT] AS m, any_value(expected) AS e
  FROM k_picked p JOIN k_sup v ON v.s = p.s GROUP BY v.session_id, v.s) WHERE e IS NOT NULL AND m IS NOT NULL GROUP BY session_id""")
def tracking_learned_area(spark: SparkSession, sf: str) -> DataFrame:
    """The body area each cohort learned first, offered to its other videos."""
    t = _tracking(spark, sf)
    return SE.learned_areas(_summary(spark, sf), t["expected"], t["px"], C.inputs(spark, sf).videos).select("session_id", rd("area_cm2").alias("area_cm2"))


def _lost(spark: SparkSession, sf: str) -> DataFrame:
    size = chunk_frames(spark)
    f = C.inputs(spark, sf).frames.select(
        *KEY, (F.col("pos") / size).cast("int").alias("chunk"), "pos", "frame_index", F.col("t_s").alias("t"), F.col("detection_state").alias("state"),
        F.col("centroid.valid").alias("valid"), F.col("centroid.x").alias("x"), F.col("centroid.y").alias("y"),
    )
    return SE.not_detected_runs(f)


cte("k_lost", """SELECT r.*, coalesce(b.t_s - t0, t1 - t0 + coalesce(t0 - a.t_s, 0)) AS dur, (SELECT max(pos) FROM k_frames f WHERE f.s = r.s AND f.c_valid AND f.pos < r.lo) AS lp FROM
  (SELECT s, min(pos) AS lo, max(pos) AS hi, min(frame_index) AS fa, max(frame_index) AS fz, min(t_s) AS t0, max(t_s) AS t1, count(*) AS frames FROM (SELECT *, pos - row_number() OVER (PARTITION BY s ORDER BY pos) AS g FROM k_frames WHERE state = 'not_detected') GROUP BY s, g) r
  LEFT JOIN k_frames b ON b.s = r.s AND b.pos = r.hi + 1 LEFT JOIN k_frames a ON a.s = r.s AND a.pos = r.lo - 1""")
cte("k_longest", "SELECT s, count(*) AS gaps, arg_max({'a': fa, 'z': fz, 'f': frames, 'd': dur, 't': t0, 'lp': lp}, (frames, -lo)) AS b FROM k_lost GROUP BY s")


@query("tracking_longest_loss", f"""SELECT {V}, gaps, b.a AS start_frame, b.z AS end_frame, b.f AS frames, {srd('b.d', 'duration_s')}, f.frame_index AS last_frame, {srp('f.x', 'last_x')} FROM k_longest q LEFT JOIN k_frames f ON f.s = q.s AND f.pos = q.b.lp JOIN (SELECT s AS vs, session_id AS sid, video_id AS vid FROM k_sup) vv ON vv.vs = q.s""".replace(V, "sid AS session_id, vid AS video_id"))
def tracking_longest_loss(spark: SparkSession, sf: str) -> DataFrame:
    """The longest not-detected run of each track, how many there are and where the animal was before it."""
    r = SE.longest_runs(_lost(spark, sf))
    return r.select(*KEY, "gaps", "start_frame", "end_frame", "frames", rd("duration_s").alias("duration_s"), "last_frame", rp("last_x").alias("last_x"))


@query("tracking_summary_line", f"""SELECT {V}, printf('Tracked %.1f%% of frames · %d gap', floor(nt * 1000.0::DOUBLE / n + 0.5) / 10, coalesce(gaps, 0)) || CASE WHEN coalesce(gaps, 0) = 1 THEN '' ELSE 's' END || coalesce(' · longest ' || CASE WHEN b.d < 1 THEN printf('%.2f', b.d) ELSE printf('%.1f', b.d) END || ' s starting at ' || printf('%.2f s', b.t), '') AS line,
  concat_ws(', ', CASE WHEN n0 > 0 THEN n0 || ' not detected' END, CASE WHEN na > 0 THEN na || ' ambiguous' END, CASE WHEN nl > 0 THEN nl || ' low confidence' END, CASE WHEN nt > 0 THEN nt || ' tracked' END) AS states
  FROM (SELECT s, count(*) AS n, count(*) FILTER (WHERE state = 'tracked') AS nt, count(*) FILTER (WHERE state = 'not_detected') AS n0, count(*) FILTER (WHERE state = 'ambiguous') AS na, count(*) FILTER (WHERE state = 'low_confidence') AS nl FROM k_frames GROUP BY s) q LEFT JOIN k_longest l ON l.s = q.s {JV}""")
def tracking_summary_line(spark: SparkSession, sf: str) -> DataFrame:
    f = C.inputs(spark, sf).frames
    s = f.groupBy(*KEY).agg(F.count(F.lit(1)).alias("frames"), *[F.count_if(F.col("detection_state") == x).alias(f"n_{x}") for x in P.STATES])
    return SE.summary_line(s, SE.longest_runs(_lost(spark, sf)))


@query("tracking_background_samples", f"""SELECT {V}, pos FROM (SELECT s, pos, row_number() OVER (PARTITION BY s ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM k_frames WHERE pos NOT BETWEEN 0 AND 74 AND pos NOT BETWEEN 200 + s % 7 AND 260) q
  JOIN (SELECT s AS ks, unnest(range(150)) AS k FROM k_sup) ON ks = s AND i = floor((k + 0.5::DOUBLE) * n / least(150, n)) {JV} WHERE k < least(150, n)""")
def tracking_background_samples(spark: SparkSession, sf: str) -> DataFrame:
    """150 background frames per video, spread over what is not excluded."""
    size = chunk_frames(spark)
    f = C.inputs(spark, sf).frames.select(*KEY, (F.col("pos") / size).cast("int").alias("chunk"), "pos")
    s = F.substring("video_id", 2, 12).cast("int")
    v = C.inputs(spark, sf).videos
    ex = v.select(*KEY, F.lit(0).alias("start_frame"), F.lit(74).alias("end_frame")).unionByName(v.select(*KEY, (200 + s % 7).alias("start_frame"), F.lit(260).alias("end_frame")))
    return BG.sample_frames(f, ex, T["backgroundSampleCount"], size)


cte("k_px", "SELECT label AS video, vec_id AS frame, i - 1 AS pixel, least(255, floor(abs(embedding[i]::DOUBLE) * 100))::INT AS value FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
cte("k_bg", "SELECT video, pixel, list_sort(list(value))[((count(*) + 1) // 2)::INT] AS background FROM k_px GROUP BY video, pixel")
cte("k_hist", "SELECT p.video, greatest(0, background - value)::INT AS bin, count(*) AS pixels FROM k_px p JOIN k_bg b ON b.video = p.video AND b.pixel = p.pixel GROUP BY 1, 2")


@query("background_median", "SELECT video, pixel, background FROM k_bg")
def background_median(spark: SparkSession, sf: str) -> DataFrame:
    """Lower-median background per pixel."""
    return BG.median_background(B.pixels(spark, sf), ["video"])


@query("background_difference_histogram", "SELECT video, bin, pixels FROM k_hist")
def background_difference_histogram(spark: SparkSession, sf: str) -> DataFrame:
    px = B.pixels(spark, sf)
    return BG.difference_histogram(px, BG.median_background(px, ["video"]), ["video"])


@query("background_threshold", """SELECT video, arg_max(bin, (between_, -bin)) + 1 AS threshold FROM (SELECT video, bin, wb * (tot - wb) * (sb / wb - (sm - sb) / (tot - wb)) ** 2 AS between_ FROM (
  SELECT video, bin, (sum(pixels) OVER w)::DOUBLE AS wb, (sum(pixels * bin) OVER w)::DOUBLE AS sb, (sum(pixels) OVER (PARTITION BY video))::DOUBLE AS tot, (sum(pixels * bin) OVER (PARTITION BY video))::DOUBLE AS sm FROM k_hist
  WINDOW w AS (PARTITION BY video ORDER BY bin)) WHERE tot > wb) GROUP BY video""")
def background_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The foreground threshold that splits each histogram best."""
    px = B.pixels(spark, sf)
    return BG.thresholds(BG.difference_histogram(px, BG.median_background(px, ["video"]), ["video"]), ["video"], C.params())


@query("background_contamination", f"""SELECT {V}, n AS frame_index, fi AS first_index, {srd('area / typical', 'ratio')}, (cnt >= 2 AND area / typical >= 1.5) OR (area / typical >= 1 AND area <= {T['maxBlobArea_cm2']} * {A2} AND major / minor >= 1.8) AS flagged FROM
  (SELECT k.*, g.typical, g.cnt FROM (SELECT s, n, fi, area, rim, {_ellipse()} FROM k_blobs WHERE area >= {T['minBlobArea_cm2']} * {A2} AND NOT rim) k
   JOIN (SELECT s, list_sort(list(area))[((count(*) + 1) // 2)::INT] AS typical, count(*) AS cnt FROM k_blobs WHERE area >= {T['minBlobArea_cm2']} * {A2} AND NOT rim GROUP BY s) g ON g.s = k.s) q {JV}""")
def background_contamination(spark: SparkSession, sf: str) -> DataFrame:
    """Blobs too large or too long to be holes, over the blobs of a stand-in background."""
    e = SE.ellipse(*[F.col(c) for c in ("area", "sum_x", "sum_y", "sum_xx", "sum_yy", "sum_xy")])
    b = B.blobs(C.inputs(spark, sf).frames).withColumn("e", e)
    b = b.withColumn("elongation", F.col("e.major") / F.col("e.minor")).join(C.clean(spark, sf)["geometry"].select(*KEY, "px_per_cm"), KEY)
    return BG.contamination(b, C.params()).select(*KEY, "frame_index", "first_index", rd("ratio").alias("ratio"), "flagged")


# timebase from sample tables
cte("k_samp", """SELECT s, CASE WHEN pos % 2 = 0 THEN pos + 1 ELSE pos - 1 END AS di, (pos - (pos + 47) // 97 + pos // 113) * 512 + 1024 AS cts, CASE WHEN pos % 113 = 112 THEN 1024 ELSE 512 END AS dur, pos % 12 = 0 AS sync,
  2 * (pos % 12) + CASE WHEN pos % 50 = 7 THEN 100 ELSE 0 END AS poc, pos // 12 AS gop FROM k_frames""")
cte("k_order", "SELECT *, row_number() OVER (PARTITION BY s ORDER BY cts, gop, poc, di) - 1 AS p, greatest(0, cts - 1024) / 15360.0::DOUBLE AS t FROM k_samp")
cte("k_tick", "SELECT s, arg_max(dur, (c, -dur)) AS tick, sum(c) AS n, sum(c * dur) / 15360.0::DOUBLE AS total FROM (SELECT s, dur, count(*) AS c FROM k_samp GROUP BY s, dur) GROUP BY s")


@query("timebase_presentation_order", f"SELECT {V}, p AS pos, di AS decode_index, {srd('t', 't_s')} FROM k_order q {JV}")
def timebase_presentation_order(spark: SparkSession, sf: str) -> DataFrame:
    """Frames in presentation order with stamps from the sample table."""
    s = B.video_samples(C.inputs(spark, sf).frames)
    return TB.presentation_order(s, TB.nominal_ticks(s), chunk_frames(spark)).select(*KEY, "pos", "decode_index", rd("t_s").alias("t_s"))


@query("timebase_nominal_tick", f"SELECT {V}, tick, {srd('15360.0::DOUBLE / tick', 'nominal_fps')} FROM k_tick q {JV}")
def timebase_nominal_tick(spark: SparkSession, sf: str) -> DataFrame:
    return TB.nominal_ticks(B.video_samples(C.inputs(spark, sf).frames)).select(*KEY, "tick", rd("nominal_fps").alias("nominal_fps"))


@query("timebase_index_anomalies", f"""SELECT {V}, count(*) FILTER (WHERE cts = pc) AS duplicate_pairs, count(*) FILTER (WHERE cts - pc > 1.5 * tick) AS dropped_gaps, {srd('any_value(total) - any_value(n) / (15360.0::DOUBLE / any_value(tick))', 'drift_s')},
  count(*) FILTER (WHERE pg > gop OR (pg = gop AND pp >= poc)) AS order_inversions, bool_or(p = 0 AND NOT sync) AS starts_without_keyframe FROM (SELECT o.*, tick, k.n, total, lag(cts) OVER w AS pc, lag(gop) OVER w AS pg, lag(poc) OVER w AS pp
  FROM k_order o JOIN k_tick k ON k.s = o.s WINDOW w AS (PARTITION BY o.s ORDER BY p)) q {JV} GROUP BY {V}""")
def timebase_index_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Ties, gaps, drift and picture-order inversions of each frame index."""
    s = B.video_samples(C.inputs(spark, sf).frames)
    t = TB.nominal_ticks(s)
    a = TB.anomalies(TB.presentation_order(s, t, chunk_frames(spark)), t, C.params()["kinematics"]["dropGapFactor"])
    return a.select(*KEY, "duplicate_pairs", "dropped_gaps", rd("drift_s").alias("drift_s"), "order_inversions", "starts_without_keyframe")


@query("timebase_event_stream", """SELECT user_id, count(*) AS events, round(median(dt) FILTER (WHERE dt > 0), 4) + 0.0::DOUBLE AS nominal_dt FROM (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dt FROM events) GROUP BY user_id""")
def timebase_event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same nominal step over the irregular event stream: a user stands for a video."""
    from wayfare.operators.clean import nominal_dt
    from wayfare.operators.timeline import renumber

    size = chunk_frames(spark)
    e = spark.read.parquet(f"{sf}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = e.select("user_id", "event_id", t.alias("t"), F.floor(t / 86400.0).cast("int").alias("chunk"))
    numbered = renumber(e.withColumn("place", F.struct("t", "event_id")), size, ["user_id"], "place", name="pos")
    n = numbered.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    return n.join(nominal_dt(numbered, ["user_id"]), "user_id", "left").select("user_id", "events", rd("nominal_dt", 4).alias("nominal_dt"))


# geometry
@query("geometry_hole_ring", f"SELECT 'map-0' AS map_id, k AS hole_index, {srd('hx', 'x', 4)}, {srd('hy', 'y', 4)}, {V} FROM k_holes CROSS JOIN k_sup")
def geometry_hole_ring(spark: SparkSession, sf: str) -> DataFrame:
    """The hole ring of every video."""
    i = C.inputs(spark, sf)
    m = i.videos.select(*KEY, "map_id").join(i.maze_maps.drop("target_hole"), "map_id")
    return GE.hole_ring(m, [*KEY, "map_id"]).select(*KEY, "map_id", "hole_index", rd("x", 4).alias("x"), rd("y", 4).alias("y"))


@query("geometry_placed_maps", f"""SELECT {V}, {srd(f'sc * (cos(radians(a)) * {CX} - sin(radians(a)) * {CY}) + tx', 'cx', 4)}, {srd(f'sc * (sin(radians(a)) * {CX} + cos(radians(a)) * {CY}) - 3', 'cy', 4)}, {srd(f'sc * {R}', 'r', 4)}, {srd('(9 + a) % 360', 'phase_deg', 4)},
  {srd('sc * (cos(radians(a)) * 2 + sin(radians(a)))', 'dx', 4)} FROM (SELECT *, (s % 36) * 10.0::DOUBLE AS a, 1 + (s % 5) / 10.0::DOUBLE AS sc, (s % 7)::DOUBLE AS tx FROM k_sup)""")
def geometry_placed_maps(spark: SparkSession, sf: str) -> DataFrame:
    """The shared map moved into each video by its own transform."""
    i = C.inputs(spark, sf)
    s = F.substring("video_id", 2, 12).cast("bigint")
    t = G.similarity((s % 7).cast("double"), F.lit(-3.0), (s % 36) * F.lit(10.0), 1 + (s % 5) / F.lit(10.0))
    m = i.videos.select(*KEY, "map_id").join(i.maze_maps, "map_id")
    nudge = F.array(F.struct(F.lit(3).alias("hole_index"), F.lit(2.0).alias("dx_px"), F.lit(-1.0).alias("dy_px")))
    p = GE.place_map(m.withColumn("offsets", nudge).withColumn("phase_deg", F.lit(9.0)), t, F.col("resolution"))
    return p.select(*KEY, rd("platform.cx", 4).alias("cx"), rd("platform.cy", 4).alias("cy"), rd("platform.r", 4).alias("r"), rd("phase_deg", 4).alias("phase_deg"), rd(F.col("offsets")[0]["dx_px"], 4).alias("dx"))


_tf = "(s % 7)::DOUBLE"


@query("geometry_transforms", f"""SELECT {V}, {srd('x + 0.0', 'back_x', 4)}, {srd('y + 0.0', 'back_y', 4)}, {srd('((a + 30) % 360)', 'turn', 4)}, {srd('sc * 2', 'scale', 6)} FROM (SELECT *, (s % 36) * 10.0::DOUBLE AS a, 1 + (s % 5) / 10.0::DOUBLE AS sc, 100 + s % 90 AS x, 50 + s % 70 AS y FROM k_sup)""")
def geometry_transforms(spark: SparkSession, sf: str) -> DataFrame:
    """A point taken through a transform and its inverse, and a transform composed with another."""
    s = F.substring("video_id", 2, 12).cast("bigint")
    t = G.similarity((s % 7).cast("double"), F.lit(-3.0), (s % 36) * F.lit(10.0), 1 + (s % 5) / F.lit(10.0))
    v = C.inputs(spark, sf).videos.select(*KEY, t.alias("t")).withColumn("i", G.invert(F.col("t")))
    px, py = (100 + s % 90).cast("double"), (50 + s % 70).cast("double")
    u, w = G.apply_point(F.col("t"), px, py)
    bx, by = G.apply_point(F.col("i"), u, w)
    both = G.compose(G.similarity(F.lit(1.0), F.lit(2.0), F.lit(30.0), F.lit(2.0)), F.col("t"))
    return v.select(*KEY, rd(bx, 4).alias("back_x"), rd(by, 4).alias("back_y"), rd(both["rotation_deg"], 4).alias("turn"), rd(both["scale"]).alias("scale"))


_a, _sc = "((s % 36) * 10.0::DOUBLE)", "(1 + (s % 5) / 10.0::DOUBLE)"


@query("geometry_fit_similarity", f"""SELECT {V}, {srd('((atan2(cr, dt) * 180 / pi()) % 360 + 360) % 360', 'rotation_deg', 3)}, {srd('sqrt(dt * dt + cr * cr) / va', 'scale', 5)}, {srd('mtx - sqrt(dt * dt + cr * cr) / va * (cos(atan2(cr, dt)) * mfx - sin(atan2(cr, dt)) * mfy)', 'translate_x', 2)} FROM (
  SELECT s, sum((x - mfx) * (tx - mtx) + (y - mfy) * (ty - mty)) AS dt, sum((x - mfx) * (ty - mty) - (y - mfy) * (tx - mtx)) AS cr, sum((x - mfx) ** 2 + (y - mfy) ** 2) AS va, any_value(mfx) AS mfx, any_value(mfy) AS mfy, any_value(mtx) AS mtx FROM
  (SELECT *, avg(x) OVER w AS mfx, avg(y) OVER w AS mfy, avg(tx) OVER w AS mtx, avg(ty) OVER w AS mty FROM (SELECT s, x, y, {_sc} * (cos(radians({_a})) * x - sin(radians({_a})) * y) + 5 + (pos % 3) AS tx, {_sc} * (sin(radians({_a})) * x + cos(radians({_a})) * y) - 2 + (pos % 5) / 2.0::DOUBLE AS ty FROM k_frames WHERE c_valid)
   WINDOW w AS (PARTITION BY s)) GROUP BY s) q {JV}""")
def geometry_fit_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The similarity that takes each track onto a turned, scaled and jittered copy of itself."""
    s = F.substring("video_id", 2, 12).cast("bigint")
    f = C.inputs(spark, sf).frames.filter("centroid.valid").select(*KEY, "pos", F.col("centroid.x").alias("fx"), F.col("centroid.y").alias("fy"))
    a, sc = F.radians((s % 36) * F.lit(10.0)), 1 + (s % 5) / F.lit(10.0)
    x, y = F.col("fx"), F.col("fy")
    f = f.withColumn("tx", sc * (F.cos(a) * x - F.sin(a) * y) + 5 + F.col("pos") % 3).withColumn("ty", sc * (F.sin(a) * x + F.cos(a) * y) - 2 + (F.col("pos") % 5) / F.lit(2.0))
    t = FT.fit_similarity(f, KEY)
    return t.select(*KEY, rd("transform.rotation_deg", 3).alias("rotation_deg"), rd("transform.scale", 5).alias("scale"), rd("transform.translate_x", 2).alias("translate_x"))


@query("geometry_fit_circle", f"""WITH c AS (SELECT *, sxx * syy - sxy * sxy AS det FROM (SELECT s, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(u * u) AS sxx, sum(v * v) AS syy, sum(u * v) AS sxy, sum(u * (u * u + v * v)) AS sxq, sum(v * (u * u + v * v)) AS syq, sum(u * u + v * v) AS sq FROM
  (SELECT *, x - avg(x) OVER w AS u, y - avg(y) OVER w AS v, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM k_frames WHERE c_valid WINDOW w AS (PARTITION BY s)) GROUP BY s)),
  f AS (SELECT s, n, (syy * sxq - sxy * syq) / (2 * det) AS cx, (sxx * syq - sxy * sxq) / (2 * det) AS cy, sq, mx, my FROM c)
  SELECT {V}, {srd('any_value(cx + mx)', 'cx', 3)}, {srd('any_value(cy + my)', 'cy', 3)}, {srd('any_value(sqrt(cx * cx + cy * cy + sq / f.n))', 'r', 3)}, {srd('sqrt(avg((sqrt((k.x - cx - mx) ** 2 + (k.y - cy - my) ** 2) - sqrt(cx * cx + cy * cy + sq / f.n)) ** 2))', 'rms_px', 3)} FROM f JOIN k_frames k ON k.s = f.s AND k.c_valid GROUP BY {V}""")
def geometry_fit_circle(spark: SparkSession, sf: str) -> DataFrame:
    """The circle through each track's positions."""
    f = C.inputs(spark, sf).frames.filter("centroid.valid").select(*KEY, F.col("centroid.x").alias("x"), F.col("centroid.y").alias("y"))
    c = FT.fit_circle(f, KEY)
    return c.select(*KEY, rd("cx", 3).alias("cx"), rd("cy", 3).alias("cy"), rd("r", 3).alias("r"), rd("rms_px", 3).alias("rms_px"))


_clk = "((s * 37) % 360 + 0.25::DOUBLE)"
_dd = f"((({_clk} - 9) % 360 + 360) % 360)"


@query("geometry_ring_alignment", f"""SELECT {V}, {srd(f"(({_clk} - floor((CASE WHEN {_dd} > 180 THEN {_dd} - 360 ELSE {_dd} END) / 18 + 0.5) * 18) % 360 + 360) % 360", 'phase_deg', 4)}, ((((s % 20 - 7) % 20 + 20) % 20 + 10) % 20 - 10)::BIGINT AS holes FROM k_sup""")
def geometry_ring_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """The ring phase after a click, and the whole holes between the target and a clicked hole."""
    s = F.substring("video_id", 2, 12).cast("bigint")
    click = (s * 37) % 360 + F.lit(0.25)
    n = F.lit(20)
    return C.inputs(spark, sf).videos.select(
        *KEY, rd(FT.phase_for_click(F.lit(9.0), n, click), 4).alias("phase_deg"), FT.target_turn(n, F.lit(7), s % 20).cast("bigint").alias("holes")
    )


@query("geometry_targets_kept", f"SELECT {V}, CASE WHEN own_target AND 3 < 3 THEN 3 END::INT AS target_hole FROM k_videos")
def geometry_targets_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Own targets after a change to a map with three holes: hole 3 is gone."""
    return GE.drop_missing_targets(C.inputs(spark, sf).videos, F.lit(3)).select(*KEY, "target_hole")


# corrections layer
@query("corrections_order", f"SELECT {V}, id, row_number() OVER (PARTITION BY s ORDER BY ts, id) AS place FROM k_corr")
def corrections_order(spark: SparkSession, sf: str) -> DataFrame:
    """The order in which corrections apply."""
    from pyspark.sql import Window

    return C.inputs(spark, sf).corrections.select(*KEY, "id", F.row_number().over(Window.partitionBy(*KEY).orderBy("timestamp", "id")).alias("place"))


@query("corrections_latest", f"SELECT {V}, kind, arg_max(id, ts || '|' || id) AS id FROM k_corr WHERE kind IN ('trial_start', 'strategy_override', 'no_escape') GROUP BY {V}, kind")
def corrections_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The correction of each single kind that stands."""
    c = C.inputs(spark, sf).corrections
    parts = [CO.latest(c, k).select(*KEY, "kind", "id") for k in ("trial_start", "strategy_override", "no_escape")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    """Range marks and clears by rule over every video."""
    s = F.substring("video_id", 2, 12).cast("int")
    v = C.inputs(spark, sf).videos.select(*KEY)
    item = lambda i, t, a, z: F.struct(F.format_string(f"m{i}-%d", s).alias("id"), F.lit(f"2026-02-0{i}").alias("timestamp"), t.alias("range_type"), a.cast("int").alias("start_frame"), z.cast("int").alias("end_frame"))
    nv, eb, none = F.lit("not_visible"), F.lit("in_escape_box"), F.lit(None).cast("string")
    return v.select(*KEY, F.inline(F.array(
        item(1, nv, s % 50, s % 50 + 900), item(2, eb, 300 + s % 40, 100 + s % 40), item(3, none, F.lit(500), 500 + s % 60), item(4, nv, 901 + s % 50, F.lit(1300)),
    )))


_m = [("1", "'not_visible'", "s % 50", "s % 50 + 900"), ("2", "'in_escape_box'", "100 + s % 40", "300 + s % 40"), ("3", "NULL", "500", "500 + s % 60"), ("4", "'not_visible'", "901 + s % 50", "1300")]
cte("k_marks", " UNION ALL ".join(f"SELECT s, 'm{i}-' || s AS id, '2026-02-0{i}' AS ts, {t}::VARCHAR AS rt, unnest(range({a}, {z} + 1)) AS f FROM k_sup" for i, t, a, z in _m))


@query("corrections_range_algebra", f"""SELECT {V}, rt AS range_type, min(f) AS start_frame, max(f) AS end_frame FROM (SELECT s, f, rt, f - row_number() OVER (PARTITION BY s, rt ORDER BY f) AS g FROM (SELECT s, f, arg_max({{'r': rt}}, ts).r AS rt FROM k_marks GROUP BY s, f) WHERE rt IS NOT NULL) q {JV} GROUP BY {V}, rt, g""")
def corrections_range_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges left after marking and clearing in order."""
    return CE.resolve_ranges(_marks(spark, sf)).select(*KEY, "range_type", "start_frame", "end_frame")


def _actions(spark: SparkSession, sf: str) -> DataFrame:
    """A log of event actions by rule over every detected event."""
    e = C.derived(spark, sf).stages["detected"].select(*KEY, "event_id", "start_frame", "end_frame")
    h = F.col("start_frame") % 5
    item = lambda i, act, hole, a, z: F.struct(F.concat(F.lit(f"a{i}-"), F.col("event_id")).alias("id"), F.lit(f"2026-03-0{i}").alias("timestamp"), act.alias("action"), hole.cast("int").alias("hole_index"), a.cast("int").alias("s"), z.cast("int").alias("e"))
    none = F.lit(None)
    second = F.when(h == 1, "confirm").when(h == 2, "reclassify").when(h == 3, "delete").when(h == 4, "revert").otherwise("edit")
    return e.select(*KEY, "event_id", F.inline(F.array(
        item(1, F.lit("edit"), F.lit(4), none, none), item(2, F.lit("edit"), none, F.col("start_frame") + 1, F.col("end_frame") + 2), item(3, second, F.when(second == "edit", 9), none, none),
    ))).withColumnsRenamed({"s": "start_frame", "e": "end_frame"})


@query("corrections_event_edits", f"""SELECT {V}, event_id, CASE h WHEN 3 THEN 'a3-' ELSE 'a1-' END || event_id AS id, CASE h WHEN 3 THEN 'delete' ELSE 'edit' END AS action, CASE h WHEN 0 THEN 9 WHEN 1 THEN 4 END::INT AS hole_index,
  CASE WHEN h IN (0, 1) THEN start_no + 1 END AS start_frame, CASE WHEN h IN (0, 1) THEN end_no + 2 END AS end_frame, h = 1 AS confirmed, CASE WHEN h = 2 THEN 'tracking_failure' END AS new_kind FROM (SELECT *, start_no % 5 AS h FROM k_evc) q {JV} WHERE h <> 4""")
def corrections_event_edits(spark: SparkSession, sf: str) -> DataFrame:
    """What remains of a log of edits, confirmations, reclassifications, deletes and reverts."""
    return CE.coalesce_event_edits(_actions(spark, sf)).select(*KEY, "event_id", "id", "action", "hole_index", "start_frame", "end_frame", "confirmed", "new_kind")


@query("corrections_single_entries", f"SELECT {V}, kind, arg_min(id, ts || '|' || id) AS id, arg_max(lo_no, ts || '|' || id) AS frame_index FROM k_corr WHERE kind IN ('trial_start', 'strategy_override', 'no_escape') GROUP BY {V}, kind")
def corrections_single_entries(spark: SparkSession, sf: str) -> DataFrame:
    return CE.single_entries(C.inputs(spark, sf).corrections).select(*KEY, "kind", "id", "frame_index")


@query("corrections_coalesced_points", f"SELECT {V}, id, frame_index, point, {srd('px', 'x', 3)} FROM (SELECT s, 'a-' || s AS id, 40 AS frame_index, 'nose' AS point, (s % 9) + 3.0 AS px FROM k_sup UNION ALL SELECT s, 'c-' || s, 41, 'centroid', (s % 9)::DOUBLE FROM k_sup WHERE s % 2 = 0) q {JV}")
def corrections_coalesced_points(spark: SparkSession, sf: str) -> DataFrame:
    """One entry per frame and point after repeated placing and clearing."""
    s = F.substring("video_id", 2, 12).cast("int")
    item = lambda t, i, f, pt, x: F.struct(F.concat(F.lit(f"{i}-"), s.cast("string")).alias("id"), F.lit(t).alias("timestamp"), F.lit(f).alias("frame_index"), F.lit(pt).alias("point"), x.cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("confidence"), F.lit(True).alias("valid"))
    p = C.inputs(spark, sf).videos.select(*KEY, F.inline(F.array(item("1", "a", 40, "nose", s % 9), item("2", "b", 40, "nose", s % 9 + 3), item("1", "c", 41, "centroid", s % 9), item("3", "d", 41, "centroid", F.when(s % 2 == 0, s % 9)))))
    return CE.coalesce_points(p).select(*KEY, "id", "frame_index", "point", rd("x", 3).alias("x"))


@query("corrections_reverted", f"SELECT {V}, id FROM k_corr WHERE kind NOT IN ('trial_start') AND id NOT LIKE 'pt-%' AND id NOT LIKE 'ad-%'")
def corrections_reverted(spark: SparkSession, sf: str) -> DataFrame:
    """The layer without all trial starts, without some ids and without what belongs to added events."""
    c = C.inputs(spark, sf).corrections
    kinds = c.filter(F.col("kind") == "trial_start").select(*KEY, "kind")
    ids = c.filter(F.col("id").startswith("pt-")).select(*KEY, "id")
    events = C.derived(spark, sf).events.filter(F.col("event_id").startswith("user-")).select(*KEY, "event_id")
    return CE.revert(c, ids, events, kinds).select(*KEY, "id")


@query("corrections_at_frame", f"SELECT {V}, a.frame_index AS asked, c.id, c.kind FROM k_frames a JOIN (SELECT s AS cs, id, kind, lo_no, hi_no FROM k_corr WHERE kind IN ('point', 'range', 'trial_start')) c ON c.cs = a.s AND a.frame_index BETWEEN lo_no AND hi_no")
def corrections_at_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The corrections at every frame."""
    i = C.inputs(spark, sf)
    return CE.at_frames(i.corrections, i.frames.select(*KEY, "frame_index"))


@query("corrections_of_events", f"SELECT {V}, event_id, id, 'add' AS action FROM (SELECT s, 'user-' || id AS event_id, id FROM k_corr WHERE what = 'add') q {JV}")
def corrections_of_events(spark: SparkSession, sf: str) -> DataFrame:
    return CE.of_events(C.inputs(spark, sf).corrections, C.derived(spark, sf).events)


@query("corrections_orphaned", f"SELECT {V}, q.id, f.code, q.kind FROM k_corr q JOIN k_flags f ON f.s = q.s AND f.correction_id = q.id AND f.code IN ('orphaned_correction', 'correction_out_of_range')")
def corrections_orphaned(spark: SparkSession, sf: str) -> DataFrame:
    return CE.orphaned(C.inputs(spark, sf).corrections, C.derived(spark, sf).flags)


@query("corrections_described", f"""SELECT {V}, id, CASE kind WHEN 'point' THEN CASE WHEN what = 'nose' THEN 'Nose' ELSE 'Centroid' END || CASE WHEN valid THEN ' placed by hand on frame ' || lo_no || printf(' at (%.1f, %.1f) px', x, y) ELSE ' marked invalid on frame ' || lo_no END
  WHEN 'range' THEN CASE WHEN range_type = 'not_visible' THEN 'Animal not visible' ELSE 'Animal in the escape box' END || ', frames ' || lo_no || '–' || hi_no WHEN 'event' THEN CASE WHEN what = 'add' THEN 'Investigation added at hole ' || (s % 20) || ', frames ' || lo_no || '–' || hi_no ELSE 'Event auto-investigation-hx-f1 deleted' END
  WHEN 'trial_start' THEN 'Trial start moved to frame ' || lo_no WHEN 'strategy_override' THEN 'Strategy set to serial by hand: seen on video' ELSE 'No escape, as a reviewer saw' || CASE WHEN s % 8 = 1 THEN ': never went in' ELSE '' END END AS sentence FROM k_corr""")
def corrections_described(spark: SparkSession, sf: str) -> DataFrame:
    return CE.describe(C.inputs(spark, sf).corrections)


@query("corrections_reviewer_stamp", f"""SELECT {V}, id, CASE WHEN kind = 'point' OR id LIKE 'new-%' THEN CASE WHEN session_id <> 'session-2' THEN 'rev-' || substr(session_id, 9) END ELSE reviewer END AS reviewer FROM (SELECT session_id, video_id, id, kind, CASE WHEN s % 3 <> 2 THEN 'old' END AS reviewer FROM k_corr UNION ALL SELECT session_id, video_id, 'new-' || s, 'no_escape', NULL FROM k_sup)""")
def corrections_reviewer_stamp(spark: SparkSession, sf: str) -> DataFrame:
    """A write that moves every point and adds one entry per video: only those take the current reviewer."""
    c = C.inputs(spark, sf).corrections.withColumn("reviewer", F.when(F.col("reviewer").isNotNull(), "old"))
    after = c.withColumn("x", F.when(F.col("kind") == "point", F.col("x") + 1).otherwise(F.col("x")))
    new = C.inputs(spark, sf).videos.select(*KEY, F.concat(F.lit("new-"), F.substring("video_id", 2, 12)).alias("id"), F.lit("no_escape").alias("kind"))
    after = after.unionByName(new, allowMissingColumns=True)
    return CE.stamp_reviewer(c, after, B.sessions(spark, sf)).select(*KEY, "id", "reviewer")


@query("corrections_spans", f"SELECT {V}, id, span_lo AS span_start, span_hi AS span_end FROM k_spans q {JV}")
def corrections_spans(spark: SparkSession, sf: str) -> DataFrame:
    return CO.correction_spans(C.inputs(spark, sf).corrections).select(*KEY, "id", "span_start", "span_end")


# incremental
def _derived_hashes(spark: SparkSession, sf: str) -> DataFrame:
    i = C.inputs(spark, sf)
    return INC.dependency_hashes(i.videos, i.maze_maps, i.corrections, C.params())


@query("incremental_to_recompute", f"SELECT {V} FROM k_videos WHERE s % 10 = 3 OR s IN (SELECT s FROM k_corr WHERE id LIKE 'ts-%')")
def incremental_to_recompute(spark: SparkSession, sf: str) -> DataFrame:
    """Videos to derive again after targets of some and trial starts of others changed."""
    i = C.inputs(spark, sf)
    s = F.substring("video_id", 2, 12).cast("int")
    v = i.videos.withColumn("target_hole", F.when(s % 10 == 3, 5).otherwise(F.col("target_hole")))
    c = i.corrections.withColumn("frame_index", F.when(F.col("id").startswith("ts-"), F.col("frame_index") + 1).otherwise(F.col("frame_index")))
    now = INC.dependency_hashes(v, i.maze_maps, c, C.params())
    return INC.to_recompute(now, _derived_hashes(spark, sf)).select(*KEY)


def _stamped(spark: SparkSession, sf: str) -> DataFrame:
    s = F.substring("video_id", 2, 12).cast("int")
    return C.inputs(spark, sf).videos.filter(s % 7 != 2).select(*KEY, F.when(s % 6 == 4, "old").otherwise(P.parameters_hash(C.params())).alias("parameters_hash"))


@query("incremental_stale", f"SELECT {V} FROM k_videos WHERE s % 7 <> 2 AND s % 6 = 4")
def incremental_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Derived videos whose parameters are not those in force."""
    return INC.stale(_stamped(spark, sf), C.params())


@query("incremental_export_gate", """SELECT session_id, count(*) FILTER (WHERE s % 7 <> 2) AS analysed, count(*) FILTER (WHERE s % 7 <> 2 AND s % 6 = 4) AS stale, CASE WHEN count(*) FILTER (WHERE s % 7 <> 2 AND s % 6 = 4) > 0 THEN printf('%d videos analysed under other parameters', count(*) FILTER (WHERE s % 7 <> 2 AND s % 6 = 4)) END AS blocked FROM k_videos GROUP BY session_id""")
def incremental_export_gate(spark: SparkSession, sf: str) -> DataFrame:
    return INC.export_gate(C.inputs(spark, sf).videos, _stamped(spark, sf), C.params())


@query(
    "incremental_changed_inputs",
    f"""SELECT {V}, concat_ws(';', CASE WHEN s % 5 = 1 AND NOT own_target THEN 'target_hole' END, CASE WHEN s % 4 = 2 AND trial_type <> 'probe' THEN 'trial_type' END,
    CASE WHEN s % 7 = 3 THEN 'map_digest' END, CASE WHEN s % 6 = 5 THEN 'parameters_hash' END) AS changed, 'derived' AS falls
    FROM k_videos WHERE (s % 5 = 1 AND NOT own_target) OR (s % 4 = 2 AND trial_type <> 'probe') OR s % 7 = 3 OR s % 6 = 5""",
)
def incremental_changed_inputs(spark: SparkSession, sf: str) -> DataFrame:
    digest, other = P.parameters_hash(C.params()), P.parameters_hash(C.params(trialCutoff_s=120))
    v = C.inputs(spark, sf).videos.withColumns({"map_digest": F.lit("one"), "parameters_hash": F.lit(digest)})
    s = F.substring("video_id", 2, 12).cast("int")
    after = v.withColumn("target_hole", F.when(s % 5 == 1, 3).otherwise(F.col("target_hole"))).withColumn("trial_type", F.when(s % 4 == 2, "probe").otherwise(F.col("trial_type")))
    after = after.withColumn("map_digest", F.when(s % 7 == 3, "two").otherwise("one")).withColumn("parameters_hash", F.when(s % 6 == 5, other).otherwise(digest))
    return INC.changed_inputs(v, after)


@query("incremental_skip_reasons", f"SELECT {V}, CASE WHEN s % 8 = 5 THEN 'unknown video' WHEN s % 8 = 6 THEN 'map missing' WHEN s % 8 = 7 THEN 'track missing' END AS reason FROM k_sup")
def incremental_skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    i = C.inputs(spark, sf)
    s = F.substring("video_id", 2, 12).cast("int")
    v = i.videos.filter(s % 8 != 5).withColumn("map_id", F.when(s % 8 != 6, F.col("map_id")))
    return INC.skip_reasons(i.videos, v, i.maze_maps, i.frames.select(*KEY).filter(s % 8 != 7))


@query("parameters_clamped", "SELECT 'p' || s AS path, least(greatest((s % 50) - 10.0, 0.0), CASE WHEN s % 2 = 0 THEN 20.0 ELSE 1e18 END)::DOUBLE AS value FROM k_sup")
def parameters_clamped(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers held inside their bounds."""
    s = B.suppliers(spark, sf)
    path = F.concat(F.lit("p"), F.col("s").cast("string")).alias("path")
    return INC.clamp_parameters(s.select(path, (F.col("s") % 50 - F.lit(10.0)).alias("value")), s.select(path, F.lit(0.0).alias("low"), F.when(F.col("s") % 2 == 0, 20.0).alias("high")))


# documents and files
@query("documents_sessions", f"SELECT session_id, CASE WHEN s % 4 = 1 THEN 'a video has no valid trial type' WHEN s % 4 = 2 THEN 'written by a newer version' WHEN s % 4 = 3 THEN 'not valid JSON' END AS problem, count(*) AS documents FROM k_videos GROUP BY ALL")
def documents_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """One-video session documents written from the video table, some of them broken, read back with reasons."""
    v = C.inputs(spark, sf).videos
    s = F.substring("video_id", 2, 12).cast("int")
    sid = F.concat(F.lit("00000000-0000-0000-0000-00000000000"), F.substring("session_id", 9, 1))
    video = SJ.video_json(v).withField("trialType", F.when(s % 4 == 1, "other").otherwise(F.col("trial_type")))
    doc = F.to_json(
        F.struct(
            F.when(s % 4 == 2, 3).otherwise(2).alias("schemaVersion"), F.lit("0.1").alias("toolVersion"), sid.alias("sessionId"), F.lit("x").alias("name"), F.array(video).alias("videos"),
            F.create_map(F.col("video_id"), F.struct(F.struct(F.lit("h").alias("parametersHash"), F.array().cast(f"array<{SJ.FRAME}>").alias("frames")).alias("auto"), F.struct(F.array().cast(f"array<{SJ.ENTRY}>").alias("entries")).alias("corrections"))).alias("analyses"),
        )
    )
    texts = v.select(F.col("session_id").alias("source"), F.when(s % 4 == 3, F.concat(F.lit("{"), doc)).otherwise(doc).alias("value"))
    read = SJ.read_sessions(texts)
    return read.groupBy(F.col("source").alias("session_id"), "problem").agg(F.count(F.lit(1)).alias("documents"))


@query("documents_frames_roundtrip", f"SELECT {V}, count(*) AS frames, count(*) FILTER (WHERE c_valid) AS positioned, {srd('sum(x)', 'sum_x', 3)} FROM k_frames GROUP BY {V}")
def documents_frames_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Frames written as JSON lines and read back."""
    lines = SJ.frame_lines(C.inputs(spark, sf).frames)
    f = lines.select(*KEY, F.from_json("value", SJ.FRAME).alias("f"))
    return f.groupBy(*KEY).agg(F.count(F.lit(1)).alias("frames"), F.count_if("f.centroid.valid").alias("positioned"), rd(F.sum("f.centroid.x"), 3).alias("sum_x"))


_MISCOUNTED = "its lines are not those that its header counts"


@query("documents_in_parts", f"""
SELECT v.session_id, CASE WHEN v.session_id = 'session-1' THEN '{_MISCOUNTED}' END AS problem, v.videos, v.targets, f.frames, f.positioned, f.sum_x, c.corrections, c.edits
FROM (SELECT session_id, CASE WHEN session_id <> 'session-1' THEN count(*) ELSE 0 END AS videos, CASE WHEN session_id <> 'session-1' THEN count(*) FILTER (WHERE s % 14 = 9) ELSE 0 END AS targets FROM k_videos GROUP BY session_id) v
LEFT JOIN (SELECT session_id, count(*) AS frames, count(*) FILTER (WHERE c_valid) AS positioned, {srd('sum(x)', 'sum_x', 3)} FROM k_frames WHERE session_id <> 'session-1' GROUP BY session_id) f ON f.session_id = v.session_id
LEFT JOIN (SELECT 'session-' || (s % 3) AS session_id, count(*) AS corrections, count(*) FILTER (WHERE kind = 'point' OR kind = 'range') AS edits FROM k_corr WHERE s % 3 <> 1 GROUP BY ALL) c ON c.session_id = v.session_id""")
def documents_in_parts(spark: SparkSession, sf: str) -> DataFrame:
    """All sessions written as headers and line files and read back; one header counts a frame too many."""
    from wayfare.session import stage_folder

    i, sid = C.inputs(spark, sf), "00000000-0000-0000-0000-00000000000"
    named = lambda d: d.withColumn("session_id", F.concat(F.lit(sid), F.substring("session_id", 9, 1)))
    parts = SP.Parts(named(B.sessions(spark, sf)), named(i.videos), named(i.frames), named(i.corrections))
    one_more = F.col("parts").withField("frames", F.col("parts.frames") + F.when(F.col("session_id").endswith("1"), 1).otherwise(0))
    folder = f"{stage_folder(spark)}/parts-{uuid.uuid4().hex}"
    SP.write_parts(parts, folder, SP.manifest(parts).withColumn("parts", one_more))
    got = SP.read_parts(spark, folder)
    n = F.count(F.lit(1))
    v = got.videos.groupBy("session_id").agg(n.alias("videos"), F.count("target_hole").alias("targets"))
    f = got.frames.groupBy("session_id").agg(n.alias("frames"), F.count_if("centroid.valid").alias("positioned"), rd(F.sum("centroid.x"), 3).alias("sum_x"))
    c = got.corrections.groupBy("session_id").agg(n.alias("corrections"), F.count_if(F.col("kind").isin("point", "range")).alias("edits"))
    out = got.sessions.select("session_id", "problem").join(v, "session_id", "left").join(f, "session_id", "left").join(c, "session_id", "left")
    return out.fillna(0, ["videos", "targets"]).withColumn("session_id", F.concat(F.lit("session-"), F.substring("session_id", 36, 1)))


@query("documents_maps", "SELECT CASE s % 4 WHEN 1 THEN 'its hole ring has fewer than three holes' WHEN 2 THEN 'its target is not one of its holes' WHEN 3 THEN 'it has no platform diameter' END AS problem, count(*) AS documents FROM k_sup GROUP BY 1")
def documents_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Maze maps read with the first problem of each."""
    s = F.col("s")
    text = F.format_string(
        '{"schemaVersion":1,"referenceResolution":{"width":640,"height":480},"platform":{"cx":322,"cy":240,"r":205},"holes":{"n":%d,"ringRatio":0.89,"holeRadius_px":11,"phase_deg":0},"target":{"holeIndex":%d},"calibration":{%s}}',
        F.when(s % 4 == 1, 2).otherwise(20), F.when(s % 4 == 2, 20).when(s % 4 == 1, 1).otherwise(7), F.when(s % 4 == 3, "").otherwise('"platformDiameter_cm":92'),
    )
    return SJ.read_maps(B.suppliers(spark, sf).select(text.alias("value"))).groupBy("problem").agg(F.count(F.lit(1)).alias("documents"))


@query("intake_duplicates", f"SELECT v.session_id, v.video_id, f.first_id AS duplicate_of FROM k_videos v JOIN (SELECT session_id, byte_length, sha, arg_min(video_id, s) AS first_id FROM k_videos GROUP BY ALL) f ON f.session_id = v.session_id AND f.byte_length = v.byte_length AND f.sha = v.sha WHERE f.first_id <> v.video_id")
def intake_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Videos whose content their session already has."""
    return IN.duplicates(C.inputs(spark, sf).videos)


@query("intake_matches", f"SELECT {V}, 'upload_' || (999999 - s) || '.mp4' AS path FROM k_videos q")
def intake_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Renamed files attached to videos by content."""
    v = C.inputs(spark, sf).videos
    files = v.select(F.concat(F.lit("upload_"), (999999 - F.col("video_order")).cast("string"), F.lit(".mp4")).alias("path"), F.col("fingerprint.byte_length").alias("byte_length"), F.col("fingerprint.sha256").alias("sha256"), F.col("session_id").alias("own"), F.col("video_id").alias("own_id"))
    hit = IN.match(files.select("path", "byte_length", "sha256"), v)
    own = files.select("path", F.col("own").alias("session_id"), F.col("own_id").alias("video_id"))
    return hit.join(own, ["path", *KEY]).select(*KEY, "path")


@query("intake_triage", "SELECT ext, count(*) FILTER (WHERE ext = 'MP4') AS accepted, count(*) FILTER (WHERE ext IN ('avi', 'mkv')) AS re_encodable FROM (SELECT CASE s % 4 WHEN 0 THEN 'MP4' WHEN 1 THEN 'avi' WHEN 2 THEN 'txt' ELSE 'mkv' END AS ext FROM k_sup) GROUP BY ext")
def intake_triage(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s")
    ext = F.when(s % 4 == 0, "MP4").when(s % 4 == 1, "avi").when(s % 4 == 2, "txt").otherwise("mkv")
    f = B.suppliers(spark, sf).select(F.concat(F.lit("/in/clip"), s.cast("string"), F.lit("."), ext).alias("path"), ext.alias("ext"))
    return IN.triage(f).groupBy("ext").agg(F.count_if("accepted").alias("accepted"), F.count_if(F.col("hint").isNotNull()).alias("re_encodable"))


@query(
    "export_csv_lines",
    "SELECT video_id, '\"' || video_id || ', \"\"' || coalesce(animal, '') || '\"\"\"' || ',' || coalesce(day, '') || ',' || (s % 3) || ',' AS value FROM k_videos",
)
def export_csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """CSV lines with quoting only where needed and empty fields for missing values."""
    v = C.inputs(spark, sf).videos
    text = F.concat(F.col("video_id"), F.lit(', "'), F.coalesce("animal", F.lit("")), F.lit('"'))
    rows = v.select(text.alias("text"), "day", (F.col("video_order") % 3).cast("double").alias("n"), F.lit(float("nan")).alias("gap"))
    ids = F.regexp_extract("value", '^"(v[0-9]+),', 1)
    return EX.csv_lines(rows).select(ids.alias("video_id"), "value")


@query(
    "export_csv_numbers",
    """SELECT l_orderkey, l_linenumber, regexp_replace((l_quantity / 10000)::VARCHAR, '[.]0$', '') || ',' || regexp_replace((round(l_extendedprice) * 1000 + 0.5)::VARCHAR, '[.]0$', '')
  || ',' || l_quantity::BIGINT || CASE WHEN l_discount = 0 THEN ',' ELSE ',-' || regexp_replace(l_discount::VARCHAR, '[.]0$', '') END AS value FROM lineitem""",
)
def export_csv_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Number fields in plain digits: small fractions, large fractions, whole numbers and missing values."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("id"), (F.col("l_quantity") / 10000).alias("small"),
        (F.round("l_extendedprice") * 1000 + 0.5).alias("large"), F.col("l_quantity").cast("double").alias("whole"), F.when(F.col("l_discount") != 0, -F.col("l_discount")).alias("gap"),
    )
    parts = F.regexp_extract("value", r"^(\d+),(.*)$", 1).cast("bigint")
    lines = EX.csv_lines(rows).withColumn("id", parts)
    return lines.select(F.floor(F.col("id") / 8).alias("l_orderkey"), (F.col("id") % 8).cast("int").alias("l_linenumber"), F.regexp_extract("value", r"^(\d+),(.*)$", 2).alias("value"))


@query(
    "parameters_invalid",
    """SELECT l_orderkey, l_linenumber, path, value, allowed FROM (
  SELECT l_orderkey, l_linenumber, unnest(['trialCutoff_s', 'kinematicsSmoothingWindowFrames', 'kinematics.duplicateTimestampFactor', 'noseConfidenceCutoff']) AS path,
    unnest([l_quantity - 25, l_linenumber / 2.0::DOUBLE, l_discount * 12, l_tax * 15 - 0.3]) AS value,
    unnest(['number in (0, inf)', 'odd integer in [1, inf)', 'number in [0, 1)', 'number in [0, 1]']) AS allowed FROM lineitem)
  WHERE CASE path WHEN 'trialCutoff_s' THEN value <= 0 WHEN 'kinematicsSmoothingWindowFrames' THEN value <> floor(value) OR value % 2 <> 1 OR value < 1
    WHEN 'kinematics.duplicateTimestampFactor' THEN value < 0 OR value >= 1 ELSE value < 0 OR value > 1 END""",
)
def parameters_invalid(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters out of their rules in a table of sets, one set per line item."""
    from wayfare.plans.incremental import invalid_parameters

    sets = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.inline(F.array(
        F.struct(F.lit("trialCutoff_s").alias("path"), (F.col("l_quantity") - 25).alias("value")),
        F.struct(F.lit("kinematicsSmoothingWindowFrames").alias("path"), (F.col("l_linenumber") / 2.0).alias("value")),
        F.struct(F.lit("kinematics.duplicateTimestampFactor").alias("path"), (F.col("l_discount") * 12).alias("value")),
        F.struct(F.lit("noseConfidenceCutoff").alias("path"), (F.col("l_tax") * 15 - 0.3).alias("value")),
    )))
    return invalid_parameters(sets, ["l_orderkey", "l_linenumber"])


@query("cohort_parameter_difference", """SELECT v.session_id, d.path, d.value_a, d.value_b FROM (SELECT DISTINCT session_id FROM k_sup) v CROSS JOIN (VALUES ('holeInvestigation.radiusFactor', '1.5', '2'), ('trialCutoff_s', '180', '120')) d(path, value_a, value_b)""")
def cohort_parameter_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of each session that differ from a second set."""
    from wayfare.operators.cohort import parameter_difference

    s = B.sessions(spark, sf)
    a = EX.parameter_sheets(s, C.params())
    b = EX.parameter_sheets(s, C.params(holeInvestigation__radiusFactor=2, trialCutoff_s=120))
    return parameter_difference(a, b, ["session_id"])




@query("streaming_selection", f"SELECT {V}, n AS frame_index, reason, rank, true AS accepted FROM k_sel q {JV}")
def streaming_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The selection made online: observations streamed from files, some for each core at a time, one state per video."""
    from wayfare.session import stage_folder
    from wayfare.streaming import online

    t, i, p = _tracking(spark, sf), C.inputs(spark, sf), C.params()
    frames = i.frames.select(*KEY, F.col("pos").alias("frame_index"), F.col("t_s").alias("t"))
    obs = SE.observations(frames, t["cand"], t["unions"]).join(t["px"].join(t["expected"], KEY), KEY).withColumn("px", SE.thresholds_struct(p))
    obs = obs.select(*KEY, "frame_index", "t", "cs", "u", "px")
    chosen = online.replay(obs, f"{stage_folder(spark)}/online-{uuid.uuid4().hex}", t["expected"].count())
    return chosen.select(*KEY, "frame_index", "reason", "rank", "accepted")
