"""The SQL twin: the same semantics written as one chain of common table expressions.

``sql(select)`` puts the expressions a final SELECT needs, and only those, in front of it.
"""

from __future__ import annotations

import re

from catalog import benchmark as B

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def _needed(text: str, seen: dict[str, None]) -> None:
    for name, body in CTES.items():
        if name not in seen and re.search(rf"\b{name}\b", text):
            _needed(body, seen)
            seen[name] = None


def sql(select: str) -> str:
    seen: dict[str, None] = {}
    _needed(select, seen)
    ordered = [n for n in CTES if n in seen]
    if not ordered:
        return select.strip()
    chain = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in ordered)
    rest = select.strip()
    if rest.startswith("WITH "):
        return f"WITH {chain},\n{rest[5:]}"
    return f"WITH {chain}\n{rest}"


CX, CY, R = B.PLATFORM
PXCM = f"(2 * {R} / {B.DIAMETER_CM})"

_zone_values = ", ".join(
    "(" + ", ".join(str(v) for v in (k, *row)) + ")" for k, row in enumerate(B.zone_points())
)

cte("k_zone", f"SELECT * FROM (VALUES {_zone_values}) AS z(zone, hx, hy, ix, iy, rx, ry)")

cte("k_sup", """
SELECT l_suppkey AS s, count(*)::INT AS n, ((count(*) + 47) // 48)::INT AS blocks,
       CASE WHEN l_suppkey % 5 = 2 THEN 10 ELSE 0 END AS off,
       'session-' || (l_suppkey % 3) AS session_id, 'v' || l_suppkey AS video_id
FROM lineitem GROUP BY l_suppkey
""")

cte("k_videos", """
SELECT k.session_id, k.video_id, k.s::INT AS video_order, 'clip_' || k.s || '.mp4' AS filename,
       CASE WHEN s % 13 <> 4 THEN 'M' || ((s // 4) % 9) END AS animal,
       CASE WHEN s % 11 <> 6 THEN (s % 4 + 1)::VARCHAR END AS day,
       ((s // 2) % 3 + 1)::VARCHAR AS trial,
       CASE WHEN s % 9 <> 2 THEN lower(r_name) END AS grp,
       CASE WHEN s % 10 = 7 THEN 'probe' ELSE 'acquisition' END AS trial_type,
       CASE WHEN s % 14 = 9 THEN 3 ELSE 7 END AS target, k.n AS n_frames, k.off, k.s,
       s % 14 = 9 AS own_target, ((s % 90) * 1000 + 5000) AS byte_length, sha256((s % 90)::VARCHAR) AS sha
FROM k_sup k JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey
JOIN region ON r_regionkey = n_regionkey
""")

cte("k_mode", """
SELECT *, CASE WHEN b = 0 THEN 22 WHEN s % 3 = 0 AND b = blocks - 1 THEN 21
               WHEN s % 3 = 0 AND b = blocks - 2 THEN 20
               WHEN s % 5 = 4 AND m0 = 5 THEN 10 ELSE m0 END AS m
FROM (SELECT *, (13 * s + 17 * b) % (CASE WHEN s % 5 < 2 THEN 11 WHEN s % 5 < 4 THEN 29 ELSE 6 END) AS m0
      FROM (SELECT *, unnest(range(blocks)) AS b FROM k_sup))
""")

cte("k_blocks", """
SELECT *, coalesce(last_value(moved IGNORE NULLS) OVER (PARTITION BY s ORDER BY b
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 20) AS place
FROM (SELECT *, CASE WHEN m IN (0, 1, 21, 22) THEN NULL WHEN m = 10 THEN 20 ELSE h END AS moved
      FROM (SELECT *, CASE WHEN m = 20 THEN 7 WHEN s % 4 = 1 THEN (7 * s + b) % 20
                           WHEN s % 4 = 2 THEN 6 + b % 3
                           ELSE (7 * s + 3 * b + (b * b) % 5) % 20 END AS h FROM k_mode))
""")

_axis = """
CASE WHEN NOT ok THEN 0.0::DOUBLE WHEN partial THEN i{a}
     WHEN m = 10 THEN i{a} + ({c} - i{a}) * ((i + 1) / 8.0::DOUBLE)
     WHEN m = 2 THEN CASE WHEN i < 24 THEN i{a} + ({c} - i{a}) * ((i + 1) / 24.0::DOUBLE)
                          ELSE {c} + (gi{a} - {c}) * ((i - 23) / 24.0::DOUBLE) END
     WHEN m = 4 AND i = 40 THEN g{a}0 + ({c} - g{a}0) * 0.6::DOUBLE ELSE g{a}0 END AS {a}
"""
cte("k_frames", f"""
SELECT session_id, video_id, s, pos, pos + off AS frame_index, t_s, x, y, ok AS c_valid, nose_on AS n_valid,
       CASE WHEN NOT ok THEN 0.0 WHEN partial THEN 0.4 ELSE 0.9 END::DOUBLE AS c_conf,
       CASE WHEN NOT nose_on THEN 0.0 WHEN partial THEN phx WHEN dwell THEN ghx ELSE x + 8.0 END::DOUBLE AS nx,
       CASE WHEN NOT nose_on THEN 0.0 WHEN partial THEN phy WHEN dwell THEN ghy ELSE y END::DOUBLE AS ny,
       CASE WHEN NOT nose_on THEN 0.0 WHEN i % 4 = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS nose_conf,
       CASE WHEN blind OR hand THEN 'ambiguous' WHEN lost THEN 'not_detected'
            WHEN partial THEN 'low_confidence' ELSE 'tracked' END AS state,
       CASE WHEN hand THEN 'oversized_blob' WHEN blind THEN 'multiple_blobs' WHEN lost THEN 'no_foreground'
            WHEN partial THEN 'small_blob' ELSE 'single_blob' END AS reason,
       CASE WHEN NOT ok THEN 0.0 WHEN partial THEN 180.0 ELSE 500.0 + 10.0 * (i % 5) END::DOUBLE AS area
FROM (SELECT *, {_axis.format(a="x", c=B.zone_points()[20][2])}, {_axis.format(a="y", c=B.zone_points()[20][3])},
             ok AND s % 6 <> 5 AND (partial OR dwell OR i % 2 = 1) AS nose_on
      FROM (SELECT f.*, p.ix, p.iy, p.hx AS phx, p.hy AS phy, g.hx AS ghx, g.hy AS ghy,
                   p.ix + ((CASE WHEN m = 6 THEN g.rx ELSE g.ix END) - p.ix) * least(1.0::DOUBLE, (i + 1) / 30.0::DOUBLE) AS gx0,
                   p.iy + ((CASE WHEN m = 6 THEN g.ry ELSE g.iy END) - p.iy) * least(1.0::DOUBLE, (i + 1) / 30.0::DOUBLE) AS gy0,
                   g.ix AS gix, g.iy AS giy, NOT (lost OR blind OR hand) AS ok
            FROM (SELECT *, b * 48 + i AS pos,
                         ((b * 48 + i) - ((b * 48 + i) + 47) // 97 + (b * 48 + i) // 113) / 30.0::DOUBLE AS t_s,
                         (m = 1 AND place <> 20) AS partial,
                         (m IN (0, 21, 22) OR (m = 10 AND i >= 8) OR (m = 3 AND i IN (36, 37)) OR (m = 6 AND i >= 36)) AS lost,
                         s % 17 = 1 AS blind,
                         ((m = 22 AND i < 20 AND s % 7 = 3) OR (s % 19 = 5 AND b = 5 AND i BETWEEN 10 AND 12)) AS hand,
                         (i >= 30 AND m NOT IN (2, 6, 10)) AS dwell
                  FROM (SELECT *, unnest(range(least(48, n - b * 48))) AS i FROM k_blocks)) f
            JOIN k_zone p ON p.zone = f.place JOIN k_zone g ON g.zone = f.h))
""")
