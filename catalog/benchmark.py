"""Tracks derived from the given benchmark tables.

The tables hold no animal tracks, so each supplier stands for a video: the number of its line items
is the number of frames, and every frame is a function of (supplier, frame number). The work grows
with ``lineitem``; nothing is read from a fixed list except the hole positions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.timeline import Carry, carry

FPS = 30.0
BLOCK = 48
BLOCKS_PER_CHUNK = 1024
#: Frames that one task makes from the script, about.
FRAMES_PER_TASK = 100_000
PLATFORM = (322.0, 240.0, 205.0)
RING_RATIO = 0.89
HOLES = 20
TARGET = 7
DIAMETER_CM = 92.0
PX_PER_CM = 2 * PLATFORM[2] / DIAMETER_CM
HOLE_RADIUS_PX = round(2.5 * PX_PER_CM, 6)


def zone_points() -> list[tuple[float, float, float, float, float, float]]:
    """Per zone: the hole, a place 1 cm inwards of it, and a rim place beside it; the last zone is the centre."""
    cx, cy, r = PLATFORM
    rows = []
    for k in range(HOLES):
        a = 2 * math.pi * k / HOLES
        ring, rim = RING_RATIO * r, 0.97 * r
        inner = ring - PX_PER_CM
        b = a + math.pi / HOLES
        # places are a little off the symmetry axes, so no path runs at equal distance from two holes
        ox, oy = (k * 7 % 5 - 2.3) * 0.173, (k * 3 % 7 - 3.1) * 0.119
        rows.append(
            tuple(
                round(v, 6)
                for v in (
                    cx + ring * math.cos(a), cy + ring * math.sin(a),
                    cx + inner * math.cos(a) + ox, cy + inner * math.sin(a) + oy,
                    cx + rim * math.cos(b) + ox, cy + rim * math.sin(b) + oy,
                )
            )
        )
    return rows + [(cx, cy, cx + 0.311, cy - 0.223, cx, cy)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _idiv(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier with line items: s, n, blocks and the frame index offset."""
    n = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(
        F.count(F.lit(1)).cast("int").alias("n")
    )
    s = F.col("s")
    return n.select(
        s,
        "n",
        _idiv(F.col("n") + BLOCK - 1, BLOCK).alias("blocks"),
        F.when(s % 5 == 2, 10).otherwise(0).alias("off"),
        F.concat(F.lit("session-"), (s % 3).cast("string")).alias("session_id"),
        F.concat(F.lit("v"), s.cast("string")).alias("video_id"),
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The video dimension: one row per supplier that has line items."""
    sup = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    nat = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    reg = _table(spark, sf_dir, "region")
    s = F.col("s")
    return (
        suppliers(spark, sf_dir)
        .join(sup, F.col("s_suppkey") == s)
        .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "session_id",
            "video_id",
            s.cast("int").alias("video_order"),
            F.concat(F.lit("clip_"), s.cast("string"), F.lit(".mp4")).alias("filename"),
            F.struct(
                ((s % 90) * 1000 + 5000).alias("byte_length"),
                ((F.col("n") - 1) / FPS).alias("duration_s"),
                F.col("n").cast("bigint").alias("frame_count"),
                F.sha2((s % 90).cast("string"), 256).alias("sha256"),
            ).alias("fingerprint"),
            F.struct(F.lit(640).alias("width"), F.lit(480).alias("height")).alias("resolution"),
            F.struct(
                F.lit(0.0).alias("translate_x"),
                F.lit(0.0).alias("translate_y"),
                F.lit(0.0).alias("rotation_deg"),
                F.lit(1.0).alias("scale"),
            ).alias("transform"),
            F.when(s % 13 != 4, F.concat(F.lit("M"), (_idiv(s, 4) % 9).cast("string"))).alias("animal"),
            F.when(s % 11 != 6, (s % 4 + 1).cast("string")).alias("day"),
            (_idiv(s, 2) % 3 + 1).cast("string").alias("trial"),
            F.when(s % 9 != 2, F.lower("r_name")).alias("group"),
            F.when(s % 10 == 7, "probe").otherwise("acquisition").alias("trial_type"),
            F.when(s % 14 == 9, F.lit(3)).cast("int").alias("target_hole"),
            F.lit("map-0").alias("map_id"),
            F.col("n").alias("n_frames"),
        )
    )


def maze_maps(spark: SparkSession) -> DataFrame:
    cx, cy, r = PLATFORM
    return spark.range(1).select(
        F.lit("map-0").alias("map_id"),
        F.lit(1).alias("schema_version"),
        F.struct(F.lit(640).alias("width"), F.lit(480).alias("height")).alias("resolution"),
        F.struct(F.lit(cx).alias("cx"), F.lit(cy).alias("cy"), F.lit(r).alias("r")).alias("platform"),
        F.lit(HOLES).alias("n"),
        F.lit(RING_RATIO).alias("ring_ratio"),
        F.lit(HOLE_RADIUS_PX).alias("hole_radius_px"),
        F.lit(0.0).alias("phase_deg"),
        F.lit(None).cast("array<struct<hole_index:int,dx_px:double,dy_px:double>>").alias("offsets"),
        F.lit(TARGET).alias("target_hole"),
        F.lit(DIAMETER_CM).alias("platform_diameter_cm"),
        F.lit("fit").alias("created_from"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        suppliers(spark, sf_dir)
        .select("session_id")
        .distinct()
        .select(
            "session_id",
            F.concat(F.lit("Cohort "), F.substring("session_id", 9, 10)).alias("name"),
            F.when(F.col("session_id") != "session-2", F.concat(F.lit("rev-"), F.substring("session_id", 9, 10))).alias(
                "reviewer"
            ),
            F.lit("0.1").alias("tool_version"),
            F.lit(2).alias("schema_version"),
            F.lit("map-0").alias("map_id"),
        )
    )


def _pick(values: list[float], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script: 48-frame blocks with their mode, the zone they head for and the zone they begin at."""
    s, b = F.col("s"), F.col("b")
    base = suppliers(spark, sf_dir).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), _idiv(F.col("blocks") - 1, BLOCKS_PER_CHUNK)))
    )
    lo = F.col("chunk") * BLOCKS_PER_CHUNK
    # by number: the rows are few and small until they are opened to frames, so by their size they would all go to one task
    tasks = max(1, -(-_table(spark, sf_dir, "lineitem").count() // FRAMES_PER_TASK))
    base = base.repartition(tasks, "session_id", "video_id", "chunk").withColumn(
        "b", F.explode(F.sequence(lo, F.least(lo + BLOCKS_PER_CHUNK, F.col("blocks")) - 1))
    )
    k = F.when(s % 5 < 2, 11).when(s % 5 < 4, 29).otherwise(6)
    m = (13 * s + 17 * b) % k
    m = F.when((s % 5 == 4) & (m == 5), 10).otherwise(m)
    # 20: dwell at the target before the end, 21: lost to the end, 22: lost at the beginning
    m = (
        F.when(b == 0, 22)
        .when((s % 3 == 0) & (b == F.col("blocks") - 1), 21)
        .when((s % 3 == 0) & (b == F.col("blocks") - 2), 20)
        .otherwise(m)
    )
    h = (
        F.when(s % 4 == 1, (7 * s + b) % 20)
        .when(s % 4 == 2, 6 + b % 3)
        .otherwise((7 * s + 3 * b + (b * b) % 5) % 20)
    )
    base = base.withColumn("m", m.cast("int")).withColumn(
        "h", F.when(F.col("m") == 20, TARGET).otherwise(h).cast("int")
    )
    moved = (
        F.when(F.col("m").isin(0, 1, 21, 22), None).when(F.col("m") == 10, 20).otherwise(F.col("h"))
    )
    return (
        carry(base, [Carry("place", moved)], order="b")
        .withColumn("place", F.coalesce("place", F.lit(20)))
        .drop("chunk")
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame table, one row per frame, with nested points."""
    zones = zone_points()
    hx, hy, ix, iy, rx, ry = ([z[j] for z in zones] for j in range(6))
    cx, cy = zones[HOLES][2], zones[HOLES][3]
    s, b, n = F.col("s"), F.col("b"), F.col("pos")
    i, m, h, place = F.col("i"), F.col("m"), F.col("h"), F.col("place")
    df = blocks(spark, sf_dir).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.least(F.lit(BLOCK), F.col("n") - b * BLOCK) - 1))
    )
    df = df.withColumn("pos", (b * BLOCK + i).cast("int"))
    partial = (m == 1) & (place != 20)
    lost = (
        m.isin(0, 21, 22)
        | ((m == 10) & (i >= 8))
        | ((m == 3) & i.isin(36, 37))
        | ((m == 6) & (i >= 36))
    )
    blind = s % 17 == 1
    hand = ((m == 22) & (i < 20) & (s % 7 == 3)) | ((s % 19 == 5) & (b == 5) & i.between(10, 12))
    px, py = _pick(ix, place), _pick(iy, place)
    gx = F.when(m == 6, _pick(rx, h)).otherwise(_pick(ix, h))
    gy = F.when(m == 6, _pick(ry, h)).otherwise(_pick(iy, h))
    frac = F.least(F.lit(1.0), (i + 1) / 30.0)

    def axis(p: Column, g: Column, c: float) -> Column:
        away = F.when(i < 24, p + (c - p) * ((i + 1) / 24.0)).otherwise(c + (g - c) * ((i - 23) / 24.0))
        plain = p + (g - p) * frac
        return (
            F.when(partial, p)
            .when(m == 10, p + (c - p) * ((i + 1) / 8.0))
            .when(m == 2, away)
            .when((m == 4) & (i == 40), plain + (c - plain) * 0.6)
            .otherwise(plain)
        )

    df = df.withColumn("ok", ~(lost | blind | hand)).withColumn("partial", partial)
    ok = F.col("ok")
    df = df.withColumn("x", F.when(ok, axis(px, gx, cx)).otherwise(0.0)).withColumn(
        "y", F.when(ok, axis(py, gy, cy)).otherwise(0.0)
    )
    sighted = s % 6 != 5
    dwell = (i >= 30) & ~m.isin(2, 6, 10)
    at = F.when(partial, place).otherwise(h)
    nose_on = ok & sighted & (partial | dwell | (i % 2 == 1))
    zone_nose = partial | dwell
    nx = F.when(~nose_on, 0.0).when(zone_nose, _pick(hx, at)).otherwise(F.col("x") + 8.0)
    ny = F.when(~nose_on, 0.0).when(zone_nose, _pick(hy, at)).otherwise(F.col("y"))
    nconf = F.when(~nose_on, 0.0).when(i % 4 == 1, 1.0).otherwise(0.5)
    state = (
        F.when(blind | hand, "ambiguous")
        .when(lost, "not_detected")
        .when(partial, "low_confidence")
        .otherwise("tracked")
    )
    reason = (
        F.when(hand, "oversized_blob")
        .when(blind, "multiple_blobs")
        .when(lost, "no_foreground")
        .when(partial, "small_blob")
        .otherwise("single_blob")
    )
    ticks = n - F.floor((n + 47) / 97) + F.floor(n / 113)
    return df.select(
        "session_id",
        "video_id",
        "pos",
        (n + F.col("off")).cast("int").alias("frame_index"),
        (ticks / FPS).alias("t_s"),
        F.struct(
            F.col("x"),
            F.col("y"),
            F.when(~ok, 0.0).when(partial, 0.4).otherwise(0.9).alias("confidence"),
            ok.alias("valid"),
            F.lit("auto").alias("source"),
        ).alias("centroid"),
        F.struct(
            nx.alias("x"), ny.alias("y"), nconf.alias("confidence"), nose_on.alias("valid"), F.lit("auto").alias("source")
        ).alias("nose"),
        state.alias("detection_state"),
        reason.alias("reason"),
        F.when(~ok, 0.0).when(partial, 180.0).otherwise(500.0 + 10.0 * (i % 5)).alias("blob_area_px2"),
        nconf.alias("nose_heading_confidence"),
        F.lit(None).cast("struct<x:double,y:double,width:double,height:double>").alias("bounding_box"),
    )


CORRECTION_COLUMNS = {
    "session_id": "string", "video_id": "string", "id": "string", "timestamp": "string", "kind": "string",
    "reviewer": "string", "frame_index": "int", "point": "string", "x": "double", "y": "double",
    "confidence": "double", "valid": "boolean", "range_type": "string", "start_frame": "int",
    "end_frame": "int", "action": "string", "event_id": "string", "new_kind": "string",
    "hole_index": "int", "confirmed": "boolean", "strategy": "string", "reason_text": "string",
}


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer edits by rule: points, ranges, trial starts, overrides and event edits."""
    base = suppliers(spark, sf_dir)
    s, n, off = F.col("s"), F.col("n"), F.col("off")
    zones = zone_points()

    def rows(tag: str, when: Column, day: str, kind: str, **values: Column) -> DataFrame:
        given = {
            "session_id": F.col("session_id"),
            "video_id": F.col("video_id"),
            "id": F.concat(F.lit(f"{tag}-"), s.cast("string")),
            "timestamp": F.lit(f"2026-01-{day}T10:00:00Z"),
            "kind": F.lit(kind),
            "reviewer": F.when(s % 3 != 2, F.concat(F.lit("rev-"), (s % 3).cast("string"))),
            **values,
        }
        return base.filter(when).select(
            *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in CORRECTION_COLUMNS.items()]
        )

    parts = [
        rows("pt", s % 6 == 1, "02", "point", frame_index=off + 180, point=F.lit("centroid"),
             x=F.lit(0.0), y=F.lit(0.0), confidence=F.lit(0.0), valid=F.lit(False)),
        rows("pv", s % 6 == 1, "04", "point", frame_index=off + 150, point=F.lit("centroid"),
             x=F.lit(zones[20][0]), y=F.lit(zones[20][1]), confidence=F.lit(1.0), valid=F.lit(True)),
        rows("ns", s % 6 == 1, "03", "point", frame_index=off + 181, point=F.lit("nose"),
             x=F.lit(zones[4][0]), y=F.lit(zones[4][1]), confidence=F.lit(1.0), valid=F.lit(True)),
        rows("rg", s % 6 == 2, "02", "range", range_type=F.lit("not_visible"),
             start_frame=off + 222, end_frame=off + 240),
        rows("rh", s % 12 == 2, "03", "point", frame_index=off + 230, point=F.lit("centroid"),
             x=F.lit(zones[3][2]), y=F.lit(zones[3][3]), confidence=F.lit(1.0), valid=F.lit(True)),
        rows("eb", s % 12 == 4, "05", "range", range_type=F.lit("in_escape_box"),
             start_frame=off + n - 60, end_frame=off + n + 20),
        rows("oo", s % 25 == 6, "06", "point", frame_index=off + n + 500, point=F.lit("nose"),
             x=F.lit(1.0), y=F.lit(1.0), confidence=F.lit(1.0), valid=F.lit(True)),
        rows("ts", s % 9 == 4, "02", "trial_start", frame_index=off + 70),
        rows("tx", s % 27 == 13, "03", "trial_start", frame_index=F.lit(1_000_000)),
        rows("so", s % 8 == 5, "02", "strategy_override", strategy=F.lit("serial"),
             reason_text=F.lit("seen on video")),
        rows("ne", s % 4 == 1, "02", "no_escape", reason_text=F.when(s % 8 == 1, "never went in")),
        rows("ad", s % 20 == 8, "07", "event", action=F.lit("add"), hole_index=(s % 20).cast("int"),
             start_frame=off + 250, end_frame=off + 265, event_id=F.concat(F.lit("user-ad-"), s.cast("string"))),
        rows("dl", s % 20 == 9, "07", "event", action=F.lit("delete"), event_id=F.lit("auto-investigation-hx-f1")),
    ]
    return reduce(DataFrame.unionByName, parts)


def blobs(frames_: DataFrame) -> DataFrame:
    """Blob measurements per frame, by rule from the frame table: the animal, doubles, fragments, hands and noise."""
    n, s = F.col("pos"), F.substring("video_id", 2, 12).cast("bigint")
    ok, x, y = F.col("centroid.valid"), F.col("centroid.x"), F.col("centroid.y")

    def blob(i: int, when: Column, area: Column, dx: float, dy: float) -> Column:
        return F.when(when, F.struct(F.lit(i).alias("first_index"), area.alias("area"), (x + dx).alias("cx"), (y + dy).alias("cy")))

    two = ((n + s) % 23 == 0) | (n % 200).between(100, 119)
    parts = F.array(
        blob(0, ok, F.col("blob_area_px2"), 0.0, 0.0),
        blob(1, ok & two, F.lit(300.0), 60.0, 5.0),
        blob(2, ok & (n % 200 == 110), F.lit(200.0), 15.0, -20.0),
        blob(3, ok & ((n + 2 * s) % 31 == 0), F.lit(150.0), 12.0, 7.0),
        blob(4, ok & ((n + 3 * s) % 101 == 0), F.lit(3000.0), -40.0, 0.0),
        F.when(~ok & (n % 13 == 5), F.struct(F.lit(5).alias("first_index"), F.lit(40.0).alias("area"), F.lit(322.0).alias("cx"), F.lit(240.0).alias("cy"))),
    )
    df = frames_.select("session_id", "video_id", n.alias("frame_index"), F.col("t_s").alias("t"), F.explode(F.filter(parts, lambda b: b.isNotNull())).alias("b"))
    df = df.select("session_id", "video_id", "frame_index", "t", "b.*")
    a, cx, cy, f = F.col("area"), F.col("cx"), F.col("cy"), F.col("frame_index")
    pcx, pcy, r = PLATFORM
    lean = (f % 5 - 2) / 160.0
    return df.select(
        "*",
        (F.sqrt((cx - pcx) * (cx - pcx) + (cy - pcy) * (cy - pcy)) >= r - PX_PER_CM).alias("rim"),
        (60.0 + f % 50).alias("mean_diff"),
        (cx - 10).alias("min_x"), (cy - 8).alias("min_y"), (cx + 10).alias("max_x"), (cy + 8).alias("max_y"),
        (a * cx).alias("sum_x"), (a * cy).alias("sum_y"),
        (a * (a / 20 + cx * cx)).alias("sum_xx"), (a * (a / 40 + cy * cy)).alias("sum_yy"), (a * (a * lean + cx * cy)).alias("sum_xy"),
        (f % 9).cast("int").alias("tail_pixels"),
    )


def video_samples(frames_: DataFrame) -> DataFrame:
    """Sample tables by rule: pairs stored out of order, equal stamps, gaps, and picture order numbers."""
    n = F.col("pos")
    ticks = (n - F.floor((n + 47) / 97) + F.floor(n / 113)).cast("bigint")
    swap = F.when(n % 2 == 0, n + 1).otherwise(n - 1)
    return frames_.select(
        "session_id", "video_id", swap.alias("decode_index"), (ticks * 512 + 1024).alias("cts"), (swap * 512).cast("bigint").alias("dts"),
        F.when(n % 113 == 112, 1024).otherwise(512).cast("bigint").alias("duration"), (n % 12 == 0).alias("is_sync"),
        (n.cast("bigint") * 1000).alias("byte_offset"), F.lit(1000).cast("bigint").alias("byte_length"),
        (2 * (n % 12) + F.when(n % 50 == 7, 100).otherwise(0)).cast("int").alias("poc"), F.floor(n / 12).cast("int").alias("gop"),
        F.lit(15360).cast("bigint").alias("timescale"), F.lit(1024).cast("bigint").alias("edit_offset_ticks"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel tables from the embeddings: a label is a video, a vector one of its frames, a dimension a pixel."""
    e = _table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("label").alias("video"), F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("pixel", "v")
    ).select("video", "frame", "pixel", F.least(F.lit(255), F.floor(F.abs(F.col("v").cast("double")) * 100)).cast("int").alias("value"))
