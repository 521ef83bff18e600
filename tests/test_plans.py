"""The plans of what reads the cleaned frames: no frame is moved again."""

import re

import pytest
from pyspark.sql import functions as F

from tests.tracks import tables, visit
from wayfare import params as P
from wayfare.operators import event_edits, evidence, events, kinematics, quality, trial
from wayfare.operators.clean import TRACK
from wayfare.plans.derive import derive
from wayfare.session import chunk_frames, co_partitioned

REDUCES = re.compile(r"Aggregate|Join")


def frame_moves(df, table: str) -> int:
    """Exchanges above a scan of ``table`` with no aggregate or join between: each moves its rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    above, moves, seen = [], 0, 0
    for line in plan.splitlines():
        depth = len(re.match(r"[ :+\-]*", line)[0])
        above = [(d, t) for d, t in above if d < depth]
        if "Scan" in line and table in line:
            seen += 1
            for _, t in reversed(above):
                if REDUCES.search(t):
                    break
                if "Exchange" in t:
                    moves += 1
                    break
        above.append((depth, line))
    assert seen, plan
    return moves


@pytest.fixture(scope="module")
def derived(spark):
    edits = [{"video_id": "v0", "id": "e", "kind": "event", "action": "add", "new_kind": "investigation", "hole_index": 4, "start_frame": 20, "end_frame": 60}]
    videos = {f"v{i}": visit(3, 5, 7) + [None] * 40 for i in range(12)}
    inputs = tables(spark, videos, corrections=edits)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.wayfare.chunkFrames", "96")
    try:
        yield inputs, derive(inputs, P.defaults())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.wayfare.chunkFrames")


def test_readers_of_the_cleaned_frames_do_not_move_them(spark, derived):
    inputs, d = derived
    clean, geo, size, p = d.clean, d.geometry, chunk_frames(spark), P.defaults()
    table = re.search(r"wayfare_clean_[0-9a-f]+", clean._jdf.queryExecution().executedPlan().toString())[0]
    bounds = d.bounds
    spans = d.events.select(*TRACK[:2], F.lit("c").alias("variant"), F.col("event_id").alias("span_id"), F.col("hole_index").alias("hole"), F.col("start_pos").alias("lo"), F.col("end_pos").alias("hi"))
    with co_partitioned(spark):
        plans = {
            "span distances": events.span_distances(clean, spans, geo),
            "blob trends": evidence.blob_trends(clean, d.runs),
            "trial frames": kinematics.trial_frames(clean, bounds, size),
            "scan": quality.scan(clean, quality.quality_windows(bounds), p, size),
            "gaps": quality.gaps(clean, d.scan, geo, size),
            "starts": trial.auto_starts(clean),
            "edits": event_edits.locate(inputs.corrections.filter("kind = 'event'"), clean),
            "pieces": events.pieces(clean).groupBy(*TRACK, "chunk").count(),
        }
        moved = {name: frame_moves(df, table) for name, df in plans.items()}
    # closing frames of gaps, a few per gap, are joined by gap
    assert moved == {**dict.fromkeys(plans, 0), "gaps": 1}
    # the same reader over unclustered frames does move them
    plain = spark.read.parquet(clean.inputFiles()[0].rsplit("/", 1)[0])
    folder = clean.inputFiles()[0].rsplit("/", 2)[1]
    assert frame_moves(kinematics.trial_frames(plain, bounds, size), folder) == 1


def test_distances_by_plain_loop(spark, derived):
    _, d = derived
    frames = {(r.video_id, r.pos): r for r in d.clean.filter("variant = 'c' AND c_valid").collect()}
    geo = {r.video_id: r for r in d.geometry.collect()}
    checked = 0
    for e in d.events.filter("kind = 'investigation'").collect():
        g, h = geo[e.video_id], geo[e.video_id].holes[e.hole_index]
        rows = [frames[e.video_id, k] for k in range(e.start_pos, e.end_pos + 1) if (e.video_id, k) in frames]
        near = min(((r.x - h.x) ** 2 + (r.y - h.y) ** 2) ** 0.5 for r in rows) / g.px_per_cm
        assert abs(near - e.min_centroid_cm) < 1e-9
        checked += e.end_pos // 96 > e.start_pos // 96
    assert checked  # some spans cross chunks
