"""Steps whose rows grow by an explode: spread over tasks by number, never broadcast."""

import contextlib
import math
import re
import statistics

from pyspark.sql import DataFrameWriter, Window
from pyspark.sql import functions as F

from catalog import benchmark as B
from catalog import cohort as C
from tests.tracks import CX, CY, hole, tables, visit, walk
from wayfare import params as P
from wayfare.operators import background as BG
from wayfare.operators import clean as CL
from wayfare.operators import corrections as CO
from wayfare.operators import event_edits as EE
from wayfare.operators import fits as FT
from wayfare.plans import derive as D
from wayfare.session import BUCKET_ROWS, METHOD_CONF, PARTITIONS_CONF, buckets_for, co_partitioned, dealt_into, materialise, materialise_plain


def test_frames_are_made_by_many_tasks_and_are_the_same(spark, tmp_path, monkeypatch):
    spark.range(3000).select((F.col("id") % 10 + 1).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    one = B.frames(spark, str(tmp_path))
    whole = sorted(map(str, one.collect()))
    monkeypatch.setattr(B, "FRAMES_PER_TASK", 500)
    made = materialise(B.frames(spark, str(tmp_path)), "frames-test")
    assert len(made.inputFiles()) > 1
    assert sorted(map(str, made.collect())) == whole and len(whole) == 3000


def test_methods_are_kept_small_only_while_a_stage_is_written(spark):
    before = spark.conf.get(METHOD_CONF, None)
    materialise(spark.range(3), "small-test")
    assert spark.conf.get(METHOD_CONF, None) == before


def test_background_samples_are_not_broadcast(spark):
    key = [F.lit("s").alias("session_id"), F.concat(F.lit("v"), F.col("id") % 3).alias("video_id")]
    frames = spark.range(900).select(*key, F.floor(F.col("id") / 3).cast("int").alias("pos"))
    frames = frames.withColumn("chunk", (F.col("pos") / 64).cast("int")).select("session_id", "video_id", "chunk", "pos")
    cut = spark.range(3).select(*key, F.lit(0).alias("start_frame"), F.lit(99).alias("end_frame"))
    got = BG.sample_frames(frames, cut, 10, 64)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search("SortMergeJoin .*LeftAnti", plan) and re.search("SortMergeJoin .*idx", plan)
    # 200 frames are free: one from the middle of each twenty
    assert sorted((r.video_id, r.pos) for r in got.collect()) == [(f"v{k}", 110 + 20 * i) for k in range(3) for i in range(10)]


def test_holes_are_not_carried_through_the_windows(spark):
    """The holes, many times as large as a frame, join behind the sorts and windows of the filling."""
    lost = visit(3) + walk(hole(3), (CX, CY), 10) + [None] * 2 + walk((CX, CY), hole(9), 30) + [None] * 2 + [hole(9)] * 3
    stage = D.cleaned(tables(spark, {"v": lost}), P.defaults(gapFilling__enabled=True, gapFilling__maxDuration_s=0.2))
    plan = stage["clean"]._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if x.lstrip(" +-:").startswith("Window") and "holes" in x]
    below = plan[plan.index("Window"):].split("Join Inner")
    assert len(below) > 2 and "holes#" not in below[1]
    gaps = [r.unfilled for r in stage["clean"].filter("variant = 'c' and (filled or unfilled is not null)").orderBy("pos").collect()]
    assert gaps == [None, None, "hole_adjacent", "hole_adjacent"]


def test_a_video_that_stands_twice_doubles_its_frames_once(spark):
    one = tables(spark, {"v": visit(3), "w": visit(4)})
    one.videos = one.videos.unionByName(one.videos.filter("video_id = 'v'"))
    clean = D.cleaned(one, P.defaults())["clean"].groupBy("video_id").count().collect()
    assert {r.video_id: r["count"] for r in clean} == {"v": 2 * len(visit(3)), "w": len(visit(4))}


def test_buckets_grow_with_the_rows(spark):
    """A bucket stays of one size however few shuffle partitions are set."""
    assert [buckets_for(n) for n in (0, 1, BUCKET_ROWS, 1000 * BUCKET_ROWS)] == [1, 1, 1, 1000]


def test_clustered_frames_are_written_without_a_second_move(spark, monkeypatch):
    """With more shuffle partitions than buckets, the frames went through one more exchange."""
    before, seen = spark.conf.get(PARTITIONS_CONF), []
    save = DataFrameWriter.saveAsTable
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", lambda w, *a, **k: seen.append(spark.conf.get(PARTITIONS_CONF)) or save(w, *a, **k))
    inputs = tables(spark, {"v": visit(3)})
    spark.conf.set(PARTITIONS_CONF, "40")
    try:
        D.clustered(inputs, P.defaults())
        assert seen == ["1"] and spark.conf.get(PARTITIONS_CONF) == "40"
    finally:
        spark.conf.set(PARTITIONS_CONF, before)


def test_event_edits_are_folded_by_many_tasks(spark):
    """The events are few and small, so by their size one task would fold all videos."""
    corrections = [{"video_id": f"v{k}", "id": f"d{k}", "kind": "event", "action": "delete", "event_id": "none"} for k in range(12)]
    inputs = tables(spark, {f"v{k}": visit(3) for k in range(12)}, corrections=corrections)
    d = D.derive(inputs, P.defaults())
    edits = materialise(EE.event_edits(inputs.corrections, d.clean, d.geometry, d.stages["correction_spans"]), "edits-test")
    out, _ = EE.apply_event_edits(d.events, edits, d.clean, d.geometry)
    made = materialise(out, "fold-test")
    assert len(made.inputFiles()) > 1
    assert sorted(r.video_id for r in made.filter("row = 'flag'").collect()) == sorted(f"v{k}" for k in range(12))


def test_cleaned_frames_are_written_once_for_the_layer_derived_from_them(spark, monkeypatch):
    made = []
    monkeypatch.setattr(C, "clustered", lambda i, p, f=D.clustered: made.append(1) or f(i, p))
    monkeypatch.setattr(D, "clustered", lambda i, p, f=D.clustered: made.append(1) or f(i, p))
    monkeypatch.setattr(C, "inputs", lambda s, d: inputs)
    inputs = tables(spark, {"v": visit(3)})
    assert C.clean(spark, "one")["clean"].count() == len(visit(3))
    assert C.derived(spark, "one").metrics.count() == 1 and len(made) == 1
    C._clustered.clear(), C._derived.clear()


def test_differences_of_stamps_are_made_once(spark):
    frames = spark.range(9).select(F.lit("v").alias("v"), F.lit(0).alias("chunk"), F.col("id").cast("int").alias("pos"), (F.col("id") / 4).alias("t"))
    got = CL.nominal_dt(frames, ["v"])
    # what is left reads the differences, not the frames
    assert "pos#" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r.nominal_dt for r in got.collect()] == [0.25]


def test_frames_do_not_move_to_meet_a_few_edited_ones(spark):
    """Frame numbers off their positions are looked up in one pass; the few numbers go to the frames."""
    key = [F.lit("s").alias("session_id"), F.lit("v").alias("video_id")]
    frames = spark.range(500).select(*key, (F.col("id") + 10).cast("int").alias("frame_index"), F.col("id").cast("int").alias("pos"))
    schema = ", ".join(f"{c} {t}" for c, t in B.CORRECTION_COLUMNS.items())
    rows = [("s", "v", i, "t", "range", None, None, None, None, None, None, None, "not_visible", a, z) + (None,) * 7 for i, a, z in (("in", 12, 20), ("out", 900, 950))]
    edits = CO.frame_edits(spark.createDataFrame(rows, schema), frames, CO.track_spans(frames))
    # the frames are read for the spans alone, what is left of the lookup is a table of its own
    assert edits._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 500") == 1
    assert {r.id: (r.lo, r.hi, r.in_range) for r in edits.collect()} == {"in": (2, 10, True), "out": (0, -1, False)}


def test_pairs_of_points_do_not_move_to_be_fitted(spark):
    """Null keys give no fit, missing points count in no product; the sums are those of a plain loop."""
    rows = [("a", 700 + 3.0 * i, 40.0 - i * i, 2 * i + 1.5, i % 4 - 900.25) for i in range(40)] + [("a", None, 3.0, 5.0, None), ("a", 1.0, 2.0, None, 4.0)]
    rows += [("b", 1.0, 2.0, 3.0, 4.0)] * 3 + [("c", 5.0, 5.0, 1.0, 1.0), (None, 1.0, 2.0, 3.0, 4.0), (None, 2.0, 2.0, 3.0, 5.0)]
    pairs = spark.createDataFrame(rows, "k string, fx double, fy double, tx double, ty double").repartition(4)
    got = FT.fit_similarity(pairs, ["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Join" not in plan
    fits = {r.k: r.transform for r in got.collect()}
    own = [r[1:] for r in rows if r[0] == "a"]
    mean = [statistics.fmean(p[j] for p in own if p[j] is not None) for j in range(4)]
    off = [[None if v is None else v - m for v, m in zip(p, mean)] for p in own]
    whole = [p for p in off if None not in p]
    dot = sum(p[0] * p[2] + p[1] * p[3] for p in whole)
    cross = sum(p[0] * p[3] - p[1] * p[2] for p in whole)
    var = sum(p[0] ** 2 + p[1] ** 2 for p in off if None not in p[:2])
    assert fits.keys() == {"a", "b", "c"} and fits["b"] is None and fits["c"] is None
    assert abs(fits["a"].scale - math.hypot(dot, cross) / var) < 1e-12
    assert abs((fits["a"].rotation_deg - math.degrees(math.atan2(cross, dot)) + 180) % 360 - 180) < 1e-9


BROADCAST_CONF = "spark.sql.autoBroadcastJoinThreshold"


@contextlib.contextmanager
def broadcast_below(spark, size):
    spark.conf.set(BROADCAST_CONF, size)
    try:
        yield
    finally:
        spark.conf.unset(BROADCAST_CONF)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_that_pack_well_are_not_broadcast_for_it(spark):
    """20,000 rows of a megabyte and more whose equal values fill a few kilobytes of files."""
    rows = spark.range(20_000, numPartitions=1).select((F.col("id") % 50).alias("k"), *[F.lit("a value that all rows share").alias(f"v{i}") for i in range(4)])
    other = materialise(spark.range(100_000).select("id", F.rand(1).alias("r")), "large-test")
    with broadcast_below(spark, "500k"):
        join = "id = k"
        assert "BroadcastHashJoin" in plan_of(other.join(materialise(rows, "packed-test"), F.expr(join)))
        plain = materialise_plain(rows, "plain-test")
        assert "BroadcastHashJoin" not in plan_of(other.join(plain, F.expr(join)))
        # few of them still are
        assert "BroadcastHashJoin" in plan_of(other.join(materialise_plain(rows.limit(20), "few-test"), F.expr(join)))
    assert sorted(plain.collect()) == sorted(rows.collect())


def test_geometry_and_edits_of_many_videos_stay_off_the_driver(spark):
    """The files of 150 equal geometries are far below the limit when packed, their rows, each with 20 holes, eight times above it."""
    corrections = [{"video_id": f"v{k}", "id": f"r{k}", "kind": "range", "range_type": "not_visible", "start_frame": 1, "end_frame": 50} for k in range(150)]
    inputs = tables(spark, {f"v{k}": visit(3) for k in range(150)}, corrections=corrections)
    with broadcast_below(spark, "20k"):
        stage = D.clustered(inputs, P.defaults())
        holes = stage["geometry"].select("session_id", "video_id", "holes")
        assert "BroadcastHashJoin" not in plan_of(stage["clean"].join(holes, ["session_id", "video_id"]))
        fields = materialise_plain(CO.edited_fields(stage["edits"], 1000), "fields-test")
        flat = CO.flat_frames(inputs.frames, 1000)
        assert "BroadcastHashJoin" not in plan_of(CO.apply_frame_edits(flat, fields))
    assert stage["clean"].filter("variant = 'c' AND reason = 'not_visible'").count() == 150 * 50


def test_edits_meet_the_frames_where_these_are_dealt(spark):
    """Neither an exchange nor a sort lies between the join of edits that are not broadcast and the windows."""
    corrections = [{"video_id": "v", "id": "p", "kind": "point", "point": "centroid", "frame_index": 9, "x": 1.0, "y": 2.0, "confidence": 1.0, "valid": True}]
    inputs = tables(spark, {"v": visit(3), "w": visit(4)}, corrections=corrections)
    flat = CO.flat_frames(inputs.frames, 16)
    edits = CO.frame_edits(inputs.corrections, inputs.frames, CO.track_spans(inputs.frames))
    fields = materialise_plain(CO.edited_fields(edits, 16).withColumn("variant", F.lit("c")), "fields-test")
    with broadcast_below(spark, "-1"), co_partitioned(spark), dealt_into(spark, 5):
        both = CO.both_variants(flat, edits, fields, 5)
        before = F.lag("t").over(Window.partitionBy(*CL.TRACK, "chunk").orderBy("pos"))
        above = plan_of(both.withColumn("before", before)).split("SortMergeJoin")[0]
        assert "Window" in above and "Exchange" not in above and "Sort " not in above
        rows = {(r.video_id, r.variant, r.pos): r for r in both.collect()}
    assert len(rows) == 2 * len(visit(3)) + len(visit(4))
    assert (rows["v", "c", 9].x, rows["v", "c", 9].c_src, rows["v", "a", 9].c_src) == (1.0, "corrected", "auto")
    assert {k for k, r in rows.items() if r.c_src == "corrected"} == {("v", "c", 9)}


def test_counts_of_regular_stamps_are_not_broadcast(spark):
    """The equal differences of 3,000 videos packed into small files, and their counts, one a video, went to the driver."""
    key = [F.lit("s").alias("session_id"), F.concat(F.lit("video-"), F.floor(F.col("id") / 41)).alias("video_id")]
    frames = spark.range(3000 * 41).select(*key, F.lit(0).alias("chunk"), (F.col("id") % 41).cast("int").alias("pos"), (F.col("id") % 41 / 4).alias("t"))
    with broadcast_below(spark, "100k"):
        got = CL.nominal_dt(frames, ["session_id", "video_id"])
        assert "BroadcastHashJoin" not in plan_of(got)
        assert {r.nominal_dt for r in got.collect()} == {0.25} and got.count() == 3000
