import math
import random

import pytest
from pyspark.sql import functions as F

from tests.tracks import CX, CY, hole, tables, visit
from wayfare import params as P
from wayfare.operators import selection as SE
from wayfare.operators.timeline import KEY
from wayfare.session import PARTITIONS_CONF, dealt_into
from wayfare.sources import intake, session_json, session_parts
from wayfare.streaming import online, rederive

LIM = {"min_area": 80.0, "max_area": 1600.0, "merge_px": 35.0, "near_px": 27.0, "oversized": 3.0, "small": 0.5}


def _observations(spark, n, chunk):
    """Random candidate lists over two videos; long stretches have two plausible blobs far apart."""
    rng = random.Random(5)
    rows = []
    for vid in ("a", "b"):
        x, y = CX, CY
        for i in range(n):
            x, y = x + rng.uniform(-6, 6), y + rng.uniform(-6, 6)
            blobs = [(500.0, x, y)]
            kind = rng.random()
            if 20 <= i % 100 < 75:
                blobs.append((400.0, x + 80, y))
            elif kind < 0.1:
                blobs = []
            elif kind < 0.15:
                blobs.append((3000.0, x, y + 50))
            elif kind < 0.25:
                blobs.append((200.0, x + 10, y))
            blobs.sort(key=lambda b: -b[0])
            cs = [(k, b[0], b[1], b[2], False) for k, b in enumerate(blobs)]
            u = None
            if len(cs) == 2 and math.dist(cs[0][2:4], cs[1][2:4]) <= LIM["merge_px"]:
                u = (cs[0][1] + cs[1][1], (cs[0][2] + cs[1][2]) / 2, (cs[0][3] + cs[1][3]) / 2, False)
            rows.append(("s", vid, i // chunk, i, i, i / 30.0, cs, u))
    return spark.createDataFrame(
        rows,
        "session_id string, video_id string, chunk int, pos int, frame_index int, t double, cs array<struct<rank:int,area:double,cx:double,cy:double,rim:boolean>>, u struct<area:double,cx:double,cy:double,rim:boolean>",
    )


def _judged(r, prev):
    """(reason, rank, position) of one observation by hand, for an expected area of 500."""
    top = min(LIM["max_area"], LIM["oversized"] * 500.0)
    ok = [b for b in r.cs if b.area >= LIM["min_area"]]
    if r.cs and r.cs[0].area > top:
        return "oversized_blob", -1, None
    if not ok:
        return "no_foreground", -1, None
    usual = "single_blob"
    if len(ok) > 1:
        if r.u is not None and LIM["min_area"] <= r.u.area <= top:
            return "fragmented", -2, (r.u.cx, r.u.cy)
        ok = [b for b in ok if prev is not None and math.dist((b.cx, b.cy), prev) <= LIM["near_px"]]
        usual = "proximity_to_previous"
    if len(ok) != 1:
        return "multiple_blobs", -1, None
    why = "partial_at_rim" if ok[0].rim else "small_blob" if ok[0].area < LIM["small"] * 500.0 else usual
    return why, ok[0].rank, (ok[0].cx, ok[0].cy)


def _brute(rows, left_out=()):
    out, prev, last = {}, None, None
    for r in sorted(rows, key=lambda r: (r.video_id, r.pos)):
        if r.video_id != last:
            prev, last = None, r.video_id
        if r.pos in left_out:
            continue
        reason, rank, at = _judged(r, prev)
        prev = at or prev
        out[(r.video_id, r.pos)] = (reason, rank)
    return out


@pytest.mark.parametrize("chunk", [10, 1000])
def test_selection_matches_a_plain_loop(spark, chunk):
    """Stretches longer than a chunk go on in later rounds and end the same."""
    obs = _observations(spark, 230, chunk)
    px = spark.createDataFrame([("s", v, *[float(LIM[k]) for k in ("max_area", "min_area", "merge_px", "near_px")]) for v in "ab"], "session_id string, video_id string, max_area double, min_area double, merge_px double, near_px double")
    exp = px.select(*KEY, F.lit(500.0).alias("expected_area"))
    got = {(r.video_id, r.pos): (r.reason, r["rank"]) for r in SE.select(obs, px, exp, P.defaults()).collect()}
    assert got == _brute(obs.collect())


def _online(spark, tmp_path, files, **options):
    """Each group of frame numbers is one file and one micro-batch, read in the order given."""
    obs = _observations(spark, 150, 1000)
    px = F.struct(F.lit(500.0).alias("expected"), *[F.lit(LIM[k]).alias(k) for k in ("max_area", "min_area", "merge_px", "near_px", "oversized", "small")])
    full, src = obs.withColumn("px", px), str(tmp_path / "in")
    for numbers in files:
        full.filter(F.col("pos").isin(list(numbers))).orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = f"chosen_{tmp_path.name.replace('-', '_')}"
    q = online.select_stream(stream, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        rows = spark.sql(f"select * from {name}").collect()
    finally:
        q.stop()
    taken = {(r.video_id, r.frame_index): (r.reason, r["rank"]) for r in rows if r.accepted}
    return taken, sorted((r.video_id, r.frame_index) for r in rows if not r.accepted), obs.collect()


def test_online_selection_in_any_order(spark, tmp_path):
    """Files out of order give what the loop gives; early frames wait for the ones before them."""
    taken, passed, obs = _online(spark, tmp_path, [range(60, 100), range(0, 30), range(100, 150), range(30, 60)])
    assert taken == _brute(obs) and not passed


def test_online_selection_gives_up_missing_frames(spark, tmp_path):
    """Frame 45 is missing and given up once a frame lies more than 50 ahead; when it comes it is set aside."""
    rest = [n for n in range(150) if n != 45]
    taken, passed, obs = _online(spark, tmp_path, [rest[:60], rest[60:], [45]], held=50)
    assert taken == _brute(obs, [45]) and passed == [("a", 45), ("b", 45)]


def test_replay_reads_several_files_in_a_micro_batch(spark, tmp_path, monkeypatch):
    """Micro-batches and parts of the states do not grow with the files and the shuffle partitions; the rows stay the loop's."""
    obs = _observations(spark, 150, 1000)
    px = F.struct(F.lit(500.0).alias("expected"), *[F.lit(LIM[k]).alias(k) for k in ("max_area", "min_area", "merge_px", "near_px", "oversized", "small")])
    monkeypatch.setattr(online, "FILE_ROWS", 10)
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(online, "MOST_FILES", 2 * cores)
    with dealt_into(spark, 3 * cores):
        rows = online.replay(obs.withColumn("px", px), str(tmp_path), 2).collect()
        assert spark.conf.get(PARTITIONS_CONF) == str(3 * cores)
    assert all(r.accepted for r in rows)
    assert {(r.video_id, r.frame_index): (r.reason, r["rank"]) for r in rows} == _brute(obs.collect())
    files = len(list((tmp_path / "in").glob("*.parquet")))
    batches = [f for f in (tmp_path / "checkpoint" / "commits").iterdir() if f.name.isdigit()]
    assert files > 2 * cores and len(batches) == -(-files // (2 * cores))
    states = [f for f in (tmp_path / "checkpoint" / "state" / "0").iterdir() if f.name.isdigit()]
    assert len(states) == cores


def test_held_frames_are_bounded():
    import numpy as np

    assert online._released(np.array([3, 4, 9]), 3, 50) == (2, 5)
    assert online._released(np.array([5, 6, 60]), 3, 50) == (2, 10)
    assert online._released(np.array([10, 11, 60]), 3, 50) == (2, 12)
    assert online._released(np.array([], dtype=int), 3, 50) == (0, 3)


def test_incremental_stream(spark, tmp_path):
    """Only the changed video is derived again, and readers see its latest epoch."""
    frames = {"v": visit(3, 5), "w": visit(8)}
    keys = str(tmp_path / "keys")
    spark.createDataFrame([("s", "v")], "session_id string, video_id string").write.parquet(keys)
    changes = spark.readStream.schema("session_id string, video_id string").parquet(keys)
    out = str(tmp_path / "out")
    rederive.rederive_stream(changes, lambda s: tables(s, frames), P.defaults(), out, str(tmp_path / "cp")).awaitTermination()
    got = rederive.latest(spark, out, "metrics").collect()
    assert [(r.video_id, r.total_errors) for r in got] == [("v", 2)]


def test_session_documents(spark):
    frame = '{"frameIndex":0,"t_s":0,"centroid":{"x":1,"y":2,"confidence":1,"valid":true,"source":"auto"},"nose":{"x":0,"y":0,"confidence":0,"valid":false,"source":"auto"},"detectionState":"tracked","reason":"single_blob","blobArea_px2":5,"boundingBox":null,"noseHeadingConfidence":0}'
    doc = '{"schemaVersion":%s,"toolVersion":"t","sessionId":"11111111-1111-1111-1111-111111111111","name":"n","reviewer":null,"videos":[{"id":"v","filename":"f","fingerprint":{"byteLength":1,"durationSeconds":1,"frameCount":1,"sha256":"x"},"metadata":{"animal":"M"}%s}],"mazeMap":{"holes":{"n":20}},"parameters":null,"analyses":{"v":{"auto":{"parametersHash":"h","frames":[' + frame + ']},"corrections":{"entries":[{"kind":"point","id":"c","timestamp":"t","frameIndex":0,"point":"nose","value":{"x":1,"y":1,"confidence":1,"valid":true}}]}}}}'
    ok = ',"trialType":"probe","targetHole":4'
    texts = [doc % (2, ok), doc % (1, ""), doc % (3, ok), doc % (2, ',"trialType":"probe","targetHole":20'), doc % (2, ""), "{nope", '{"platform":{},"holes":{}}']
    docs = session_json.read_sessions(spark.createDataFrame([(t,) for t in texts], "value string"))
    got = [r.problem for r in docs.collect()]
    assert got[:2] == [None, None] and all(got[2:]), got
    v = {(r.trial_type, r.target_hole) for r in session_json.session_videos(docs).collect()}
    assert v == {("probe", 4), ("acquisition", None)}
    assert session_json.session_frames(docs).count() == 2 and session_json.session_corrections(docs).first().point == "nose"
    assert session_json.session_headers(docs.filter("problem is null").select("session_id", "name", "reviewer", "tool_version")).count() == 2


def _same(a, b, columns):
    return a.select(columns).exceptAll(b.select(columns)).isEmpty() and b.select(columns).exceptAll(a.select(columns)).isEmpty()


def test_session_documents_in_parts(spark, tmp_path):
    """What is written is read again; a session with a lost line, a foreign target or no lines gets its reason or its empty tables."""
    sid = [f"11111111-1111-1111-1111-11111111111{k}" for k in range(5)]
    i = tables(spark, {"v": visit(3, 5), "w": visit(8)})
    of = lambda d, k: d.withColumn("session_id", F.lit(sid[k]))
    both = lambda d: of(d, 0).unionByName(of(d, 1)).unionByName(of(d, 2))
    content = F.struct(F.lit(5).cast("bigint").alias("byte_length"), F.lit(0.1).alias("duration_s"), F.lit(3).cast("bigint").alias("frame_count"), F.lit("x").alias("sha256"))
    videos = both(i.videos).withColumn("fingerprint", content)
    videos = videos.withColumn("target_hole", F.when(F.col("session_id") == sid[2], 20).otherwise(F.lit(None)).cast("int"))
    entry = "struct<" + ",".join(f"{n}:{t}" for n, t in {
        "id": "string", "timestamp": "string", "kind": "string", "reviewer": "string", "frame_index": "int", "point": "string", "x": "double", "y": "double",
        "confidence": "double", "valid": "boolean", "range_type": "string", "start_frame": "int", "end_frame": "int", "action": "string", "event_id": "string",
        "new_kind": "string", "hole_index": "int", "confirmed": "boolean", "strategy": "string", "reason_text": "string"}.items()) + ">"
    corrections = spark.range(1).select(F.lit(sid[0]).alias("session_id"), F.lit("v").alias("video_id"), F.from_json(F.lit('{"id":"a","kind":"point","x":0.1,"reason_text":"a\\"b"}'), entry).alias("e")).select("session_id", "video_id", "e.*")
    sessions = spark.createDataFrame([(s, f"n{k}", None, "0.1", '{"holes":{"n":20}}') for k, s in enumerate(sid)], "session_id string, name string, reviewer string, tool_version string, maze_map string")
    sessions = sessions.withColumn("name", F.when(F.col("session_id") != sid[4], F.col("name")))
    parts = session_parts.Parts(sessions, videos, both(i.frames), corrections)
    counted = session_parts.manifest(parts)
    counted = counted.withColumn("parts", F.col("parts").withField("frames", F.col("parts.frames") + F.when(F.col("session_id") == sid[1], 1).otherwise(0)))
    session_parts.write_parts(parts, str(tmp_path / "d"), counted)
    got = session_parts.read_parts(spark, str(tmp_path / "d"))
    problems = {r.session_id: r.problem for r in got.sessions.collect()}
    assert problems == dict(zip(sid, [None, "its lines are not those that its header counts", "a video names a target its map does not have", None, "it has no session name"]))
    mine = lambda d: d.filter(F.col("session_id") == sid[0])
    assert _same(got.videos, mine(videos), [c for c in got.videos.columns if c in videos.columns])
    assert _same(got.frames, mine(parts.frames), got.frames.columns) and got.frames.count() > 100
    assert _same(got.corrections, corrections, corrections.columns)
    head = session_json.read_sessions(spark.read.text(str(tmp_path / "d" / "sessions")))
    assert {r.problem for r in head.collect()} == {"the header of a session in parts"}


def test_files_are_matched_by_content(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"one")
    (tmp_path / "b.avi").write_bytes(b"two")
    files = intake.read_files(spark, str(tmp_path))
    t = {r.path[-5:]: (r.accepted, r.hint) for r in intake.triage(files).collect()}
    assert t["a.mp4"] == (True, None) and t["b.avi"] == (False, "convert to MP4 with H.264")
    v = spark.createDataFrame([("s", "v", 3, "7692c3ad3540bb803c020b3aee66cd8887123234ea0c6e7143c0add73ff431ed")], "session_id string, video_id string, n bigint, h string")
    v = v.select(*KEY, F.struct(F.col("n").alias("byte_length"), F.col("h").alias("sha256")).alias("fingerprint"))
    assert intake.match(files, v).select("video_id").collect()[0].video_id == "v"


def test_hole_helper():
    assert math.dist(hole(0), hole(10)) > 300
