from pyspark.sql import functions as F

from tests.tracks import CX, CY, hole, tables, visit, walk
from wayfare import params as P
from wayfare.plans.derive import derive
from catalog import benchmark as B

SF = "/root/testdata/sf0.001"


def _events(d, vid="v"):
    return [r for r in d.events.filter(F.col("video_id") == vid).orderBy("start_frame", "kind").collect()]


def _metrics(d):
    return {r.video_id: r for r in d.metrics.collect()}


def _flags(d):
    return sorted(r.code for r in d.flags.collect())


def test_scripted_cohort(spark):
    """Visits, errors, an escape, a short entry, a loss away from holes and an unresolved trial in one run."""
    lost = [None] * 40
    videos = {
        "walk": visit(12, 11, 10, 7),
        "escape": visit(3, 7) + lost + [None] * 80,
        "poke": visit(7) + [None] * 45 + [hole(7)] * 30 + walk(hole(7), (CX, CY), 30),
        "loss": visit(4) + walk(hole(4), (CX, CY), 30) + lost + walk((CX, CY), hole(5), 30) + [hole(5)] * 10,
        "other": visit(2) + [None] * 60 + [hole(2)] * 10,
        "blind": [None] * 50,
        "merge": visit(6, dwell=10) + walk(hole(6), hole(6, 6), 5) + walk(hole(6, 6), hole(6), 5) + [hole(6)] * 10,
    }
    d = derive(tables(spark, videos), P.defaults())
    m = _metrics(d)
    assert (m["walk"].total_errors, m["walk"].primary_errors, m["walk"].strategy) == (3, 3, "serial")
    assert [e.hole_index for e in _events(d, "walk")] == [12, 11, 10, 7]
    assert m["escape"].escaped and m["escape"].total_latency_s is not None and m["escape"].total_errors == 1 and m["escape"].status == "ok"
    assert [e.kind for e in _events(d, "escape")] == ["investigation", "investigation", "escape_entry"]
    assert m["poke"].escaped is False and "escape_entry" in [e.kind for e in _events(d, "poke")]
    assert [(e.kind, e.hole_index) for e in _events(d, "loss") if e.kind == "tracking_failure"] == [("tracking_failure", None)]
    assert ("other", "physically_unlikely_entry") in {(r.video_id, r.code) for r in d.flags.collect()}
    assert m["blind"].status == "unresolved" and m["blind"].total_errors is None and m["blind"].strategy == "unclassified"
    assert len(_events(d, "merge")) == 1
    q = {r.video_id: r for r in d.quality.collect()}
    assert q["walk"].tier == "GOOD" and q["blind"].tier == "POOR" and q["blind"].gap_count == 1


def test_cutoff_censoring_and_probe(spark):
    frames = visit(3, 7) + [None] * 150
    p = P.defaults(trialCutoff_s=1, trialCensoring__censorToCutoff=True)
    m = _metrics(derive(tables(spark, {"v": frames}), p))["v"]
    assert m.total_latency_s == 1.0 and m.escaped is False
    m = _metrics(derive(tables(spark, {"v": frames}, trial_type="probe"), P.defaults()))["v"]
    assert m.escaped is None and m.total_latency_s is None and m.no_escape_confirmed is None


def test_deleting_the_entry_moves_the_end(spark):
    """A deleted escape entry no longer ends the trial: what comes after it is detected again."""
    frames = visit(3, 7) + [None] * 120 + [hole(7)] * 5 + walk(hole(7), hole(9), 30) + [hole(9)] * 20
    first = derive(tables(spark, {"v": frames}), P.defaults())
    entry = next(e for e in _events(first) if e.kind == "escape_entry")
    assert 9 not in [e.hole_index for e in _events(first)]
    edits = [{"video_id": "v", "id": "d", "kind": "event", "action": "delete", "event_id": entry.event_id}]
    d = derive(tables(spark, {"v": frames}, corrections=edits), P.defaults())
    assert 9 in [e.hole_index for e in _events(d)] and _metrics(d)["v"].escaped is False
    assert d.bounds.filter("variant = 'c'").first().end_reason == "end_of_video"
    assert _metrics(d)["v"].correction_count == 1


def test_event_edits(spark):
    frames = visit(3, 5, 7) + [None] * 120
    base = _events(derive(tables(spark, {"v": frames}), P.defaults()))
    three, five = (next(e for e in base if e.hole_index == h) for h in (3, 5))
    entry = next(e for e in base if e.kind == "escape_entry")
    edits = [
        {"video_id": "v", "id": "e1", "kind": "event", "action": "edit", "event_id": three.event_id, "hole_index": 4},
        {"video_id": "v", "id": "e2", "kind": "event", "action": "edit", "event_id": five.event_id, "confirmed": True},
        {"video_id": "v", "id": "e3", "kind": "event", "action": "edit", "event_id": entry.event_id, "new_kind": "tracking_failure"},
        {"video_id": "v", "id": "e4", "kind": "event", "action": "edit", "event_id": "auto-investigation-h1-f1", "confirmed": True},
        {"video_id": "v", "id": "e5", "kind": "event", "action": "add", "hole_index": 99, "start_frame": 1, "end_frame": 2},
        {"video_id": "v", "id": "e6", "kind": "event", "action": "edit", "event_id": "gone", "hole_index": 8, "start_frame": 40, "end_frame": 50},
    ]
    d = derive(tables(spark, {"v": frames}, corrections=edits), P.defaults())
    ev = {e.event_id: e for e in _events(d)}
    assert ev[three.event_id].hole_index == 4 and ev[three.event_id].source == "corrected" and ev[three.event_id].auto_shadow.hole_index == 3
    assert ev[five.event_id].confirmed and ev[five.event_id].source == "auto"
    assert ev[entry.event_id].kind == "tracking_failure" and ev[entry.event_id].auto_shadow.kind == "escape_entry"
    assert ev["gone"].hole_index == 8 and ev["gone"].auto_shadow is None and ev["gone"].min_centroid_cm is not None
    assert _flags(d).count("orphaned_correction") == 1 and "confirmation_contradicted" in _flags(d)
    m = _metrics(d)["v"]
    assert m.correction_count == 4 and m.escaped is False


def test_range_removes_an_event_and_says_so(spark):
    frames = visit(3, 5)
    e = _events(derive(tables(spark, {"v": frames}), P.defaults()))[0]
    edits = [{"video_id": "v", "id": "r", "kind": "range", "range_type": "not_visible", "start_frame": e.start_frame - 2, "end_frame": e.end_frame + 2}]
    d = derive(tables(spark, {"v": frames}, corrections=edits), P.defaults())
    assert "auto_event_removed_by_correction" in _flags(d)
    assert d.removed.first().event_id == e.event_id and _metrics(d)["v"].correction_count == 2


def test_marked_entry_and_non_escape(spark):
    frames = visit(3) + walk(hole(3), (CX, CY), 30) + [None] * 150
    n = len(frames)
    edits = [
        {"video_id": "v", "id": "b", "kind": "range", "range_type": "in_escape_box", "start_frame": n - 140, "end_frame": n - 1},
        {"video_id": "v", "id": "n", "kind": "no_escape", "reason_text": "sure"},
    ]
    d = derive(tables(spark, {"v": frames}, corrections=edits), P.defaults())
    assert _metrics(d)["v"].escaped and {"no_escape_contradicted", "physically_unlikely_entry"} <= set(_flags(d))


def test_gap_filling_and_outliers(spark):
    a, b = (CX - 50, CY), (CX - 47, CY)
    frames = [a] * 20 + [None, None] + [b] * 20 + [(CX + 150, CY)] + [b] * 20
    p = P.defaults(gapFilling__enabled=True)
    d = derive(tables(spark, {"v": frames}), p)
    c = {r.pos: r for r in d.clean.filter("variant = 'c'").collect()}
    assert c[20].filled and abs(c[20].x - (CX - 49)) < 1e-6 and c[20].state == "not_detected"
    assert c[42].outlier and not c[42].c_valid and c[43].outlier


def test_chunks_change_nothing(spark):
    """Cutting tracks into chunks of 96 frames gives what whole tracks give."""

    def run(size):
        spark.conf.set("spark.wayfare.chunkFrames", str(size))
        try:
            from wayfare.plans.derive import Inputs

            i = Inputs(B.frames(spark, SF), B.videos(spark, SF), B.maze_maps(spark), B.corrections(spark, SF))
            d = derive(i, P.defaults())
            pick = {
                "events": d.events.select("video_id", "event_id", "evidence", "source", F.round("min_centroid_cm", 6)),
                "metrics": d.metrics.select("video_id", "total_errors", "status", "strategy", F.round("path_length_cm", 6), F.round("primary_latency_s", 6)),
                "gaps": d.gaps.select("video_id", "start_frame", "end_frame", "location_class", F.round("duration_s", 6)),
                "flags": d.flags.select("video_id", "code", "frame_index", "event_id"),
                "quality": d.quality.select("video_id", "tier", F.round("positioned_fraction", 9), "duplicate_timestamp_count", F.round("drift_s", 6)),
            }
            return {k: sorted(str(r) for r in v.collect()) for k, v in pick.items()}
        finally:
            spark.conf.unset("spark.wayfare.chunkFrames")

    whole, cut = run(49_152), run(96)
    for k in whole:
        assert whole[k] and whole[k] == cut[k], k
