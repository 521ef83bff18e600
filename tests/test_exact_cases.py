"""Small cases with a known answer that the cohort's data does not reach."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wayfare import params as P
from wayfare.operators import selection as SE
from wayfare.operators import trial as T
from wayfare.operators.order_stats import lower_median, order_statistics
from wayfare.operators.timeline import overlaps
from wayfare.plans.incremental import invalid_parameters
from wayfare.sources import exports as EX
from wayfare.streaming import rederive


def test_cutoff_is_before_the_first_stamp_past_the_limit(spark):
    stamps = {"back": [0, 1, 2, 3, 4, 2.5, 5], "plain": [0, 1, 2, 3, 4, 5, 6], "short": [0, 1, 2]}
    rows = [("s", v, "c", 0, i, float(t), 100 + i, "single_blob") for v, ts in stamps.items() for i, t in enumerate(ts)]
    clean = spark.createDataFrame(rows, "session_id string, video_id string, variant string, chunk int, pos int, t double, frame_index int, reason string")
    at = "struct<pos:int,t:double,frame_index:int>"
    starts = spark.createDataFrame(
        [("s", v, "c", len(ts), (0, 0.0, 100), (0, 0.0, 100)) for v, ts in stamps.items()],
        f"session_id string, video_id string, variant string, n int, `from` {at}, auto {at}",
    )
    got = {r.video_id: tuple(r.cut) for r in T.cutoffs(clean, starts, P.defaults(trialCutoff_s=3), 1000).collect()}
    assert got == {"back": (3, 3.0, 103), "plain": (3, 3.0, 103), "short": (2, 2.0, 102)}


def test_a_video_without_rows_in_its_latest_epoch_has_none(spark, tmp_path):
    out, event = str(tmp_path), "session_id string, video_id string, event_id string"
    keys = lambda rows, e: spark.createDataFrame(rows, "session_id string, video_id string").write.parquet(f"{out}/keys/epoch={e}")
    rows = lambda rows, e: spark.createDataFrame(rows, event).write.parquet(f"{out}/events/epoch={e}")
    rows([("s", "a", "e1"), ("s", "b", "e2")], 0), keys([("s", "a"), ("s", "b")], 0)
    rows([], 1), keys([("s", "a")], 1)
    rows([("s", "b", "half")], 2)  # an epoch without its keys is not finished
    assert [r.event_id for r in rederive.latest(spark, out, "events").collect()] == ["e2"]


@pytest.mark.parametrize("value, text", [
    (0.0005, "0.0005"), (12345678.5, "12345678.5"), (1e-6, "0.000001"), (9.9e-7, "9.9e-7"), (1e21, "1e+21"), (1.5e20, "150000000000000000000"),
    (1e15, "1000000000000000"), (-0.00012, "-0.00012"), (0.0, "0"), (-2.0, "-2"), (0.1 + 0.2, "0.30000000000000004"), (float("inf"), ""), (None, ""),
])
def test_csv_numbers(spark, value, text):
    assert EX.csv_lines(spark.createDataFrame([(value,)], "v double")).first().value == text


def test_csv_of_an_empty_table_has_its_header(spark, tmp_path):
    EX.write_csv(spark.createDataFrame([], "a int, `b,c` string"), str(tmp_path / "o"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "o").glob("part-*")) == b'a,"b,c"\r\n'


def test_true_provenance_wins_in_the_parameter_file():
    text = EX.parameters_json({**P.DEFAULTS, "toolVersion": "stray", "parametersHash": "stray"}, "9.9")
    read = json.loads(text)
    assert list(read)[:2] == ["toolVersion", "parametersHash"] and text.endswith("}\n")
    assert (read["toolVersion"], read["parametersHash"]) == ("9.9", P.parameters_hash(P.DEFAULTS))


def test_order_statistics_with_one_extreme_value(spark):
    rng = random.Random(5)
    values = [0.033 + rng.random() * 1e-4 for _ in range(12_000)] + [3600.0]
    df = spark.createDataFrame([("g", v) for v in values], "k string, v double")
    s = sorted(values)
    assert lower_median(df, ["k"], F.col("v"), "m").first().m == s[(len(s) - 1) // 2]
    ranks = {"first": F.lit(0), "last": F.col("n") - 1, "tenth": F.floor(F.col("n") / 10)}
    r = order_statistics(df, ["k"], F.col("v"), ranks).first()
    assert (r.n, r["first"], r["last"], r.tenth) == (len(s), s[0], s[-1], s[len(s) // 10])


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(2)
    a = [(i, rng.randrange(900), rng.randrange(300)) for i in range(60)]
    b = [(i, rng.randrange(900), rng.randrange(300)) for i in range(60)]
    left = spark.createDataFrame([("s", "v", i, lo, lo + n) for i, lo, n in a], "session_id string, video_id string, i int, lo int, hi int")
    right = spark.createDataFrame([("s", "v", i, lo, lo + n) for i, lo, n in b] + [("s", "v", 99, None, 5)], "session_id string, video_id string, j int, c int, d int")
    got = sorted((r.i, r.j) for r in overlaps(left, right, ("lo", "hi"), ("c", "d")).collect())
    assert got == sorted((i, j) for i, lo, n in a for j, c, m in b if c <= lo + n and lo <= c + m)


def test_every_blob_of_a_frame_is_a_candidate(spark):
    rows = [("s", "v", 0, k, float(100 - k), float(10 * k), 0.0) for k in range(12)] + [("s", "v", 1, k, float(50 + k), float(k) / 10, 0.0) for k in range(12)]
    blobs = spark.createDataFrame(rows, "session_id string, video_id string, frame_index int, first_index int, area double, cx double, cy double")
    px = spark.createDataFrame([("s", "v", 89.5, 5.0)], "session_id string, video_id string, min_area double, merge_px double")
    got = SE.rank_candidates(blobs, px).collect()
    assert sorted((r.frame_index, r["rank"], r.n) for r in got) == [(0, k, 11) for k in range(11)]


def test_parameter_sets_in_a_table(spark):
    rows = [("a", "trialCutoff_s", 0.0), ("a", "noseConfidenceCutoff", 0.5), ("b", "kinematicsSmoothingWindowFrames", 4.0), ("b", "kinematics.duplicateTimestampFactor", 1.0), ("b", "strategy.serialMinRun", None)]
    got = invalid_parameters(spark.createDataFrame(rows, "k string, path string, value double"), ["k"])
    assert {(r.k, r.path) for r in got.collect()} == {("a", "trialCutoff_s"), ("b", "kinematicsSmoothingWindowFrames"), ("b", "kinematics.duplicateTimestampFactor"), ("b", "strategy.serialMinRun")}
    assert P.problems(P.defaults(trialCutoff_s=0)) == ["trialCutoff_s = 0: want number in (0, inf)"]
