import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare import params as P
from wayfare.functions import geometry as G
from wayfare.functions.numbers import fmt, round_half_up
from wayfare.operators import correction_edits as CE
from wayfare.operators import review as RV
from wayfare.operators.order_stats import lower_median, midpoint_median, nearest_rank
from wayfare.operators.timeline import Carry, carry, neighbours, renumber
from wayfare.sources import exports as EX


def test_default_hashes_are_stable():
    assert P.parameters_hash(P.DEFAULTS) == "9c3cf1d9fcc38f3dc9bab449a037d020df7a3542029a0517f7e4c318bb742c4d"
    assert P.tracking_hash(P.DEFAULTS) == "f231baa09bab0a8182c53c35783bfdb934e836d54f9e194df074abb5a1b987b2"
    assert P.parameters_hash({**P.DEFAULTS, "toolVersion": "x"}) == P.parameters_hash(P.DEFAULTS)


@pytest.mark.parametrize(
    "path,value",
    [("trialCutoff_s", 0), ("kinematicsSmoothingWindowFrames", 4), ("kinematics__dropGapFactor", 1), ("noseConfidenceCutoff", 1.5), ("quality__poorMaxPositionedFraction", 0.95)],
)
def test_bad_parameters_are_named(path, value):
    found = P.problems(P.defaults(**{path: value}))
    assert any(path.replace("__", ".") in f for f in found)


def test_order_statistics_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 501), ("d", 1000)) for v in rng.choice([0.1, 0.2, 5.0, 7.5, rng.random()], n)]
    rows += [("e", 4.0)] * 50 + [("f", float(v)) for v in rng.normal(size=2000)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    mid = {r.k: r.m for r in midpoint_median(df, ["k"], F.col("v"), "m").collect()}
    low = {r.k: r.m for r in lower_median(df, ["k"], F.col("v"), "m").collect()}
    p95 = {r.k: r.p for r in nearest_rank(df, ["k"], F.col("v"), {"p": 0.95}).collect()}
    for k, v in want.items():
        s = sorted(v)
        assert mid[k] == pytest.approx(float(np.median(s)))
        assert low[k] == s[(len(s) - 1) // 2]
        assert p95[k] == s[math.floor(0.95 * (len(s) - 1) + 0.5)]


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_carry_and_neighbours_across_chunks(spark, size):
    n = 40
    rows = [("s", "v", i // size, i, float(i) if i % 5 == 2 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "session_id string, video_id string, chunk int, pos int, v double")
    out = carry(df, [Carry("back", F.col("v")), Carry("ahead", F.col("v"), following=True), Carry("upto", F.col("v"), inclusive=True)])
    out = neighbours(out, F.col("pos"), 2, 2, "near") if size >= 3 else out
    vals = [r[4] for r in rows]
    for r in out.collect():
        i = r.pos
        assert r.back == next((v for v in reversed(vals[:i]) if v is not None), None)
        assert r.ahead == next((v for v in vals[i + 1 :] if v is not None), None)
        assert r.upto == next((v for v in reversed(vals[: i + 1]) if v is not None), None)
        assert [v["at"] for v in r.near] == [j for j in range(i - 2, i + 3) if 0 <= j < n]
    kept = renumber(df.filter("v is not null"), size).collect()
    assert sorted((r.pos, r.idx) for r in kept) == [(p, k) for k, p in enumerate(i for i in range(n) if i % 5 == 2)]


def test_rounding_and_formatting(spark):
    r = spark.range(1).select(
        round_half_up(F.lit(-0.0125), 3).alias("a"), round_half_up(F.lit(2.5), 0).alias("b"), fmt("%.2f", F.lit(None).cast("double")).alias("c"),
        G.angle_difference_deg(F.lit(10.0), F.lit(350.0)).alias("d"), G.ring_distance(F.lit(19), F.lit(1), F.lit(20)).alias("e"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (-0.012, 3.0, None, 20.0, 2)


def test_frame_ranges(spark):
    df = spark.createDataFrame([("0-74, 90-120",), ("5; 1-4",), ("9..7",), ("a-b",), ("",)], "t string")
    got = [r[0] for r in df.select(RV.format_ranges(RV.parse_ranges(F.col("t")))).collect()]
    assert got == ["0-74, 90-120", "1-5", "7-9", None, ""]


def test_csv_quotes_only_when_needed(spark, tmp_path):
    df = spark.createDataFrame([('a,b', 'say "x"', None, float("nan"), 1.5)], "a string, b string, c string, d double, e double")
    assert [r.value for r in EX.csv_lines(df).collect()] == ['"a,b","say ""x""",,,1.5']
    EX.write_csv(df.coalesce(1), str(tmp_path / "o"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "o").glob("part-*")).decode()
    assert text == 'a,b,c,d,e\r\n"a,b","say ""x""",,,1.5\r\n'


def test_parameter_sheet_takes_nearest_definition(spark):
    defs = spark.createDataFrame([("tracking.threshold", "both"), ("tracking", "all"), ("trialCutoff_s", "cut")], "def_path string, definition string")
    rows = {r.path: r for r in EX.parameter_sheet(spark, P.DEFAULTS, defs).collect()}
    assert rows["tracking.threshold.mode"].definition == "both" and rows["tracking.smallBlobFactor"].definition == "all"
    assert rows["trialCutoff_s"].value == "180" and rows["trialCutoff_s"].unit == "s" and rows["noseConfidenceCutoff"].definition is None


def test_ranges_split_trim_and_merge(spark):
    m = spark.createDataFrame(
        [("s", "v", "a", "1", "not_visible", 0, 99), ("s", "v", "b", "2", "in_escape_box", 40, 49), ("s", "v", "c", "3", None, 90, 200), ("s", "v", "d", "4", "not_visible", 50, 55), ("s", "v", "e", "5", "not_visible", 2000, 1990)],
        "session_id string, video_id string, id string, timestamp string, range_type string, start_frame int, end_frame int",
    )
    got = sorted((r.start_frame, r.end_frame, r.range_type) for r in CE.resolve_ranges(m).collect())
    assert got == [(0, 39, "not_visible"), (40, 49, "in_escape_box"), (50, 89, "not_visible"), (1990, 2000, "not_visible")]


def test_circle_rotation_and_resolution_transforms(spark):
    c = lambda x, y, r: F.struct(F.lit(x).alias("cx"), F.lit(y).alias("cy"), F.lit(r).alias("r"))
    names = ("translate_x", "translate_y", "rotation_deg", "scale")
    onto = G.circle_to_circle(c(10.0, 20.0, 5.0), c(100.0, 50.0, 10.0))
    row = spark.range(1).select(
        onto.alias("onto"), F.struct(*G.apply_point(onto, F.lit(15.0), F.lit(20.0))).alias("rim"),
        G.circle_to_circle(c(1.0, 1.0, 0.0), c(1.0, 1.0, 2.0)).isNull().alias("none"),
        F.struct(*G.apply_point(G.rotation_about(F.lit(90.0), F.lit(3.0), F.lit(4.0)), F.lit(3.0), F.lit(4.0))).alias("fixed"),
        F.struct(*G.apply_point(G.rotation_about(F.lit(180.0), F.lit(3.0), F.lit(4.0)), F.lit(4.0), F.lit(6.0))).alias("turned"),
        G.resolution_ratio(F.lit(640.0), F.lit(1280.0))["scale"].alias("ratio"), G.resolution_ratio(F.lit(0.0), F.lit(5.0))["scale"].alias("unknown"),
    ).first()
    assert tuple(row.onto[n] for n in names) == (80.0, 10.0, 0.0, 2.0)
    assert tuple(row.rim) == (110.0, 50.0) and row.none
    assert tuple(row.fixed) == pytest.approx((3.0, 4.0)) and tuple(row.turned) == pytest.approx((2.0, 2.0))
    assert (row.ratio, row.unknown) == (2.0, 1.0)
