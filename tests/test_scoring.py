"""Every cutoff, one step either side of it."""

import pytest
from pyspark.sql import functions as F

from drawbook.functions import scoring
from drawbook.operators import markers as M

COLUMNS = ("kind string, direction string, optimal double, moderate double, inclusive boolean, moderate_inclusive boolean, range_source string, "
           "low_ok_on_trt boolean, on_trt boolean, lo double, hi double, v double")
CASES = [
    # lower is better, open optimal cutoff, closed moderate cutoff
    (("bounded", "lower", 1.0, 3.0, False, True, None, False, None, None, None, 0.5), (94, "optimal")),
    (("bounded", "lower", 1.0, 3.0, False, True, None, False, None, None, None, 1.0), (88, "moderate")),
    (("bounded", "lower", 1.0, 3.0, True, True, None, False, None, None, None, 1.0), (88, "optimal")),
    (("bounded", "lower", 1.0, 3.0, False, True, None, False, None, None, None, 3.0), (50, "moderate")),
    (("bounded", "lower", 1.0, 3.0, False, False, None, False, None, None, None, 3.0), (50, "flag")),
    (("bounded", "lower", 1.0, 3.0, False, True, None, False, None, None, None, 30.0), (8, "flag")),
    (("bounded", "lower", 0.0, 3.0, True, True, None, False, None, None, None, 0.0), (100, "optimal")),
    # higher is better
    (("bounded", "higher", 30.0, 20.0, True, False, None, False, None, None, None, 30.0), (88, "optimal")),
    (("bounded", "higher", 30.0, 20.0, True, False, None, False, None, None, None, 100.0), (100, "optimal")),
    (("bounded", "higher", 30.0, 20.0, True, False, None, False, None, None, None, 25.0), (69, "moderate")),
    (("bounded", "higher", 30.0, 20.0, True, False, None, False, None, None, None, 20.0), (50, "flag")),
    (("bounded", "lower", None, 3.0, True, True, None, False, None, None, None, 1.0), (None, "unscored")),
    (("bounded", "lower", 1.0, 3.0, True, True, None, False, None, None, None, None), (None, None)),
    # two-sided
    (("range", None, None, None, True, True, "library", False, None, 10.0, 20.0, 10.0), (96, "optimal")),
    (("range", None, None, None, True, True, "library", False, None, 10.0, 20.0, 30.0), (50, "moderate")),
    (("range", None, None, None, True, True, "library", False, None, 10.0, 20.0, 31.0), (41, "flag")),
    (("range", None, None, None, True, True, "library", False, None, 10.0, 10.0, 11.0), (8, "flag")),
    (("range", None, None, None, True, True, "lab", False, None, 10.0, 20.0, 21.0), (20, "flag")),
    (("range", None, None, None, True, True, "lab", False, None, 10.0, 20.0, 20.0), (96, "optimal")),
    # low results under treatment
    (("range", None, None, None, True, True, "library", True, True, 10.0, 20.0, 9.0), (96, "optimal")),
    (("range", None, None, None, True, True, "library", True, None, 10.0, 20.0, 9.0), (20, "flag")),
]


def test_score_boundaries(spark):
    df = spark.createDataFrame([(i, *row) for i, (row, _) in enumerate(CASES)], "i int, " + COLUMNS)
    out = {r.i: (r.s_pct, r.s_tier) for r in scoring.with_score(df, "s", "v", F.col("lo"), F.col("hi")).collect()}
    assert [out[i] for i in range(len(CASES))] == [want for _, want in CASES]


@pytest.mark.parametrize("blood, symptom, structure, want", [
    (80.0, 50.0, 96.0, 72.6), (80.0, None, 96.0, (80 * 60 + 96 * 10) / 70), (80.0, 50.0, None, 70.0), (80.0, None, None, 80.0), (None, 50.0, None, None)])
def test_weights_are_redistributed(spark, blood, symptom, structure, want):
    df = spark.createDataFrame([(blood, symptom, structure)], "a double, b double, c double")
    got = df.select(scoring.overall(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert got == want or abs(got - want) < 1e-9


def test_body_composition_bands(spark):
    rows = [("female", 10.0, 75), ("female", 13.99, 75), ("female", 14.0, 96), ("female", 32.0, 20), ("male", 18.0, 50), ("male", 25.0, 20), (None, 20.0, None)]
    df = spark.createDataFrame(rows, "sex string, pct double, want int")
    assert all(r.got == r.want for r in df.select("want", scoring.body_fat_score(F.col("pct"), F.col("sex")).alias("got")).collect())
    vat = spark.createDataFrame([(99.9, 96), (100.0, 50), (160.0, 20)], "a double, want int")
    assert all(r.got == r.want for r in vat.select("want", scoring.vat_score(F.col("a")).alias("got")).collect())


def test_system_and_overall_anchor(spark):
    """Systems 96, 96, 84 and three without results at 50 make 71."""
    marks = [(1, "Drive", 96), (1, "Pace", 96), (1, "Fuel", 84)]
    df = spark.createDataFrame(marks, "subject_id bigint, system string, now_pct int").withColumns({
        "test": F.lit("T"), "then_pct": F.lit(None).cast("int"), "now_tier": F.lit("optimal")})
    systems = M.rollup_systems(df)
    assert sorted(r.now_score for r in systems.collect()) == [50, 50, 50, 84, 96, 96]
    assert M.rollup_overall(systems).first().overall_now == 71
