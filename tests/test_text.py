import pytest
from pyspark.sql import functions as F

from drawbook.functions import cells, dates, text


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw, want", [
    ("TMAO (Trimethylamine N-\noxide)", "tmao (trimethylamine n-oxide)"), ("  HS-CRP ", "hs-crp"), ("Test ( a )", "test (a)"), (None, "")])
def test_name_key(spark, raw, want):
    assert one(spark, raw, text.name_key) == want


@pytest.mark.parametrize("raw, want", [
    ("4/14/2026", (2026, 4, 14)), ("04-14-26", (2026, 4, 14)), ("2026-04-14", (2026, 4, 14)), ("April 14, 2026.", (2026, 4, 14)),
    ("Sept. 3 2025", (2025, 9, 3)), ("13/45/2026", (2026, 13, 45)), ("soon", None), ("Foo 3, 2025", None)])
def test_date_key(spark, raw, want):
    got = one(spark, raw, dates.date_key)
    assert (tuple(got) if got else None) == want


def test_calendar_check(spark):
    assert one(spark, "2/30/2026", lambda c: dates.valid_day(dates.date_key(c))) is None


@pytest.mark.parametrize("born, day, want", [("2000-02-29", "2025-02-28", 24), ("2000-02-29", "2025-03-01", 25), ("1800-01-01", "2025-01-01", None)])
def test_age(spark, born, day, want):
    df = spark.createDataFrame([(born, day)], "b string, d string")
    assert df.select(dates.age_on(F.to_date("b"), F.to_date("d"))).first()[0] == want


@pytest.mark.parametrize("raw, want", [("7:45 AM", 465), ("12:00 am", 0), ("12:30 PM", 750), ("23:59", 1439), ("25:00", None), ("13:00 PM", None)])
def test_clock(spark, raw, want):
    assert one(spark, raw, dates.clock_minutes) == want


@pytest.mark.parametrize("raw, want", [
    ("5.4", ("final", 5.4, "5.4")), ("<0.7", ("final", None, "<0.7")), ("12H", ("final", 12.0, "12")), ("TNP", ("not_performed", None, "")),
    ("0-2", ("final", None, "0-2")), ("Negative", ("final", None, "Negative")), ("odd", ("odd", None, "odd"))])
def test_cell_result(spark, raw, want):
    assert tuple(one(spark, raw, cells.cell_result)) == want


@pytest.mark.parametrize("raw, pieces, ambiguous", [
    ("12H5", ["12H", "5"], False), ("5<3", ["5", "<3"], False), ("1.52.5", ["1.52", ".5"], True), ("12", ["12"], False), ("abc", None, False)])
def test_split_cell(spark, raw, pieces, ambiguous):
    got = one(spark, raw, cells.split_cell)
    assert (got.pieces, got.ambiguous) == (pieces, ambiguous)


@pytest.mark.parametrize("raw, want", [("> OR = 5.4", ">=5.4"), (">OR=5.4", ">=5.4"), ("≥ 5.4", ">=5.4"), ("10 – 20 mg", "10-20 mg")])
def test_canonical_range(spark, raw, want):
    assert one(spark, raw, cells.canonical_range) == want


@pytest.mark.parametrize("result, flag, reference, role, want", [
    ("25", "H", "10-20", None, True), ("25", None, "10-20", None, False), ("20", None, "10-20", None, True), ("3.5", "H", ">3.0", None, True),
    ("25", None, "10-20", "out_of_range", True), ("<5", "L", "5-10", None, True), ("<6", None, "5-10", None, True), ("<6", "L", "5-10", None, False),
    ("30", None, "<30", None, False), ("30", None, "<=30", None, True), ("5", "H", "", None, True), ("25H", "L", "10-20", None, False)])
def test_flag_consistency(spark, result, flag, reference, role, want):
    df = spark.createDataFrame([(result, flag, reference, role)], "r string, f string, g string, c string")
    assert cells.with_flag_consistent(df, "r", "f", "g", "c").first().consistent is want


@pytest.mark.parametrize("entered, printed, want", [
    ("Pat S", "SYNTHETIC, PAT", "initial"), ("Pat Synthetic", "synthetic pat", "words"), ("Pat S", "Pat Synthetic", "initial"),
    ("Pat T", "SYNTHETIC, PAT", "none"), ("Pat", "Pat Synthetic", "none")])
def test_person_names(spark, entered, printed, want):
    from drawbook.operators.names import match_people

    assert match_people(spark.createDataFrame([(entered, printed)], "entered string, printed string")).first().match == want
