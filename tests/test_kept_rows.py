"""Rows that must not vanish, and comparisons that must not be misled by spelling."""

import datetime as dt

from pyspark.sql import functions as F

from drawbook.operators import checks, compare, reads, reroute, scans


def test_exact_comparison_counts_repeats(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "row string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "row string")
    got = sorted((r["side"], r["row"]) for r in compare.compare_exact(a, b).collect())
    assert got == [("extra", "z"), ("missing", "x"), ("missing", "y")]


def test_undated_rows_stay(spark):
    day = dt.date(2024, 1, 15)
    schema = "subject_id long, test string, day date, disp string"
    undated = spark.createDataFrame([(1, "A", None, "5"), (1, "B", None, "6"), (2, "A", None, "<5"), (2, "B", None, "<5"), (2, "C", None, "<5")], schema)
    historical = spark.createDataFrame([(1, "A", day, "5"), (1, "B", day, "6"), (2, "A", day, "<5"), (2, "B", day, "<5"), (2, "C", day, "<5")], schema)
    votes = checks.date_undated(undated, historical, minimum=2)
    assert {r["subject_id"]: r["assigned_day"] for r in votes.collect()} == {1: day}
    rows = checks.redate(undated, historical, votes).groupBy("subject_id", "source").count().collect()
    assert {(r["subject_id"], r["source"]): r["count"] for r in rows} == {(1, "assigned"): 2, (2, "historical"): 3, (2, "undated"): 3}


def test_scans_of_subjects_without_a_draw_stay(spark):
    day = dt.date(2024, 3, 1)
    body = spark.createDataFrame([(1, 10, day, 180.0, 40.0, 130.0, 20.0), (2, 11, day, 180.0, 40.0, 130.0, 20.0)],
                                 "subject_id long, doc_id long, day date, total double, fat double, lean double, body_fat_pct double")
    draws = spark.createDataFrame([(1, day)], "subject_id long, latest_draw date")
    assert {r["subject_id"]: r["role"] for r in scans.pair_scans(body, draws).collect()} == {1: "current", 2: "unpaired"}


def test_summary_reads_glued_flags_and_folded_names(spark):
    schema = "doc_id long, read_no long, name string, result_text string, flag string"
    summary = spark.createDataFrame([(1, 0, "Total  Cholesterol", "210.0 H", None), (1, 0, "ALT", "", None)], schema)
    rows = spark.createDataFrame([(1, 0, "total cholesterol", "210.0", "H"), (1, 0, "ALT", "12", None)], schema)
    got = [(r["name"], r["verdict"]) for r in reads.summary_conflicts(summary, rows).collect()]
    assert got == [("Total  Cholesterol", "repeats")]


def test_coverage_folds_names(spark):
    rows = spark.createDataFrame([(1, "Free  T4"), (1, "Ferritin")], "subject_id long, name string")
    none = rows.limit(0)
    got = reroute.coverage_gaps(rows, spark.createDataFrame([(1, "free t4")], rows.schema), none, none)
    assert [r["name"] for r in got.collect()] == ["Ferritin"]


def test_rows_of_a_page_without_a_record_stay(spark):
    rows = spark.createDataFrame(
        [(1, 1, 0, "A", None, "5", None, None, False, None)],
        "doc_id long, page long, read_no long, name string, section string, result_text string, flag string, reference string, illegible boolean, column_role string")
    pages = spark.createDataFrame([(1, 2, 2)], "doc_id long, page long, reads int")
    got = reads.agree(rows, pages).select("name", "reads", F.coalesce("agreed", F.lit(False)).alias("agreed")).collect()
    assert [tuple(r) for r in got] == [("A", None, False)]
