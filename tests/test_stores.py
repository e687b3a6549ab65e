"""The loaders and sinks: what is written is read back, and feeds the operators."""

import datetime as dt
import json

import pytest

from drawbook.operators import checks as C
from drawbook.operators import markers as M
from drawbook.operators import reconcile as R
from drawbook.operators import reroute as X
from drawbook.sources import stores

OBSERVATIONS = [
    (1, 10, 1, 100, 1, "Ferritin", dt.date(2024, 1, 1), "current", "final", 8.0, "8", None, 10.0, 30.0, "10-30", "ng/mL"),
    (1, 11, 1, 110, 1, "Ferritin", dt.date(2024, 5, 1), "current", "final", 20.0, "20", None, 10.0, 30.0, "10-30", "ng/mL"),
    (1, 11, 2, 111, 1, "Nitrite", dt.date(2024, 5, 1), "current", "final", None, "Negative", None, None, None, None, None),
    (2, 12, 1, 120, 1, "Ferritin", dt.date(2024, 5, 1), "current", "final", 5.0, "5", None, None, None, None, None),
    (2, 12, 1, 121, 2, "Ferritin", dt.date(2024, 5, 1), "current", "final", 6.0, "6", None, None, None, None, None),
]
LIBRARY = [
    {"name": "Ferritin", "category": "Foundational", "kind": "range", "unit": "ng/mL", "default_sex": "male", "aliases": ["Ferritin, Serum"], "low_ok_on_trt": False,
     "ranges": [{"sex": "male", "lo": 15.0, "hi": 30.0}, {"sex": "female", "lo": 12.0, "hi": 28.0}]},
    {"name": "Nitrite", "category": "Metabolic", "kind": "categorical", "default_sex": "male", "low_ok_on_trt": False},
]


@pytest.fixture
def stored(spark, tmp_path):
    spark.createDataFrame(OBSERVATIONS, stores.OBSERVATION_DDL).write.parquet(str(tmp_path / "observations"))
    (tmp_path / "library.json").write_text("\n".join(map(json.dumps, LIBRARY)))
    return tmp_path


def test_stored_results_are_scored_with_a_stored_library(spark, stored):
    observations = stores.load_observations(spark, str(stored / "observations"))
    rules, aliases, ranges = stores.load_library(spark, str(stored / "library.json"))
    assert sorted((r["canonical"], r["alias"]) for r in aliases.collect()) == [("Ferritin", "Ferritin"), ("Ferritin", "Ferritin, Serum"), ("Nitrite", "Nitrite")]
    people = spark.createDataFrame([(1, "M", False, False), (2, "F", False, False)], "subject_id long, sex string, on_trt boolean, bhrt boolean")
    overlays = spark.createDataFrame([], "test string, o_lo double, o_hi double")
    results = R.reconcile(R.accepted(R.dedupe_sources(observations)), unique=True)
    marks = M.score_markers(M.apply_fallbacks(M.resolve_thresholds(results, people, rules, ranges, overlays)))
    got = {(r["subject_id"], r["test"]): (r["then_pct"], r["then_tier"], r["now_pct"], r["now_tier"]) for r in marks.collect()}
    assert got[1, "Nitrite"] == (None, None, 96, "optimal") and got[1, "Ferritin"][2:] == (96, "optimal") and got[1, "Ferritin"][1] != "optimal"
    assert (2, "Ferritin") not in got


def test_issues_are_appended_and_facts_lie_by_kind(spark, stored):
    days = R.dedupe_sources(stores.load_observations(spark, str(stored / "observations")))
    conflicts = C.issue_rows(days.filter("verdict = 'conflict'"), "conflicting_results", "excluded", days["test"], days["day"])
    for _ in range(2):
        stores.write_issues(conflicts, str(stored / "issues"))
    issues = spark.read.parquet(str(stored / "issues"))
    assert [(r["subject_id"], r["rule"], r["subject_key"], r["detail"]) for r in issues.collect()] == [(2, "conflicting_results", "Ferritin", "2024-05-01")] * 2
    facts = spark.createDataFrame([(1, "M", "b"), (1, "M", "a"), (2, "S", "c")], "subject_id long, kind string, row string")
    for _ in range(2):
        stores.write_fact_rows(facts, str(stored / "facts"))
    assert sorted(p.name for p in (stored / "facts").glob("kind=*")) == ["kind=M", "kind=S"]
    assert sorted(tuple(r) for r in spark.read.parquet(str(stored / "facts")).select("subject_id", "kind", "row").collect()) == sorted(map(tuple, facts.collect()))


def test_a_flag_on_any_cell_of_a_printed_row_counts(spark):
    schema = "subject_id long, doc_id long, ord long, row_no long, day date, column_kind string, status string, value double, disp string, flag string, range_display string, unit string, raw_name string, section string"
    cell = lambda row, kind, flag, unit: (1, 1, row, row, dt.date(2024, 1, 1), kind, "final", 5.0, "5", flag, None, unit, f"X{row}", "Chemistry")
    rows = spark.createDataFrame([cell(1, "current", None, None), cell(1, "historical", "H", None), cell(2, "current", None, "mg"), cell(2, "historical", None, None), cell(3, "current", None, "")], schema)
    dim = spark.createDataFrame([], "alias string, canonical string, grp string")
    got = sorted((r["raw_name"], r["column_kind"], r["shown_name"], r["shown_group"]) for r in X.match_reported(rows, dim).collect())
    assert got == [("X1", "current", "X1", "Other Lab-Flagged Results"), ("X1", "historical", "X1", "Other Lab-Flagged Results"),
                   ("X2", "current", "X2", "Chemistry"), ("X2", "historical", "X2", "Chemistry"), ("X3", "current", None, None)]
