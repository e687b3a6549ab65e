"""Printed tables: several value columns, refined headers, several tables a page, ruled bands, the second layout."""

import datetime
import inspect

import pytest

from drawbook.operators import tables as T

WORDS = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"
NAME, CURRENT, HIST1, HIST2, UNITS, RANGE = 40.0, 200.0, 300.0, 400.0, 480.0, 540.0


def words(lines, y=0.0):
    """Words of lines given as (x, text) pairs; a text of several words is set with normal gaps."""
    out = []
    for k, line in enumerate(lines):
        for x, said in line:
            for word in said.split(" "):
                out.append((float(x), y + 12.0 * k, x + 4.0 * len(word), y + 12.0 * k + 9.0, word))
                x += 4.0 * len(word) + 3
    return out


HEADER = [(NAME, "Test Name"), (CURRENT, "Current"), (HIST1, "Historical"), (HIST2, "Historical"), (UNITS, "Units"), (RANGE, "Reference Range")]
COLLECTED = [(NAME, "Collected: 04/14/2026")]
DATES = [(HIST1, "02/09/2025"), (HIST2, "/"), (HIST2 + 8, "/")]


class Noted(Exception):
    pass


@pytest.fixture(scope="module")
def read(spark):
    """Reads the pages of all tests at once: each test is first run up to its pages, then again with its own rows."""
    cases = []

    def note(*pages, rules=()):
        cases.append((pages, tuple(rules)))
        raise Noted

    for name, test in list(globals().items()):
        if name.startswith("test_") and "read" in inspect.signature(test).parameters:
            with pytest.raises(Noted):
                test(note)
    frame = spark.createDataFrame([(d, k, p) for d, (pages, _) in enumerate(cases) for k, p in enumerate(pages)], f"doc_id long, page long, words {WORDS}")
    marks = spark.createDataFrame([(d, *m[1:]) for d, (_, rules) in enumerate(cases) for m in rules], "doc_id long, page long, y double, x0 double, x1 double")
    rows = [r.asDict() for r in T.read_tables(frame, marks).orderBy("doc_id", "page", "line_no", "column_no").collect()]
    return lambda *pages, rules=(): [r for r in rows if r["doc_id"] == cases.index((pages, tuple(rules)))]


def brief(rows, *columns):
    return [tuple(r[c] for c in columns) for r in rows]


def test_current_and_historical_cells(read):
    rows = read(words([COLLECTED, HEADER, DATES,
                       [(NAME, "Ferritin"), (CURRENT, "88"), (CURRENT + 32, "H"), (HIST1, "5.1L"), (UNITS, "ng/mL"), (RANGE, "10-20")],
                       [(NAME, "Protein"), (CURRENT, "Not Detected"), (HIST1, "<2"), (HIST2, "7")]]))
    assert brief(rows, "name", "column_no", "column_kind", "status", "value", "disp", "flag", "reason") == [
        ("Ferritin", 0, "current", "final", 88.0, "88", "H", None), ("Ferritin", 1, "historical", "final", 5.1, "5.1", "L", None),
        ("Protein", 0, "current", "final", None, "Not Detected", None, None), ("Protein", 1, "historical", "final", None, "<2", None, None),
        ("Protein", 2, "historical", None, None, None, None, "no_date")]
    assert rows[0]["day"] == datetime.date(2026, 4, 14) and rows[1]["day"] == datetime.date(2025, 2, 9)
    assert (rows[0]["range_lo"], rows[0]["unit"], rows[1]["range_lo"], rows[1]["unit"]) == (10.0, "ng/mL", None, None)


def test_run_together_words(read):
    # "5.1H4.9" starts in Current and ends in the next column; digits on digits have no border.
    line = lambda name, cell, *more: [(NAME, name), (CURRENT, cell), *more]
    rows = read(words([COLLECTED, HEADER, DATES, line("A", "5.1H4.9"), line("B", "1.251.7"), line("C", "1.251.7", (HIST1, "3")), line("D", "pending")]))
    assert brief(rows, "name", "column_no", "value", "flag", "reason") == [
        ("A", 0, 5.1, "H", None), ("A", 1, 4.9, None, None),
        ("B", 0, None, None, "digits_run_together"), ("B", 1, None, None, "digits_run_together"), ("B", 2, None, None, "digits_run_together"),
        ("C", 0, None, None, "digits_run_together"), ("C", 1, 3.0, None, None), ("C", 2, None, None, "digits_run_together")]


def test_two_results_and_outside(read):
    rows = read(words([COLLECTED, HEADER, DATES, [(NAME, "A"), (CURRENT, "5"), (CURRENT + 20, "6")], [(NAME, "B"), (HIST1, "7"), (CURRENT + 60, "8")]]))
    assert brief(rows, "name", "column_no", "value", "status", "reason") == [
        ("A", 0, None, None, "more_than_one_result"), ("A", 1, None, "not_performed", None),
        ("B", 0, None, None, "outside_column"), ("B", 1, 7.0, "final", None)]


def test_phrases_match_whole_words_only(read):
    rows = read(words([COLLECTED, HEADER, DATES, [(NAME, "A"), (CURRENT, "None"), (RANGE, "d")], [(NAME, "B"), (CURRENT, "None"), (CURRENT + 21, "seen")],
                       [(NAME, "C"), (CURRENT, "Test Not Performed")]]))
    assert brief(rows, "name", "column_no", "status", "disp") == [("B", 0, "final", "None seen"), ("B", 1, "not_performed", None), ("C", 0, "not_performed", ""), ("C", 1, "not_performed", None)]


def test_dates_on_the_header_line(read):
    header = [(NAME, "Test Name"), (CURRENT, "Current"), (HIST1, "11/04/2025"), (HIST2, "07/08/2025"), (UNITS, "/"), (UNITS + 8, "/")]
    rows = read(words([COLLECTED, header, [(NAME, "A"), (CURRENT, "5"), (HIST1, "6"), (HIST2, "7")]]))
    assert brief(rows, "column_kind", "day", "value") == [
        ("current", datetime.date(2026, 4, 14), 5.0), ("historical", datetime.date(2025, 11, 4), 6.0), ("historical", datetime.date(2025, 7, 8), 7.0)]


def test_slots_split_one_historical_label(read):
    header = [(NAME, "Test Name"), (CURRENT, "Current"), (HIST1, "Historical"), (RANGE, "Reference Range")]
    rows = read(words([COLLECTED, header, [(HIST1 - 40, "01/02/2025"), (HIST1 + 40, "03/04/2024")], [(NAME, "A"), (CURRENT, "5"), (HIST1 - 30, "6"), (HIST1 + 50, "7")]]))
    assert brief(rows, "column_kind", "day", "value") == [
        ("current", datetime.date(2026, 4, 14), 5.0), ("historical", datetime.date(2025, 1, 2), 6.0), ("historical", datetime.date(2024, 3, 4), 7.0)]


def test_in_and_out_of_range_are_one_column(read):
    header = [(NAME, "Test Name"), (CURRENT, "In Range"), (HIST1, "Out Of Range"), (RANGE, "Reference Range")]
    rows = read(words([COLLECTED, header, [(NAME, "A"), (CURRENT, "5")], [(NAME, "B"), (HIST1, "6 H")], [(NAME, "C"), (CURRENT, "5"), (HIST1, "6")]]))
    assert brief(rows, "name", "column_no", "column_kind", "value", "flag", "reason") == [
        ("A", 0, "current", 5.0, None, None), ("B", 0, "current", 6.0, "H", None), ("C", 0, "current", None, None, "more_than_one_result")]


def test_risk_tiers_are_the_range(read):
    header = [(NAME, "Test Name"), (CURRENT, "Current")]
    tiers = [(300, "Optimal"), (360, "Moderate"), (420, "High"), (UNITS, "Units")]
    rows = read(words([COLLECTED, header, tiers, [(NAME, "A"), (CURRENT, "5"), (300, "<10"), (360, "10-20"), (420, ">20"), (UNITS, "mg/L")]]))
    assert brief(rows, "name", "value", "range_text", "unit") == [("A", 5.0, "Optimal <10; Moderate 10-20; High >20", "mg/L")]


def test_two_tables_with_other_column_order(read):
    second = [(NAME, "Test Name"), (CURRENT, "Historical"), (CURRENT + 45, "03/04/2024"), (HIST2, "Current"), (RANGE, "Reference Range")]
    rows = read(words([COLLECTED, HEADER, DATES, [(NAME, "A"), (CURRENT, "5")], [(NAME, "Lipid Panel Report")], second, [(NAME, "B"), (CURRENT, "6"), (HIST2, "7")]]))
    assert brief(rows, "name", "header_line", "column_kind", "value", "day") == [
        ("A", 1, "current", 5.0, datetime.date(2026, 4, 14)), ("A", 1, "historical", None, datetime.date(2025, 2, 9)),
        ("B", 5, "historical", 6.0, datetime.date(2024, 3, 4)), ("B", 5, "current", 7.0, datetime.date(2026, 4, 14))]


def test_headings_and_sections_carry_over_pages(read):
    first = words([[(NAME, "Order ID: A1")], COLLECTED, HEADER, DATES, [(NAME, "LIPID PANEL")], [(NAME, "A"), (CURRENT, "5")]])
    second = words([HEADER, [(NAME, "B"), (CURRENT, "6")], [(NAME, "Order ID: A2")], [(NAME, "Collected: 05/01/2026")], HEADER, [(NAME, "C"), (CURRENT, "7")]])
    third = words([[(NAME, "Order ID: A1")], HEADER, [(NAME, "D"), (CURRENT, "8")]])
    rows = [r for r in read(first, second, third) if r["column_kind"] == "current"]
    assert brief(rows, "name", "order_id", "heading", "day") == [
        ("A", "A1", "LIPID PANEL", datetime.date(2026, 4, 14)), ("B", "A1", "LIPID PANEL", datetime.date(2026, 4, 14)),
        ("C", "A2", None, datetime.date(2026, 5, 1)), ("D", "A1", "LIPID PANEL", datetime.date(2026, 4, 14))]


def test_trend_tables_are_not_read(read):
    inline = [(NAME, "Test Name"), (CURRENT, "Current"), (HIST1, "11/04/2025")]
    rows = read(words([COLLECTED, HEADER, DATES, [(NAME, "A"), (CURRENT, "5")], [(NAME, "Progress Summary")], inline, [(NAME, "A"), (CURRENT, "4")]]),
                words([inline, [(NAME, "A"), (CURRENT, "3")]]), words([HEADER, [(NAME, "B"), (CURRENT, "6")]]))
    assert brief([r for r in rows if r["column_kind"] != "historical"], "page", "name", "value", "reason") == [(0, "A", 5.0, None), (1, None, None, "restated_page"), (2, "B", 6.0, None)]


def test_pages_without_a_header_are_listed(read):
    rows = read(words([COLLECTED, [(NAME, "Ferritin"), (CURRENT, "88")]]))
    assert brief(rows, "name", "reason", "value") == [(None, "page_without_header", None)]


def test_ambiguous_header_dates_exclude_the_table(read):
    rows = read(words([COLLECTED, HEADER, [(CURRENT, "02/09/2025")], [(NAME, "A"), (CURRENT, "5")]]))
    assert {r["reason"] for r in rows} == {"date_under_no_historical_column"}


def test_ruled_bands_are_rows(read):
    lines = [COLLECTED, HEADER, DATES, [(NAME, "Thyroid"), (CURRENT, "5"), (HIST1, "6")], [(NAME, "Antibody")], [(NAME, "B"), (CURRENT, "see"), (HIST1, "7")], [(CURRENT, "note")], [(NAME, "C"), (CURRENT, "9")]]
    rules = [(1, 0, y, NAME, x) for y in (34.0, 58.0, 82.0) for x in (150.0, 600.0)]
    rows = [r for r in read(words(lines), rules=rules)]
    assert brief(rows, "name", "column_no", "disp", "status", "reason") == [
        ("Thyroid Antibody", 0, "5", "final", None), ("Thyroid Antibody", 1, "6", "final", None), ("B", 0, "see note", "see note", None), ("B", 1, "7", "final", None),
        ("C", None, None, None, "outside_bands")]


def test_prose_is_no_result(read):
    rows = read(words([COLLECTED, HEADER, DATES, [(NAME, "For people with diabetes a value of 7 is common here and there")], [(NAME, "A"), (CURRENT, "5")]]))
    assert {r["name"] for r in rows} == {"A"}


def test_accession_layout(read):
    top = [[(NAME, "Acc# X1"), (CURRENT, "Coll. Date: 03/05/26"), (HIST2, "Report Status: FINAL")]]
    header = [(NAME, "Test Name"), (CURRENT, "Results"), (HIST1, "Reference Range"), (HIST2, "Units")]
    body = [[(NAME, "GENERAL CHEMISTRY")], [(NAME, "Glucose"), (CURRENT, "109 H"), (HIST1, "83 - 102"), (HIST2, "mg/dL")], [(NAME + 12, "note 5"), (CURRENT, "7")],
            [(NAME, "Bilirubin"), (CURRENT, "Negative"), (HIST1, "Negative")], [(NAME, "Iron"), (CURRENT, "see below")]]
    rows = read(words([*top, header, *body]), words([*top, header, [(NAME, "Zinc"), (CURRENT, "3+")], [(NAME, "OUT OF RANGE SUMMARY")], [(NAME, "Glucose"), (CURRENT, "109 H")]]),
                words([[(NAME, "Acc# X1")], header, [(NAME, "Copper"), (CURRENT, "3")]]))
    assert brief(rows, "page", "heading", "name", "disp", "value", "flag", "day", "range_text", "unit", "reason") == [
        (0, "GENERAL CHEMISTRY", "Glucose", "109", 109.0, "H", datetime.date(2026, 3, 5), "83 - 102", "mg/dL", None),
        (0, "GENERAL CHEMISTRY", "Bilirubin", "Negative", None, None, datetime.date(2026, 3, 5), "Negative", "", None),
        (0, "GENERAL CHEMISTRY", "Iron", None, None, None, None, None, None, "not_a_result"),
        (1, "GENERAL CHEMISTRY", "Zinc", "3+", None, None, datetime.date(2026, 3, 5), None, "", None),
        (2, "GENERAL CHEMISTRY", None, None, None, None, None, None, None, "page_without_collection_date")]


def test_every_line_has_a_role(spark):
    frame = spark.createDataFrame([(1, 0, words([[(NAME, "Hello")], COLLECTED, HEADER, DATES, [(NAME, "A"), (CURRENT, "5")], [(NAME, "Test"), (CURRENT, "Current")]]))],
                                  f"doc_id long, page long, words {WORDS}")
    assert [r["role"] for r in T.line_roles(frame).orderBy("no").collect()] == ["outside", "section", "header", "refining", "row", "header"]


def test_empty_input(spark):
    assert T.read_tables(spark.createDataFrame([], f"doc_id long, page long, words {WORDS}")).count() == 0
