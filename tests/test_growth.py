"""Work that must not grow faster than the input: steps that once repeated themselves per row, page or pair."""

from pyspark.sql import functions as F

import __spark_entry__ as contract
from drawbook.functions import cells, dates
from drawbook.operators import attention, checks, compare, layout, reads, reconcile, reroute, scans, tables
from drawbook.plans.catalog import evidence
from drawbook.plans.catalog import layout as positioned
from drawbook.plans.catalog import printed

PAGE_DDL = "doc_id long, page long, words array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_attach_dates_finds_the_headings_of_odd_documents(spark):
    rows = contract.queries()["attach_dates"](spark, contract.SMOKE_FOLDER).collect()
    odd = [r for r in rows if r["doc_id"] % 2]
    assert {r["label"] for r in odd} == {"Urinalysis Section"}
    assert any(r["label_lines"] > 0 and r["dates"] > 0 for r in odd)


def test_texts_are_split_once_per_document(spark):
    for pages in (printed.printed_pages, positioned.pages):
        plan = optimized(pages(spark, contract.SMOKE_FOLDER))
        assert plan.count("split(text") == 1, plan
        assert "RepartitionByExpression [doc_id" in plan and pages(spark, contract.SMOKE_FOLDER).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_lines_are_stretches_of_the_sorted_words(spark):
    words = [(60.0, 24.5, 80.0, 33.5, "d"), (40.0, 0.0, 60.0, 9.0, "a"), (70.0, 3.0, 90.0, 12.0, "b"), (40.0, 24.0, 55.0, 33.0, "c"), (None, None, None, None, "lost")]
    df = layout.page_lines(spark.createDataFrame([(1, 0, words), (2, 0, [])], PAGE_DDL))
    got = {r["doc_id"]: [[w["text"] for w in line["words"]] for line in r["lines"]] for r in df.collect()}
    assert got == {1: [[], ["a", "b"], ["c", "d"]], 2: [[]]}
    assert "slice(placed" in optimized(df)


def test_claims_split_no_line_of_their_page(spark):
    pages = spark.createDataFrame([(1, 0, ["T1 total 5 H", "T1 total 7", "T2 total <  5L", None])], "doc_id long, page long, lines array<string>")
    claims = [("T1 total", "5", "H"), ("T1  Total", "5", None), ("T1 total", "7", None), ("T1 total", "7", "L"), ("T2 total", "<  5", "L"), ("T2 total", "", None), ("T1 total", None, None), ("T3", "5", None)]
    rows = spark.createDataFrame([(1, 0, *c) for c in claims] + [(9, 0, "T1 total", "5", "H")], "doc_id long, page long, name string, disp string, flag string")
    df = layout.verify_on_page(rows, pages)
    got = {(r["doc_id"], r["name"], r["disp"], r["flag"]): r["verified"] for r in df.collect()}
    assert [got[(1, *c)] for c in claims] == [True, False, True, False, True, True, False, False] and not got[(9, "T1 total", "5", "H")]
    top = optimized(df).split("Join")[0]
    assert "split(" not in top and "regexp_replace(" not in top, top


def test_wanted_rows_meet_candidates_by_key_and_once(spark):
    want = [(1, "M | a | 5 *"), (1, "M | a | 6 *"), (1, "M | *"), (1, "M | b | *"), (1, "M | c | 7"), (2, "M | a | 5 *"), (2, "M | a | 5 *"), (None, "M | a | *")]
    expected = spark.createDataFrame(want, "subject_id long, row string")
    actual = spark.createDataFrame([(1, "M | a | 5 1"), (1, "M | a | 5 1"), (1, "M | c | 70"), (2, "M | a | 4"), (1, None)], "subject_id long, row string")
    df = compare.compare_subset(expected, actual)
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, "M | a | 6 *"), (1, "M | *"), (1, "M | b | *"), (1, "M | c | 7"), (2, "M | a | 5 *"), (None, "M | a | *")], key=str)
    plan = optimized(df)
    assert "rightHint=(strategy=broadcast)" in plan, plan
    assert plan.count("Join") == 2, plan


def test_only_codes_that_a_name_holds_are_tried(spark):
    rows = spark.createDataFrame([(1, 0, "a AMD", "AMD"), (1, 0, "b ( Z9 )", "Z9"), (1, 0, "c, AMD", None), (1, 0, " d ", None), (1, 0, None, None), (2, 0, "a AMD", None)],
                                 "doc_id long, page long, name string, lab_code string")
    df = reads.with_identity(rows)
    assert sorted(map(str, (r["name"] for r in df.collect()))) == ["None", "a", "a AMD", "b", "c, AMD", "d"]
    plan = optimized(df)
    assert "filter(codes" in plan and "Contains(name" in plan, plan


def test_reads_of_a_scan_page_move_once_and_prints_are_parsed_once(spark):
    reads = [(1, 1, "2024-01-01", "fat", 0, "30 lb (e)"), (1, 1, "2024-01-01", "fat", 1, "31"), (1, 1, "2024-01-01", "lean", 0, "n/a"), (1, 1, "2024-01-01", "lean", 1, "5 %"),
             (1, 2, "2024-01-01", "fat", 0, "30"), (1, 2, "2024-01-01", "fat", 0, "32"), (1, 2, "2024-01-01", "total", 1, None), (2, 1, "2024-01-01", "fat", 0, "7"), (None, 1, "2024-01-01", "fat", 0, "7")]
    reads = spark.createDataFrame(reads, "doc_id long, page long, day string, field string, read_no long, text string")
    numbers = spark.createDataFrame([(1, 1, "31"), (1, 1, "31"), (1, 1, None), (None, 1, "7")], "doc_id long, page long, number string")
    df = scans.agree_fields(reads, numbers)
    got = {(r["doc_id"], r["page"], r["field"]): (r["outcome"], r["value"], r["text"], r["estimated"]) for r in df.collect()}
    assert got == {(1, 1, "fat"): ("text_layer", 31.0, "31", False), (1, 1, "lean"): ("unreadable", None, None, None), (1, 2, "fat"): ("ambiguous", None, None, None),
                   (1, 2, "total"): ("absent", None, None, None), (2, 1, "fat"): ("day_in_one_read", None, None, None)}
    plan = optimized(df)
    assert plan.count("Join") == 1 and plan.count("regexp_extract(") == 1, plan


def test_a_scan_is_settled_from_lists_made_once(spark):
    fields = [(1, 1, "fat", "agreed", 30.0, "30", False, 30.0, 30.0, "30", "30"), (1, 2, "fat", "agreed", 30.0, "30.0", True, 30.0, 30.0, "30.0", "30.0"), (1, 1, "lean", "differ", None, None, None, 5.0, 6.0, "5", "6"),
              (1, 2, "lean", "one_read", None, None, None, None, 6.0, None, "6.0"), (1, 1, "total", "absent", None, None, None, None, None, None, None), (1, 1, "other", "agreed", 1.0, "1", False, 1.0, 1.0, "1", "1"),
              (2, 1, "body_fat", "unreadable", None, None, None, None, None, None, None)]
    fields = spark.createDataFrame(fields, "doc_id long, page long, field string, outcome string, value double, text string, estimated boolean, a_value double, b_value double, a_text string, b_text string")
    df = scans.settle_fields(fields.withColumn("day", F.lit("2024-01-01")))
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in df.collect()) == [
        (1, "fat", 30.0, "30", True, "agreed"), (1, "lean", 6.0, "6", False, "cross_page"), (2, "body_fat", None, None, None, "withheld")]
    assert "filter(items" not in optimized(df)
    plan = contract.queries()["settle_scan_fields"](spark, contract.SMOKE_FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(doc_id" in line and "day" in line for line in plan.splitlines()) == 0, plan


def test_next_steps_read_the_scores_once(spark):
    rows = [(1, "T2", "Lipids", 5.0, "5", "flag", None, None, None, None, "2024-02-01", None), (1, "T10", "Lipids", 5.0, "5", "optimal", None, None, None, None, "2024-02-01", None),
            (1, "T3", "Lipids", None, None, None, 1.0, "1", "flag", None, None, "2024-01-01"), (2, "T1", "Lipids", 5.0, "5", "optimal", None, None, None, None, "2024-02-01", None)]
    scored = spark.createDataFrame(rows, "subject_id long, test string, category string, now_value double, now_disp string, now_tier string, then_value double, then_disp string, then_tier string, "
                                         "then_pct double, now_day string, then_day string").withColumn("now_pct", F.lit(1.0))
    scored = scored.withColumns({"now_day": F.to_date("now_day"), "then_day": F.to_date("then_day")})
    df = attention.next_steps(scored)
    assert sorted(map(tuple, df.collect())) == [(1, "T3", "last result 01/01/2024", "repeat", "2 open"), (2, "none open", "no open test", "keep", "all optimal")]
    assert "Join" not in optimized(df) and "Window" not in optimized(df)


def test_only_tests_of_the_fasting_list_are_read_again(spark):
    plan = optimized(contract.queries()["narrative_columns"](spark, contract.SMOKE_FOLDER))
    scans_of_items = [line for line in plan.splitlines() if "Filter" in line and "l_partkey" in line and "IN (T4,T5)" in line]
    assert scans_of_items, plan


def test_items_are_narrowed_before_they_meet_their_orders(spark):
    plan = optimized(contract.queries()["dedupe_sources"](spark, contract.SMOKE_FOLDER))
    below = plan[plan.index("Join"):]
    assert "AS maker" in below and "AS top" in below and "AS limit" in below, plan


def test_customers_are_spread_before_their_notes_are_made(spark):
    notes = evidence.notes(spark, contract.SMOKE_FOLDER)
    assert notes.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = optimized(notes)
    assert "array_join" not in plan[plan.index("RepartitionByExpression"):], plan


def test_strict_gates_read_their_pages_once(spark):
    plan = optimized(contract.queries()["strict_page_gate"](spark, contract.SMOKE_FOLDER))
    assert plan.count("Relation [") == 3, plan  # page reads, expected names, rows


def test_specimens_come_from_the_next_page_only(spark):
    rows = [(1, 1, "A", "A PAGE 1 OF 4", 1, None), (1, 2, None, "PAGE 2 OF 4", 2, None), (1, 4, "B", "B PAGE 4 OF 4", 4, None), (1, 3, None, "PAGE 3 OF 4", 3, "illegible"),
            (1, 6, None, "PAGE 5 OF 4", 5, None), (2, 5, None, "PAGE 5 OF 4", 5, None), (None, 1, "C", "C PAGE 1 OF 4", 1, None), (None, 2, None, "PAGE 2 OF 4", 2, None)]
    pages = spark.createDataFrame([(*r[:5], 4, r[5]) for r in rows], "doc_id long, page long, specimen string, footer string, seq int, seq_of int, reason string")
    got = {(r["doc_id"], r["page"]): r["taken"] for r in reads.neighbour_specimen(pages).collect()}
    assert {k: v for k, v in got.items() if v} == {(1, 2): "A"}


def test_gated_rows_read_their_votes_once(spark):
    plan = optimized(contract.queries()["page_outcomes"](spark, contract.SMOKE_FOLDER))
    assert plan.count("Relation [") == 4, plan  # rows, pages of the vote, summaries, pages of the verdict


def test_summaries_contradict_by_their_own_read(spark):
    def vote(name, text, flag, readers, agreed=True):
        return (1, 1, name, None, 3, 3, False, 1, True, 2, agreed, False, text, flag, "0-1", None, False, readers)

    ddl = ("doc_id long, page long, name string, section string, reads int, present long, heading boolean, valued long, plurality boolean, votes long, agreed boolean, "
           "missing_or_duplicate boolean, result_text string, flag string, reference string, column_role string, unclear boolean, readers array<long>")
    votes = spark.createDataFrame([
        vote("a", "5", "H", [0, 1]), vote("b", "5", "H", [0, 1]), vote("c", "5", "H", [0, 1]), vote("d", "5", "H", [0, 1]), vote("e", "1", None, [0]), vote(None, "5", "H", [0])], ddl)
    said = [("a", 0, "5", "H"), ("a", 1, "6", "H"), ("b", 0, "6", "H"), ("b", 0, "5", "H"), ("b", 2, "7", "H"), ("c", 0, "5H", None), ("D ", 1, "5", "L"), ("e", 0, "1", "H"), (None, 0, "6", "H")]
    summary = spark.createDataFrame([(1, r, n, t, f) for n, r, t, f in said], "doc_id long, read_no long, name string, result_text string, flag string")
    got = {r["name"]: r["reason"] for r in reads.gate_rows(votes, summary).collect()}
    assert got == {"a": "summary", "b": None, "c": None, "d": "summary", "e": "summary", None: None}


def exchanges(df):
    return [line.split("Exchange ", 1)[1] for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_reported_rows_are_dealt_as_they_are_and_meet_no_library_by_key(spark):
    for name in ("lab_reported_build", "also_on_file"):
        df = contract.queries()[name](spark, contract.SMOKE_FOLDER)
        assert not any(x.startswith(("hashpartitioning(k#", "hashpartitioning(lower(")) for x in exchanges(df) if "urine" in x), exchanges(df)
        assert sum("item#" in x for x in exchanges(df)) == 1, exchanges(df)
    assert optimized(df).count("row_number()") == 1


def test_days_on_file_are_placed_in_one_order(spark):
    rows = [(1, "a", "2024-01-01", "kept", "1-2"), (1, "a", "2024-02-01", "kept", None), (1, "a", "2024-03-01", "conflict", "1-2"), (1, "a", "2024-04-01", "historical_differs", "1-3"),
            (1, "b", "2024-01-01", "kept", None), (2, "a", "2024-05-01", "conflict", None), (None, "a", "2024-01-01", "kept", "1-2"), (None, "a", "2024-01-02", "kept", "1-2")]
    reported = spark.createDataFrame([(*r, "5", None) for r in rows], "subject_id long, item string, day string, verdict string, range_display string, disp string, flag string")
    got = sorted(((r["subject_id"] or 0, r["item"], r["day"][5:7] + r["day"][8:], r["place"], r["own_range"]) for r in reroute.also_on_file(reported).collect()))
    assert got == [(0, "a", "0101", "earliest", False), (0, "a", "0102", "latest", False), (1, "a", "0101", "earliest", True), (1, "a", "0201", "also_on_file", True),
                   (1, "a", "0401", "latest", True), (1, "b", "0101", "latest", False)]


def test_subjects_are_checked_from_one_reading_of_their_days(spark):
    df = contract.queries()["subject_check"](spark, contract.SMOKE_FOLDER)
    plan = optimized(df)
    assert plan.count("l_shipdate") and sum("Relation [" in line and "l_shipdate" in line for line in plan.splitlines()) == 2, plan  # the days, and the names that no test has


def test_counts_stay_where_no_result_is_accepted(spark):
    rows = [(1, "T1", "2024-01-01", "kept", 2, 5.0), (1, "T1", "2024-02-01", "conflict", 3, 6.0), (1, "T2", "2024-03-01", "conflict", 2, 6.0), (2, "T1", "2024-01-01", "excluded", 4, 1.0)]
    days = spark.createDataFrame([(*r, 1, 1, "5", None, None, None, None, None) for r in rows],
                                 "subject_id long, test string, day string, verdict string, copies long, value double, ord long, row_no long, disp string, flag string, range_lo double, range_hi double, "
                                 "range_display string, unit string").withColumn("day", F.to_date("day"))
    got = {(r["subject_id"], r["test"]): r for r in reconcile.reconcile_counted(days).collect()}
    assert {k: tuple(r[c] for c in ("results", *reconcile.DAY_COUNTS)) for k, r in got.items()} == {(1, "T1"): (1, 5, 1, 1, 0), (1, "T2"): (0, 2, 0, 1, 0), (2, "T1"): (0, 4, 0, 0, 1)}
    plain = {(r["subject_id"], r["test"]): r.asDict() for r in reconcile.reconcile(reconcile.accepted(days), unique=True).collect()}
    assert {k: {c: r[c] for c in plain[k]} for k, r in got.items() if r["results"]} == plain
    marks = reconcile.reconcile_counted(days).withColumns({"now_tier": F.lit("optimal"), "unscored_reason": F.lit("missing_threshold")})
    checked = checks.subject_check(marks, spark.createDataFrame([(2,), (2,)], "subject_id long"))
    assert {r["subject_id"]: tuple(r)[1:] for r in checked.collect()} == {1: (7, 1, 2, 0, 1, 1, 0), 2: (4, 0, 0, 1, 0, 0, 2)}


def test_facts_read_the_scores_once(spark):
    plan = optimized(contract.queries()["fact_rows"](spark, contract.SMOKE_FOLDER))
    assert sum("Relation [" in line and "l_shipdate" in line for line in plan.splitlines()) == 2, plan  # the scores, and the reported list


def test_facts_of_a_page_are_made_once(spark):
    df = contract.queries()["line_roles"](spark, contract.SMOKE_FOLDER)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("aggregate(placed") == 1, plan


def test_keys_of_pages_need_no_words(spark):
    keys, pages = printed.page_keys(spark, contract.SMOKE_FOLDER), printed.printed_pages(spark, contract.SMOKE_FOLDER)
    assert "regexp_replace" not in optimized(keys)
    assert sorted(map(tuple, keys.collect())) == sorted(map(tuple, pages.select("doc_id", "page").collect()))


def test_pieces_and_forms_of_dates_are_looked_for_once(spark):
    said = spark.range(2).select(F.col("id").cast("string").alias("t"))
    assert optimized(said.select(cells.split_cell(F.col("t")).alias("x"))).count("regexp_extract_all(") == 1
    assert optimized(said.select(dates.date_key(F.col("t")).alias("x"))).count("regexp_extract(") == 9


def test_headings_are_found_before_cells_become_rows(spark):
    df = tables.read_tables(spark.createDataFrame([], PAGE_DDL))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("inline(one") < plan.index("Window [last(own_title"), plan


def test_the_ledger_makes_votes_once_and_deals_results_once(spark):
    df = contract.queries()["conservation_ledger"](spark, contract.SMOKE_FOLDER)
    assert optimized(df).count("Window [collect_set(") == 1
    rows = df.collect()
    assert any("heading" in r["issues"] for r in rows) and not any(r["residue"] for r in rows)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert sum("ReusedExchange [subject_id" in line and "held" in line for line in plan.splitlines()) >= 2, plan
