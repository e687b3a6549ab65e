"""Conservation, order-independence, skew and the stream jobs."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from drawbook.operators import checks as C
from drawbook.operators import layout as L
from drawbook.operators import ledger as G
from drawbook.operators import reads as D
from drawbook.operators import reconcile as R
from drawbook.sources import stores
from drawbook.streaming import jobs


def obs_rows(n=400, hot=True, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        subject = 1 if hot and i % 3 == 0 else rng.randint(2, 20)
        blank = rng.random() < 0.05
        value = None if blank else float(rng.randint(1, 4))
        rows.append((subject, i // 7, i % 5, i, i * 3, f"T{rng.randint(0, 2)}", dt.date(2024, rng.randint(1, 12), 1), rng.choice(["current", "historical"]),
                     "not_performed" if blank else "final", value, "" if blank else str(int(value)), rng.choice(["H", None]), 1.0, 9.0, "1-9", rng.choice(["mg", "", None])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, stores.OBSERVATION_DDL)


def test_dedupe_matches_a_plain_loop(spark):
    rows = obs_rows()
    got = {(r.subject_id, r.test, r.day): (r.verdict, r.value, r.copies) for r in R.dedupe_sources(frame(spark, rows)).collect()}
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[5], r[6]), []).append(r)
    want = {}
    for key, items in groups.items():
        full = [r for r in items if r[7] == "current"]
        past = [r for r in items if r[7] != "current" and r[8] != "not_performed"]
        printed = [r for r in full if r[8] != "not_performed"]
        chosen = printed or full or past or [r for r in items if r[7] != "current"]
        kinds = {(r[8], r[9]) for r in chosen}
        verdict = ("conflict" if full else "excluded") if len(kinds) > 1 else "kept"
        if verdict == "kept" and full and any((r[8], r[9]) not in kinds for r in past):
            verdict = "historical_differs"
        want[key] = (verdict, chosen[0][9], len(items))
    assert got == want


def test_result_does_not_depend_on_order_or_partitions(spark):
    rows = obs_rows()
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    a = sorted(map(str, R.reconcile(R.accepted(R.dedupe_sources(frame(spark, rows)))).collect()))
    b = sorted(map(str, R.reconcile(R.accepted(R.dedupe_sources(frame(spark, shuffled).repartition(13)))).collect()))
    assert a == b


def test_every_row_is_accounted_for(spark):
    obs = frame(spark, obs_rows())
    issues = obs.filter("doc_id % 5 = 0").select(*obs.columns, F.lit("page").alias("scope"))
    out = C.apply_exclusions(obs, issues)
    assert out.count() == obs.count()
    assert out.filter("excluded_by = 'page'").count() > 0


def read_frame(spark, prints):
    rows = [(1, 1, n, "A", "S", text, None, "0-1", False, "in_range") for n, texts in enumerate(prints) for text in texts]
    return spark.createDataFrame(rows, "doc_id bigint, page bigint, read_no bigint, name string, section string, result_text string, flag string, "
                                       "reference string, illegible boolean, column_role string")


def agreed(spark, prints):
    pages = spark.createDataFrame([(1, 1, len(prints))], "doc_id bigint, page bigint, reads int")
    return D.agree(read_frame(spark, prints), pages).first()


def test_read_agreement(spark):
    assert agreed(spark, [["1"], ["1"], ["0"]]).result_text == "1"
    assert not agreed(spark, [["1"], ["0"]]).agreed
    assert not agreed(spark, [["1"], ["0"], ["2"]]).agreed
    assert not agreed(spark, [["1"], ["1"], ["0"], ["0"]]).agreed
    assert not agreed(spark, [["1", "1"], ["1"]]).agreed


def test_wrong_extra_read_never_changes_the_outcome(spark):
    for wrong in ("7", "8", "9"):
        assert agreed(spark, [["1"], ["1"], [wrong]]).result_text == "1"


def test_lines_follow_their_first_word(spark):
    """A slow drift of 2 points a word leaves the line once it is over 3 points from its first word."""
    words = [(1, 1, 10.0 * i, 2.0 * i, 10.0 * i + 5, 2.0 * i + 9, f"w{i}") for i in range(6)]
    df = spark.createDataFrame(words, "doc_id bigint, page bigint, x0 double, y0 double, x1 double, y1 double, text string")
    out = L.group_lines(L.page_arrays(df)).select("line_no", L.line_text().alias("t")).orderBy("line_no").collect()
    assert [r.t for r in out] == ["w0 w1", "w2 w3", "w4 w5"]


def test_baseline_is_immutable(spark, tmp_path):
    import pytest

    df = spark.range(3)
    stores.write_baseline(df, str(tmp_path / "base"))
    with pytest.raises(Exception):
        stores.write_baseline(df, str(tmp_path / "base"))


def test_expired_groups(spark):
    files = spark.createDataFrame([(1, 0.0), (1, 30000.0), (2, 100.0)], "group_id bigint, mtime double")
    assert [r.group_id for r in stores.expired_groups(files, now=31000.0).collect()] == [2]


def test_gap_of_exactly_the_limit_is_one_session(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base), (1, base + dt.timedelta(seconds=120)), (1, base + dt.timedelta(seconds=241))]
    df = spark.createDataFrame(rows, "key bigint, ts timestamp")
    assert sorted(r.events for r in jobs.sessions(df, 120).collect()) == [1, 2]


@pytest.fixture
def late_batches(spark, tmp_path):
    """Observations in three files, read one a batch."""
    rows = obs_rows(120)
    source = tmp_path / "in"
    for i in range(3):
        frame(spark, rows[i::3]).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(stores.OBSERVATION_DDL).option("maxFilesPerTrigger", 1).parquet(str(source))
    jobs.reconcile_stream(stream, str(tmp_path / "v"), str(tmp_path / "s")).awaitTermination()
    return rows, stream, tmp_path


def test_stream_reconciles_late_batches_like_one_batch(spark, late_batches):
    rows, stream, at = late_batches
    want = R.reconcile(R.accepted(R.dedupe_sources(frame(spark, rows))))
    got = lambda: sorted(map(str, jobs.current_results(spark, str(at / "v")).select(*want.columns).collect()))
    assert got() == sorted(map(str, want.collect()))
    # Compacted verdicts give the same; a run without new rows changes nothing.
    jobs.compact_verdicts(spark, str(at / "v"), str(at / "c"))
    assert sorted(map(str, jobs.current_results(spark, str(at / "c")).select(*want.columns).collect())) == got()
    jobs.reconcile_stream(stream, str(at / "v"), str(at / "s")).awaitTermination()
    assert got() == sorted(map(str, want.collect()))


def test_a_batch_touches_its_own_keys_only(spark, late_batches):
    _, _, at = late_batches
    keys = lambda df: {tuple(r) for r in df.select("subject_id", "test", "day").collect()}
    written = [spark.read.parquet(str(at / "v" / f"batch={k}")) for k in range(3)]
    sources = [keys(spark.read.parquet(str(f))) for f in sorted((at / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)]
    assert sorted(len(keys(w)) for w in written) == sorted(map(len, sources)) and {frozenset(keys(w)) for w in written} == {frozenset(s) for s in sources}


def test_open_sessions_come_out_when_the_stream_ends(spark, tmp_path):
    schema = "key long, ts timestamp"
    make = lambda rows: spark.createDataFrame([(k, dt.datetime(2024, 1, 1, 0, m)) for k, m in rows], schema)
    first, second = [(1, 0), (1, 1), (2, 3), (None, 4)], [(1, 2), (2, 30), (3, 30)]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ends = (str(tmp_path / "out"), str(tmp_path / "state"))
    out = lambda: sorted(map(str, spark.read.schema("key long, first_seen timestamp, last_seen timestamp, events long").parquet(ends[0]).collect()))
    for rows in (first, second):
        make(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.write_sessions(source, *ends, 120).awaitTermination()
    whole = sorted(map(str, jobs.sessions(make(first + second), 120).collect()))
    assert out() != whole
    jobs.close_sessions(source, *ends, 120).awaitTermination()
    assert out() == whole


def test_names_are_compared_without_the_lab_code(spark):
    schema = "doc_id long, page long, read_no long, name string, section string, result_text string, flag string, reference string, illegible boolean, column_role string, lab_code string"
    row = lambda read, name, code=None: (1, 1, read, name, "S", "5", None, "1-9", False, "in_range", code)
    rows = [row(0, "TESTOSTERONE, MS AMD", "AMD"), row(1, "TESTOSTERONE,  MS"), row(0, "ESTROGENS, TOTAL, IA", "IA"), row(1, "ESTROGENS, TOTAL, IA"), row(0, "IRON (AMD)"), row(1, " IRON"), row(0, "AMD"), row(1, "AMD")]
    pages = spark.createDataFrame([(1, 1, 2)], "doc_id long, page long, reads int")
    got = {r["name"]: r["agreed"] for r in D.agree(spark.createDataFrame(rows, schema), pages).collect()}
    assert got == {"TESTOSTERONE, MS": True, "ESTROGENS, TOTAL, IA": True, "IRON": True, "AMD": True}


def test_faults_of_a_read_are_named_by_their_path(spark):
    row = {"name": "T", "result_text": "5", "flag": None, "illegible": False, "column": "in_range", "reference_range": None, "lab_code": None, "page": 3, "section": None}
    page = {"page": 3, "specimen_id": None, "collected": None, "footer": None, "patient_name": None, "date_of_birth": None, "illegible": False, "rows": [row, row],
            "out_of_range_summary": None, "urine_note_printed": False}
    entry = {"name": None, "result_text": None, "flag": "L", "illegible": True}
    cases = [
        (page, None, None), ({**page, "out_of_range_summary": [entry]}, None, None), ({**page, "rows": []}, None, None), ("[1]", "type", "$"), ("{", "invalid_json", "$"), ("null", "type", "$"),
        ({**page, "more": 1}, "keys", "$"), ({k: v for k, v in page.items() if k != "footer"}, "keys", "$"), ({**page, "rows": None}, "type", "$.rows"), ({**page, "page": 3.5}, "type", "$.page"),
        ({**page, "page": True}, "type", "$.page"), ({**page, "illegible": None}, "type", "$.illegible"), ({**page, "footer": 5}, "type", "$.footer"),
        ({**page, "rows": [row, {**row, "flag": "HH"}]}, "enum", "$.rows[1].flag"), ({**page, "rows": [row, {**row, "extra": 1}]}, "keys", "$.rows[1]"),
        ({**page, "rows": [{**row, "column": 7}]}, "type", "$.rows[0].column"), ({**page, "rows": ["x"]}, "type", "$.rows[0]"), ({**page, "rows": [row, {**row, "page": 4}]}, "page_number", "$.rows[1].page"),
        ({**page, "page": 4}, "page_number", "$.page"), ({**page, "out_of_range_summary": [entry, {**entry, "illegible": None}]}, "type", "$.out_of_range_summary[1].illegible"),
        ({**page, "out_of_range_summary": {}}, "type", "$.out_of_range_summary")]
    raw = spark.createDataFrame([(1, 3, k, c if isinstance(c, str) else json.dumps(c)) for k, (c, _, _) in enumerate(cases)], "doc_id long, page long, read_no long, json string")
    out = D.ingest_reads(raw)
    assert {r["read_no"]: (r["reason"], r["path"]) for r in out.collect()} == {k: case[1:] for k, case in enumerate(cases)}
    assert D.read_rows(out).count() == 4 and D.read_summaries(out).count() == 1


def test_the_ledger_shows_what_is_missing(spark):
    rows = spark.createDataFrame([(1,), (1,), (1,), (2,)], "subject_id long")
    kept, lost = rows.limit(1), spark.createDataFrame([(1, "conflict"), (2, "page")], "subject_id long, cause string")
    entries = G.ledger(G.taken(rows, "days", "subject", "subject_id"), G.given(kept, "days", "subject", "subject_id", F.lit(None)), G.given(lost, "days", "subject", "subject_id", F.col("cause")))
    got = {r["unit_id"]: (r["rows_in"], r["kept"], r["left_out"], r["issues"], r["residue"]) for r in G.balance(entries).collect()}
    assert got == {1: (3, 1, 1, "conflict 1", 1), 2: (1, 0, 1, "page 1", 0)}
