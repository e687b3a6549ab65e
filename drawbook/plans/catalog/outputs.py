"""Queries over fact rows, comparisons, retention and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawbook.operators import compare as P
from drawbook.operators import markers as M
from drawbook.plans.catalog.reroute import reported
from drawbook.plans.catalog.scans import scans
from drawbook.plans.catalog.scores import answers, overall_sql, scored
from drawbook.plans.registry import cte, query
from drawbook.sources import bindings as B
from drawbook.session import new_path
from drawbook.sources import stores
from drawbook.sources.tables import table
from drawbook.streaming import jobs

_US = "strftime({0}, '%m/%d/%Y')"


def _state(tier):
    return f"CASE WHEN {tier} IN ('optimal', 'moderate', 'flag') THEN {tier} ELSE 'not scored' END"


def _point(side):
    return f"""SELECT subject_id, 'M' AS kind, 'M | ' || test || ' | ' || {_US.format(side + '_day')} || ' | ' || {side}_disp || ' | ' || coalesce({side}_flag, '') || ' | ' || {_state(side + '_tier')} AS "row"
FROM scored WHERE {side}_day IS NOT NULL AND coalesce({side}_disp, '') <> ''"""


cte("overall_rows", overall_sql("system_scores", None), ("system_scores", "symptoms"))
cte("facts", f"""
{_point('then')} UNION ALL {_point('now')}
UNION ALL SELECT subject_id, 'L', 'L | ' || shown_group || ' | ' || shown_name || ' | ' || {_US.format('day')} || ' | ' || disp || ' | ' || coalesce(flag, '') || ' | ' || coalesce(range_display, '') FROM reported WHERE verdict <> 'conflict'
UNION ALL SELECT subject_id, 'D', 'D | ' || {_US.format('day')} || ' | total ' || coalesce(CAST(CAST(total AS INTEGER) AS VARCHAR), '—') || ' | body fat ' || coalesce(body_fat_text, '—') || CASE WHEN computed THEN ' (computed)' ELSE '' END FROM scans
UNION ALL SELECT subject_id, 'S', 'S | ' || system || ' | optimal ' || optimal || ' | moderate ' || moderate || ' | flag ' || flagged || ' | not scored ' || not_scored || ' | score ' || now_score || ' | ' || zone FROM system_scores WHERE markers > 0
UNION ALL SELECT subject_id, 'O', 'O | overall now ' || overall_now || ' | first visit ' || coalesce(CAST(overall_then AS VARCHAR), '—') FROM overall_rows""",
    ("scored", "reported", "scans", "system_scores", "overall_rows"))


def facts(spark, folder):
    return P.fact_rows(scored(spark, folder), reported(spark, folder), scans(spark, folder), M.symptom_score(answers(spark, folder)))


@query("fact_rows", "S4", "SELECT * FROM facts", ("facts",))
def fact_rows(spark, folder):
    return facts(spark, folder)


def printed_facts(spark, folder, field):
    """Two prints of the same facts that differ where a quantity is high."""
    b = B.observations(spark, folder)
    disp = F.when((F.col("row_no") % 40 == 0) & F.lit(field == "after"), F.concat(F.col("disp"), F.lit("0"))).otherwise(F.col("disp"))
    return b.select("subject_id", F.concat_ws(" | ", F.lit("M"), "test", F.date_format("day", "MM/dd/yyyy"), disp).alias("row"))


cte("facts_before", f"SELECT subject_id, 'M | ' || test || ' | ' || {_US.format('day')} || ' | ' || disp AS \"row\" FROM obs", ("obs",))
cte("facts_after", f"SELECT subject_id, 'M | ' || test || ' | ' || {_US.format('day')} || ' | ' || disp || CASE WHEN row_no % 40 = 0 THEN '0' ELSE '' END AS \"row\" FROM obs", ("obs",))


@query("compare_exact", "U1", """
SELECT *, 'missing' AS side FROM (SELECT * FROM facts_before EXCEPT ALL SELECT * FROM facts_after)
UNION ALL SELECT *, 'extra' FROM (SELECT * FROM facts_after EXCEPT ALL SELECT * FROM facts_before)""", ("facts_before", "facts_after"))
def compare_exact(spark, folder):
    return P.compare_exact(printed_facts(spark, folder, "before"), printed_facts(spark, folder, "after"))


@query("compare_subset", "U2", f"""
WITH e AS (SELECT DISTINCT subject_id, test, day, row_no % 3 AS form, CASE row_no % 3 WHEN 0 THEN '*' WHEN 1 THEN disp ELSE left(disp, 1) || ' *' END AS last FROM obs WHERE disp <> '')
SELECT DISTINCT subject_id, 'M | ' || test || ' | ' || {_US.format('day')} || ' | ' || last AS "row" FROM e
WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.subject_id = e.subject_id AND o.test = e.test AND o.day = e.day AND o.row_no % 40 <> 0 AND o.disp <> ''
                  AND CASE e.form WHEN 0 THEN TRUE WHEN 1 THEN o.disp = e.last ELSE starts_with(o.disp, rtrim(e.last, '*')) END)""", ("obs",))
def compare_subset(spark, folder):
    obs = B.observations(spark, folder).filter(F.col("disp") != "")
    form = F.col("row_no") % 3
    last = F.when(form == 0, "*").when(form == 1, F.col("disp")).otherwise(F.concat(F.substring("disp", 1, 1), F.lit(" *")))
    line = lambda tail: F.concat(F.lit("M | "), F.col("test"), F.lit(" | "), F.date_format("day", "MM/dd/yyyy"), F.lit(" | "), tail)
    expected = obs.select("subject_id", line(last).alias("row"))
    actual = obs.filter(F.col("row_no") % 40 != 0).select("subject_id", line(F.col("disp")).alias("row"))
    return P.compare_subset(expected, actual)


@query("diff_snapshots", "U3", """
SELECT subject_id, "row", 'removed' AS change FROM (SELECT * FROM facts_before EXCEPT SELECT * FROM facts_after)
UNION ALL SELECT subject_id, "row", 'added' FROM (SELECT * FROM facts_after EXCEPT SELECT * FROM facts_before)""", ("facts_before", "facts_after"))
def diff_snapshots(spark, folder):
    return P.diff_snapshots(printed_facts(spark, folder, "before"), printed_facts(spark, folder, "after"), ["subject_id", "row"])


@query("diff_records", "U4", """
WITH a AS (SELECT subject_id, system, now_score, zone FROM system_scores), b AS (SELECT subject_id, system, now_score, zone FROM lifted_systems),
x AS (SELECT subject_id, system || '.now_score' AS path, CAST(now_score AS VARCHAR) AS v FROM a UNION ALL SELECT subject_id, system || '.zone', zone FROM a),
y AS (SELECT subject_id, system || '.now_score' AS path, CAST(now_score AS VARCHAR) AS v FROM b UNION ALL SELECT subject_id, system || '.zone', zone FROM b)
SELECT subject_id, path, 'changed' AS change, x.v AS before, y.v AS after FROM x JOIN y USING (subject_id, path) WHERE x.v IS DISTINCT FROM y.v""",
       ("system_scores", "lifted_systems"))
def diff_records(spark, folder):
    marks = scored(spark, folder)

    def flat(rows):
        each = P.flatten_record(rows.withColumn("k", F.struct("subject_id", "system")), "k", ["now_score", "zone"])
        return each.select(F.col("k.subject_id").alias("subject_id"), F.concat_ws(".", "k.system", "path").alias("path"), "value")

    return P.diff_records(flat(M.rollup_systems(marks)), flat(M.rollup_systems(M.goal_ceiling(marks))), "subject_id")


@query("expired_groups", "S7", """
SELECT user_id AS group_id, max(epoch_us(ts)) / 1000000 AS newest, count(*) AS members FROM events GROUP BY user_id
HAVING CAST(1706700000 AS DOUBLE) - max(epoch_us(ts)) / 1000000 > 21600""")
def expired_groups(spark, folder):
    files = table(spark, folder, "events").select(
        F.col("user_id").alias("group_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("mtime"))
    return stores.expired_groups(files, now=1706700000.0)


def key_events(spark, folder):
    return table(spark, folder, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))


_SESSIONS = """
WITH g AS (SELECT user_id AS key, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 21600000000 THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT key, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS events FROM s GROUP BY key, n"""


@query("silent_sessions", "X1", _SESSIONS)
def silent_sessions(spark, folder):
    return jobs.sessions(key_events(spark, folder), gap_seconds=6 * 3600)


@query("stale_keys", "X1", """
SELECT user_id AS key, max(ts) AS last_seen, count(*) AS events FROM events GROUP BY user_id
HAVING epoch_us(TIMESTAMP '2024-01-31 10:00:00') - max(epoch_us(ts)) > 21600000000""")
def stale_keys(spark, folder):
    return jobs.stale_keys(key_events(spark, folder), F.lit("2024-01-31 10:00:00"), gap_seconds=6 * 3600)


@query("silent_sessions_stream", "X1", _SESSIONS)
def silent_sessions_stream(spark, folder):
    source = spark.readStream.schema(table(spark, folder, "events").schema).option("maxFilesPerTrigger", 1).option(
        "pathGlobFilter", "events.parquet").parquet(folder)
    events = source.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    at = new_path(spark, "stream")
    for run in (jobs.write_sessions, jobs.close_sessions):
        run(events, f"{at}/sessions", f"{at}/state", gap_seconds=6 * 3600).awaitTermination()
    return spark.read.schema("key bigint, first_seen timestamp, last_seen timestamp, events bigint").parquet(f"{at}/sessions")


@query("incremental_reconcile", "X2", """
WITH g AS (SELECT user_id AS subject_id, event_type AS test, CAST(ts AS DATE) AS day, CASE WHEN count(DISTINCT floor(value)) = 1 THEN min(floor(value)) END AS value,
                  count(DISTINCT floor(value)) AS kinds FROM events GROUP BY ALL),
k AS (SELECT * FROM g WHERE kinds = 1), l AS (SELECT subject_id, max(day) AS latest FROM k GROUP BY subject_id),
p AS (SELECT *, row_number() OVER (PARTITION BY subject_id, test ORDER BY day) AS n, count(*) OVER (PARTITION BY subject_id, test) AS results FROM k)
SELECT a.subject_id, a.test, a.results, CASE WHEN a.results > 1 OR a.day <> l.latest THEN a.day END AS then_day, CASE WHEN a.results > 1 OR a.day <> l.latest THEN a.value END AS then_value,
       CASE WHEN a.results > 1 OR a.day = l.latest THEN z.day END AS now_day, CASE WHEN a.results > 1 OR a.day = l.latest THEN z.value END AS now_value
FROM p a JOIN p z ON a.subject_id = z.subject_id AND a.test = z.test AND a.n = 1 AND z.n = z.results JOIN l ON l.subject_id = a.subject_id""")
def incremental_reconcile(spark, folder):
    source = spark.readStream.schema(table(spark, folder, "events").schema).option("maxFilesPerTrigger", 1).option(
        "pathGlobFilter", "events.parquet").parquet(folder)
    rows = source.select(
        F.col("user_id").alias("subject_id"), F.col("event_id").alias("doc_id"), F.lit(1).cast("bigint").alias("page"), F.col("event_id").alias("ord"),
        F.lit(0).cast("bigint").alias("row_no"), F.col("event_type").alias("test"), F.to_date("ts").alias("day"), F.lit("current").alias("column_kind"),
        F.lit("final").alias("status"), F.floor("value").cast("double").alias("value"), F.floor("value").cast("string").alias("disp"),
        F.lit(None).cast("string").alias("flag"), F.lit(None).cast("double").alias("range_lo"), F.lit(None).cast("double").alias("range_hi"),
        F.lit(None).cast("string").alias("range_display"), F.lit(None).cast("string").alias("unit"))
    at = new_path(spark, "stream")
    jobs.reconcile_stream(rows, f"{at}/verdicts", f"{at}/state").awaitTermination()
    return jobs.current_results(spark, f"{at}/verdicts").select(
        "subject_id", "test", "results", "then_day", "then_value", "now_day", "now_value")
