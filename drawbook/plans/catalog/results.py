"""Queries over printed results: de-duplication, reconciliation, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawbook.operators import reconcile as R
from drawbook.plans.registry import cte, query
from drawbook.sources import bindings as B

SIG = "status || '|' || coalesce(CAST(value AS VARCHAR), '') || '|' || CASE WHEN value IS NULL THEN disp ELSE '' END"
ORDER = "ord, row_no, page, doc_id, status, value NULLS FIRST, disp"

cte("marked", f"""
SELECT *, status <> 'not_performed' AS printed, column_kind = 'current' AS cur, {SIG} AS sig FROM obs""", ("obs",))
cte("day_groups", """
SELECT subject_id, test, day, bool_or(cur) AS own, bool_or(cur AND printed) AS cur_printed,
       bool_or(NOT cur AND printed) AS his_printed, count(*) AS copies
FROM marked GROUP BY subject_id, test, day""", ("marked",))
cte("chosen", """
SELECT m.*, g.own, g.his_printed, g.copies FROM marked m JOIN day_groups g USING (subject_id, test, day)
WHERE m.cur = g.own AND (m.printed OR NOT (CASE WHEN g.own THEN g.cur_printed ELSE g.his_printed END))""",
    ("marked", "day_groups"))


def _first(column: str, extra: str = "") -> str:
    keep = "" if not extra else f" FILTER (WHERE printed AND {extra})"
    tail = {"flag": "flag", "unit": "unit"}.get(column, "range_lo, range_hi, range_display")
    order = ORDER if not extra else f"ord, row_no, {tail}"
    return f"first({column} ORDER BY {order}){keep} AS {column}"


cte("day_first", f"""
SELECT subject_id, test, day, any_value(own) AS own, any_value(copies) AS copies,
       any_value(his_printed) AS his_printed, count(DISTINCT sig) AS kinds,
       {_first('sig')}, {_first('ord')}, {_first('row_no')}, {_first('doc_id')}, {_first('page')}, {_first('status')},
       {_first('value')}, {_first('disp')}, {_first('flag', 'flag IS NOT NULL')},
       {_first('range_lo', 'range_display IS NOT NULL')}, {_first('range_hi', 'range_display IS NOT NULL')},
       {_first('range_display', 'range_display IS NOT NULL')}, {_first('unit', "coalesce(unit, '') <> ''")}
FROM chosen GROUP BY subject_id, test, day""", ("chosen",))
cte("differing", """
SELECT DISTINCT f.subject_id, f.test, f.day FROM day_first f JOIN marked m USING (subject_id, test, day)
WHERE f.own AND NOT m.cur AND m.printed AND m.sig <> f.sig""", ("day_first", "marked"))
cte("deduped", """
SELECT f.subject_id, f.test, f.day, f.ord, f.row_no, f.doc_id, f.page,
       CASE WHEN own THEN 'current' ELSE 'historical' END AS column_kind, f.status, f.value, f.disp, f.flag,
       f.range_lo, f.range_hi, f.range_display, f.unit, f.copies,
       CASE WHEN own AND kinds > 1 THEN 'conflict' WHEN NOT own AND kinds > 1 THEN 'excluded'
            WHEN d.subject_id IS NOT NULL THEN 'historical_differs' ELSE 'kept' END AS verdict
FROM day_first f LEFT JOIN differing d USING (subject_id, test, day)""", ("day_first", "differing"))
cte("accepted", "SELECT * FROM deduped WHERE verdict IN ('kept', 'historical_differs')", ("deduped",))


def deduped(spark, folder):
    return R.dedupe_sources(B.observations(spark, folder, dealt=True))


def accepted(spark, folder):
    return R.accepted(deduped(spark, folder))


@query("dedupe_sources", "A1 S1", "SELECT * FROM deduped", ("deduped",))
def dedupe_sources(spark, folder):
    return deduped(spark, folder)


@query("conflict_split", "A2", """
SELECT verdict, test, count(*) AS days, CAST(sum(copies) AS BIGINT) AS copies, min(day) AS first_day, max(day) AS last_day
FROM deduped GROUP BY verdict, test""", ("deduped",))
def conflict_split(spark, folder):
    return deduped(spark, folder).groupBy("verdict", "test").agg(
        F.count(F.lit(1)).alias("days"), F.sum("copies").alias("copies"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day"))


@query("unblocked_results", "A2 A33", """
SELECT subject_id, test, day, value, disp FROM accepted a
WHERE NOT EXISTS (SELECT 1 FROM deduped d WHERE d.subject_id = a.subject_id AND d.verdict = 'conflict')""",
       ("accepted", "deduped"))
def unblocked_results(spark, folder):
    days = deduped(spark, folder)
    return R.accepted(days).join(R.blocked_subjects(days), "subject_id", "left_anti").select(
        "subject_id", "test", "day", "value", "disp")


cte("uniq", """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id, test, day, value, CASE WHEN value IS NULL THEN disp END
                               ORDER BY ord, row_no, disp, flag NULLS FIRST, range_lo NULLS FIRST, range_hi NULLS FIRST,
                                        range_display NULLS FIRST, unit NULLS FIRST) AS copy_no
  FROM accepted WHERE day IS NOT NULL AND (value IS NOT NULL OR disp <> ''))
WHERE copy_no = 1""", ("accepted",))
cte("placed", """
SELECT *, row_number() OVER (PARTITION BY subject_id, test ORDER BY day, ord, row_no, value NULLS FIRST) AS pos,
       count(*) OVER (PARTITION BY subject_id, test) AS results
FROM uniq""", ("uniq",))
cte("latest", "SELECT subject_id, max(day) AS latest_day FROM accepted GROUP BY subject_id", ("accepted",))
_POINT = R.POINT
cte("reconciled", f"""
SELECT f.subject_id, f.test, l.latest_day, f.results,
       {', '.join(f"CASE WHEN f.results > 1 OR f.day <> l.latest_day THEN f.{c} END AS then_{c}" for c in _POINT)},
       {', '.join(f"CASE WHEN f.results > 1 OR f.day = l.latest_day THEN e.{c} END AS now_{c}" for c in _POINT)}
FROM placed f JOIN placed e ON f.subject_id = e.subject_id AND f.test = e.test AND f.pos = 1 AND e.pos = e.results
JOIN latest l ON l.subject_id = f.subject_id""", ("placed", "latest"))


def reconciled(spark, folder):
    return R.reconcile(accepted(spark, folder), unique=True)


@query("reconcile_then_now", "A3", "SELECT * FROM reconciled", ("reconciled",))
def reconcile_then_now(spark, folder):
    return reconciled(spark, folder)


@query("reconcile_history", "A3 W14", """
SELECT subject_id, test, day, ord, row_no, value, disp, flag FROM placed WHERE pos > 1 AND pos < results""", ("placed",))
def reconcile_history(spark, folder):
    return R.history(accepted(spark, folder))


@query("coalesce_mentions", "A4", """
WITH g AS (
  SELECT subject_id, doc_id, test, count(*) AS mentions, min(value) AS lowest, max(value) AS highest,
         first(value ORDER BY ord, row_no, value NULLS FIRST, disp) AS m_value,
         first(flag ORDER BY ord, row_no, value NULLS FIRST, disp, flag NULLS FIRST) AS m_flag,
         first(unit ORDER BY ord, row_no, value NULLS FIRST, disp, flag NULLS FIRST, unit NULLS FIRST) AS m_unit,
         first(range_display ORDER BY ord, row_no, value NULLS FIRST, disp, flag NULLS FIRST, unit NULLS FIRST,
               range_display NULLS FIRST) AS m_range,
         first(range_lo ORDER BY ord, row_no, value NULLS FIRST, disp, flag NULLS FIRST, unit NULLS FIRST,
               range_display NULLS FIRST) AS m_lo,
         first(range_hi ORDER BY ord, row_no, value NULLS FIRST, disp, flag NULLS FIRST, unit NULLS FIRST,
               range_display NULLS FIRST) AS m_hi,
         first(value ORDER BY ord, row_no, value) FILTER (WHERE value IS NOT NULL) AS v_value,
         first(flag ORDER BY ord, row_no, flag) FILTER (WHERE flag IS NOT NULL) AS f_flag,
         first(unit ORDER BY ord, row_no, unit) FILTER (WHERE coalesce(unit, '') <> '') AS u_unit,
         first(range_display ORDER BY ord, row_no, range_hi) FILTER (WHERE range_display IS NOT NULL) AS r_range,
         first(range_lo ORDER BY ord, row_no, range_hi) FILTER (WHERE range_display IS NOT NULL) AS r_lo,
         first(range_hi ORDER BY ord, row_no, range_hi) FILTER (WHERE range_display IS NOT NULL) AS r_hi
  FROM obs GROUP BY subject_id, doc_id, test),
h AS (SELECT *, coalesce(lowest <> highest, FALSE) AS conflict FROM g)
SELECT subject_id, doc_id, test, mentions, CASE WHEN conflict THEN m_value ELSE coalesce(m_value, v_value) END AS value,
       CASE WHEN conflict THEN m_flag ELSE coalesce(m_flag, f_flag) END AS flag,
       CASE WHEN conflict OR coalesce(m_unit, '') <> '' THEN m_unit ELSE coalesce(u_unit, m_unit) END AS unit,
       CASE WHEN conflict OR m_range IS NOT NULL THEN m_lo ELSE r_lo END AS range_lo,
       CASE WHEN conflict OR m_range IS NOT NULL THEN m_hi ELSE r_hi END AS range_hi,
       CASE WHEN conflict OR m_range IS NOT NULL THEN m_range ELSE r_range END AS range_display, conflict
FROM h""", ("obs",))
def coalesce_mentions(spark, folder):
    return R.coalesce_mentions(B.observations(spark, folder))


@query("provenance_labels", "C33", """
WITH p AS (SELECT subject_id, doc_id, test, day, count(*) AS copies, first(CASE page % 3 WHEN 0 THEN 'LIPID PANEL' WHEN 1 THEN '' END ORDER BY ord, row_no) AS heading FROM obs GROUP BY ALL),
u AS (SELECT DISTINCT subject_id, doc_id, test, day, page FROM obs),
l AS (SELECT subject_id, doc_id, test, day, string_agg(page, ', ' ORDER BY page) AS pages FROM u GROUP BY ALL)
SELECT subject_id, doc_id, test, day, pages, copies,
       'Order ' || doc_id || ' (collected ' || strftime(day, '%m/%d/%Y') || ')' || coalesce('; ' || nullif(heading, ''), '') || '; pages ' || pages AS label
FROM p JOIN l USING (subject_id, doc_id, test, day)""", ("obs",))
def provenance_labels(spark, folder):
    heading = F.when(F.col("page") % 3 == 0, "LIPID PANEL").when(F.col("page") % 3 == 1, "")
    return R.contributing_pages(B.observations(spark, folder).withColumn("heading", heading))


@query("draw_bounds", "W1", """
WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY day, ord, row_no, test, disp) AS up,
         row_number() OVER (PARTITION BY subject_id ORDER BY day DESC, ord DESC, row_no DESC, test DESC, disp DESC) AS down
  FROM obs WHERE value IS NOT NULL OR disp <> '')
SELECT a.subject_id, a.day AS first_draw, b.day AS latest_draw, date_diff('day', a.day, b.day) AS days_between,
       a.day = b.day AS single_draw, a.test AS baseline_test, a.disp AS baseline_disp, b.test AS latest_test,
       b.disp AS latest_disp
FROM r a JOIN r b USING (subject_id) WHERE a.up = 1 AND b.down = 1""", ("obs",))
def draw_bounds(spark, folder):
    return R.draw_bounds(B.observations(spark, folder))
