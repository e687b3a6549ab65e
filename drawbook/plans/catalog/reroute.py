"""Queries that move results to the reported list and build it."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawbook.constants import REPORTED_GROUPS
from drawbook.operators import reroute as X
from drawbook.plans.catalog.results import accepted
from drawbook.plans.registry import cte, query, values_cte
from drawbook.sources import bindings as B
from drawbook.sources.tables import table

cte("draw_headers", """
SELECT o_custkey AS subject_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS day,
       CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CASE o_orderkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'No' WHEN 2 THEN 'Unknown' WHEN 3 THEN '' END END AS fasting
FROM orders""")
cte("draw_status", """
WITH n AS (SELECT subject_id, day, CASE fasting WHEN 'Y' THEN 'Y' WHEN 'No' THEN 'N' WHEN 'Unknown' THEN 'UNKNOWN' ELSE 'BLANK' END AS s
           FROM draw_headers WHERE fasting IS NOT NULL)
SELECT subject_id, day, CASE WHEN count(DISTINCT s) = 1 THEN min(s) ELSE 'CONFLICT' END AS status FROM n GROUP BY subject_id, day""",
    ("draw_headers",))


def draw_headers(spark, folder):
    key = F.col("o_orderkey") % 5
    said = F.when(key == 0, "Y").when(key == 1, "No").when(key == 2, "Unknown").when(key == 3, "")
    return table(spark, folder, "orders").select(  # a quarter of the subjects' documents print no status
        F.col("o_custkey").alias("subject_id"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("day"),
        F.when(F.col("o_custkey") % 4 != 0, said).alias("fasting"))


@query("draw_status", "C20 A30", "SELECT * FROM draw_status", ("draw_status",))
def draw_status(spark, folder):
    return X.draw_status(draw_headers(spark, folder))


@query("fasting_reroute", "A16", """
SELECT o.subject_id, o.test, o.day, o.ord, o.row_no, o.disp, m.moved, CASE WHEN m.moved THEN f.shown_name END AS shown_name,
       CASE WHEN m.moved THEN f.shown_group END AS shown_group,
       CASE WHEN m.moved AND s.status = 'N' THEN 'This sample was taken without fasting; the result is listed and gets no score.'
            WHEN m.moved THEN 'No record says that this sample was fasting; the result is listed and gets no score.' END AS note
FROM accepted o LEFT JOIN fasting_only f USING (test) LEFT JOIN draw_status s ON s.subject_id = o.subject_id AND s.day = o.day
LEFT JOIN (SELECT DISTINCT subject_id FROM draw_status) k ON k.subject_id = o.subject_id
CROSS JOIN LATERAL (SELECT f.shown_name IS NOT NULL AND k.subject_id IS NOT NULL AND s.status IS DISTINCT FROM 'Y'
                           AND (o.value IS NOT NULL OR o.disp <> '') AS moved) m""", ("accepted", "fasting_only", "draw_status"))
def fasting_reroute(spark, folder):
    rows = X.apply_fasting(accepted(spark, folder), X.draw_status(draw_headers(spark, folder)), B.fasting_only(spark))
    return rows.select("subject_id", "test", "day", "ord", "row_no", "disp", "moved", "shown_name", "shown_group", "note")


cte("library_basis", """
SELECT u.test, coalesce(g.hi, u.optimal) AS library_basis, g.hi, u.optimal,
       CASE WHEN CAST(substr(u.test, 2) AS INTEGER) % 2 = 0 THEN 'mg/dL' ELSE 'ug/L' END AS library_unit
FROM rules u LEFT JOIN rule_ranges g ON g.test = u.test AND g.sex = 'male'""", ("rules", "rule_ranges"))


def library_basis(spark):
    male = B.rule_ranges(spark).filter(F.col("sex") == "male").select("test", "hi")
    number = F.substring("test", 2, 2).cast("int")
    return B.rules(spark).join(male, "test", "left").select(
        "test", "hi", "optimal", F.when(number % 2 == 0, "mg/dL").otherwise("ug/L").alias("library_unit"))


@query("assay_changes", "A17 J23", """
WITH r AS (SELECT *, CASE WHEN range_display IS NOT NULL THEN '10.0,' || CAST(range_hi AS BIGINT) || '.0' END AS own FROM accepted
           WHERE value IS NOT NULL OR disp <> ''),
f AS (SELECT subject_id, test, count(DISTINCT own) AS kinds FROM r GROUP BY subject_id, test),
j AS (SELECT r.*, f.kinds, l.library_basis, CASE WHEN r.test = 'T9' THEN '10.0,30.0' END AS basis_key,
             bool_or(coalesce(r.own <> CASE WHEN r.test = 'T9' THEN '10.0,30.0' END, FALSE)) OVER (PARTITION BY r.subject_id, r.test) AS off_basis
      FROM r JOIN f USING (subject_id, test) LEFT JOIN library_basis l USING (test))
SELECT subject_id, test, day, ord, row_no, range_display, kinds > 1 AS range_changed,
       CASE WHEN NOT (kinds > 1 OR off_basis) THEN NULL WHEN own IS NULL THEN CASE WHEN kinds > 1 THEN 'no_own_range' END
            WHEN basis_key IS NOT NULL THEN CASE WHEN own <> basis_key THEN 'not_basis' END
            WHEN range_hi / library_basis > 2 OR library_basis / range_hi > 2 THEN 'range_basis' END AS reason
FROM j""", ("accepted", "library_basis"))
def assay_changes(spark, folder):
    rows = X.apply_assay_changes(accepted(spark, folder), library_basis(spark), B.range_basis(spark), ratio=2)
    return rows.select("subject_id", "test", "day", "ord", "row_no", "range_display", "range_changed", "reason")


@query("assay_safeguard", "J23", """
SELECT o.subject_id, o.test, o.day, o.ord, o.row_no, o.unit, o.range_display,
       CASE WHEN o.test = 'T10' THEN 'listed_assay' WHEN o.range_hi / l.library_basis > 2 OR l.library_basis / o.range_hi > 2 THEN 'range_basis'
            WHEN coalesce(o.unit, '') <> '' AND (o.unit = 'mg/dL') <> (l.library_unit = 'mg/dL') THEN 'unit' END AS reason
FROM obs o LEFT JOIN library_basis l USING (test)""", ("obs", "library_basis"))
def assay_safeguard(spark, folder):
    listed = spark.createDataFrame([("T10",)], "test string")
    rows = B.observations(spark, folder).join(library_basis(spark), "test", "left")
    return X.assay_differs(rows, listed, ratio=2).select(
        "subject_id", "test", "day", "ord", "row_no", "unit", "range_display", "reason")


@query("unconfirmed_sex_ranges", "A18", """
WITH j AS (
  SELECT a.subject_id, a.test, a.day, a.ord, a.row_no, a.flag, a.range_display, p.sex, coalesce(p.bhrt, FALSE) AS treated,
         CASE u.kind WHEN 'bounded' THEN u.optimal IS NULL ELSE (CASE WHEN p.sex = 'female' AND coalesce(p.bhrt, FALSE) AND v.o_lo IS NOT NULL
              THEN v.o_lo ELSE g.lo END) IS NULL END AS absent
  FROM accepted a JOIN rules u USING (test) LEFT JOIN people p USING (subject_id)
  LEFT JOIN rule_ranges g ON g.test = a.test AND g.sex = coalesce(p.sex, u.default_sex) LEFT JOIN overlays v ON v.test = a.test),
r AS (SELECT *, CASE WHEN sex = 'female' AND test IN ('T6', 'T7') AND NOT treated THEN 'cycle_phase'
                     WHEN sex = 'female' AND absent THEN 'no_threshold' END AS reason FROM j)
SELECT subject_id, test, day, ord, row_no, sex, reason, CASE WHEN reason IS DISTINCT FROM 'cycle_phase' THEN flag END AS flag,
       CASE WHEN reason IS DISTINCT FROM 'cycle_phase' THEN range_display END AS range_display
FROM r""", ("accepted", "rules", "people", "rule_ranges", "overlays"))
def unconfirmed_sex_ranges(spark, folder):
    from drawbook.operators.markers import resolve_thresholds

    rows = resolve_thresholds(accepted(spark, folder), B.subjects(spark, folder), B.rules(spark), B.rule_ranges(spark),
                              B.overlays(spark))
    return X.apply_unconfirmed(rows, B.PHASE_TESTS).select(
        "subject_id", "test", "day", "ord", "row_no", "sex", "reason", "flag", "range_display")


# --- rows no scored test claims ------------------------------------------------------------------------------------

_LAB = [(f"x{i}", f"Lab X{i}", REPORTED_GROUPS[i % 10]) for i in range(12)] + [
    ("x5", "Lab X5b", "Chemistry"), ("x3", "Urinalysis — X3", "Urinalysis"), ("x4", "Urinalysis — X4", "Urinalysis")]
values_cte("lab_dim", ["alias", "canonical", "grp"], _LAB)


def unknown_rows(spark, folder):
    row = F.col("row_no")
    section = F.when(row % 5 == 0, "URINALYSIS, COMPLETE").when(row % 5 == 1, "Chemistry").when(row % 5 == 2, "Metabolic panel")
    return B.observations(spark, folder).select(
        "subject_id", "doc_id", "ord", "row_no", "day", "column_kind", "status", "value", "disp", "flag", "range_display", "unit",
        F.concat(F.lit("X"), (row % 20).cast("string")).alias("raw_name"), section.alias("section"))


cte("unknown_rows", """
SELECT subject_id, doc_id, ord, row_no, day, column_kind, status, value, disp, flag, range_display, unit, 'X' || (row_no % 20) AS raw_name,
       CASE row_no % 5 WHEN 0 THEN 'URINALYSIS, COMPLETE' WHEN 1 THEN 'Chemistry' WHEN 2 THEN 'Metabolic panel' END AS section
FROM obs""", ("obs",))
cte("matched_rows", """
WITH d AS (SELECT alias, grp = 'Urinalysis' AS urine, min(canonical) AS canonical, min(grp) AS grp FROM lab_dim
           GROUP BY alias, grp = 'Urinalysis' HAVING count(DISTINCT canonical) = 1)
SELECT u.* EXCLUDE (row_flagged, row_readable), d.canonical IS NULL AS staff_listed,
       CASE WHEN d.canonical IS NOT NULL THEN d.canonical
            WHEN row_flagged OR row_readable
            THEN CASE WHEN row_no % 5 = 0 THEN 'Urinalysis — ' || raw_name ELSE raw_name END END AS shown_name,
       CASE WHEN d.canonical IS NOT NULL THEN d.grp WHEN row_flagged THEN 'Other Lab-Flagged Results'
            WHEN row_readable
            THEN CASE WHEN row_no % 5 = 0 THEN 'Urinalysis' ELSE coalesce(section, 'Other Lab Results') END END AS shown_group
FROM (SELECT *, bool_or(flag IS NOT NULL) OVER w AS row_flagged, bool_or(coalesce(unit, '') <> '' OR coalesce(range_display, '') <> '') OVER w AS row_readable
      FROM unknown_rows WINDOW w AS (PARTITION BY subject_id, doc_id, section, raw_name)) u LEFT JOIN d ON d.alias = lower(u.raw_name) AND d.urine = (u.row_no % 5 = 0)""", ("unknown_rows", "lab_dim"))
cte("reported", """
WITH r AS (SELECT *, lower(shown_name) AS item, column_kind = 'current' AS cur, disp || '|' || coalesce(flag, '~') AS sig
           FROM matched_rows WHERE shown_name IS NOT NULL AND (value IS NOT NULL OR disp <> '')),
g AS (SELECT subject_id, item, first(shown_name ORDER BY ord, row_no, shown_name, shown_group) AS shown_name,
             first(shown_group ORDER BY ord, row_no, shown_name, shown_group) AS shown_group FROM r GROUP BY subject_id, item),
d AS (SELECT subject_id, item, day, bool_or(cur) AS own, count(*) AS copies FROM r GROUP BY ALL),
c AS (SELECT r.subject_id, r.item, r.day, count(DISTINCT sig) AS kinds, min(sig) AS sig,
             first(disp ORDER BY disp, flag NULLS FIRST) AS disp, first(flag ORDER BY disp, flag NULLS FIRST) AS flag
      FROM r JOIN d USING (subject_id, item, day) WHERE r.cur = d.own GROUP BY ALL),
u AS (SELECT subject_id, item, day, CASE WHEN count(DISTINCT range_display) = 1 THEN min(range_display) END AS range_display,
             CASE WHEN count(DISTINCT nullif(unit, '')) = 1 THEN min(nullif(unit, '')) END AS unit FROM r WHERE cur GROUP BY ALL),
h AS (SELECT DISTINCT r.subject_id, r.item, r.day FROM r JOIN d USING (subject_id, item, day) JOIN c USING (subject_id, item, day)
      WHERE d.own AND NOT r.cur AND r.sig <> c.sig)
SELECT d.subject_id, d.item, g.shown_name, g.shown_group, d.day, c.disp, c.flag, u.range_display, u.unit, d.copies,
       CASE WHEN c.kinds > 1 THEN 'conflict' WHEN h.subject_id IS NOT NULL THEN 'historical_differs' ELSE 'kept' END AS verdict
FROM d JOIN c USING (subject_id, item, day) JOIN g USING (subject_id, item) LEFT JOIN u USING (subject_id, item, day)
LEFT JOIN h USING (subject_id, item, day)""", ("matched_rows",))


def matched(spark, folder):
    dim = B.fixed(spark, _LAB, "alias string, canonical string, grp string")
    return X.match_reported(unknown_rows(spark, folder), dim)


def reported(spark, folder):
    return X.build_reported(matched(spark, folder))


@query("lab_reported_build", "A5", "SELECT * FROM reported", ("reported",))
def lab_reported_build(spark, folder):
    return reported(spark, folder)


values_cte("group_ranks", ["shown_group", "rank"], [(g, i * 2) for i, g in enumerate(REPORTED_GROUPS)])


@query("lab_reported_order", "T2 A5", """
SELECT r.subject_id, r.shown_group, coalesce(k.rank, 21) AS rank, count(*) AS results, count(DISTINCT r.item) AS items
FROM reported r LEFT JOIN group_ranks k USING (shown_group) WHERE r.verdict <> 'conflict' GROUP BY ALL""", ("reported", "group_ranks"))
def lab_reported_order(spark, folder):
    rows = reported(spark, folder).filter(F.col("verdict") != "conflict")
    per_item = rows.groupBy("subject_id", "shown_group", "item").agg(F.count(F.lit(1)).alias("n"))
    return per_item.groupBy("subject_id", "shown_group", X.group_rank(F.col("shown_group")).alias("rank")).agg(
        F.sum("n").alias("results"), F.count(F.lit(1)).alias("items")).orderBy("subject_id", "rank", "shown_group")


@query("also_on_file", "W14", """
WITH k AS (SELECT * FROM reported WHERE verdict <> 'conflict'),
p AS (SELECT *, row_number() OVER (PARTITION BY subject_id, item ORDER BY day) AS pos, count(*) OVER (PARTITION BY subject_id, item) AS n,
             count(range_display) OVER (PARTITION BY subject_id, item) AS ranged FROM k),
d AS (SELECT subject_id, item, count(DISTINCT range_display) AS kinds FROM k GROUP BY ALL)
SELECT p.subject_id, p.item, p.day, p.disp, p.flag, p.range_display,
       CASE WHEN pos = n THEN 'latest' WHEN pos = 1 THEN 'earliest' ELSE 'also_on_file' END AS place, d.kinds > 1 AS own_range
FROM p JOIN d USING (subject_id, item)""", ("reported",))
def also_on_file(spark, folder):
    return X.also_on_file(reported(spark, folder))


@query("duplicates_not_shown", "J12", """
WITH t AS (SELECT *, 'T' || substr(item, 2) AS test FROM reported WHERE verdict <> 'conflict'),
s AS (SELECT DISTINCT subject_id, test, day FROM accepted WHERE value IS NOT NULL OR disp <> '')
SELECT t.subject_id, t.item, t.test, t.day, t.disp, s.subject_id IS NOT NULL AND t.item <> 'x5' AS duplicate
FROM t LEFT JOIN s ON s.subject_id = t.subject_id AND s.test = t.test AND s.day = t.day""", ("reported", "accepted"))
def duplicates_not_shown(spark, folder):
    rows = reported(spark, folder).filter(F.col("verdict") != "conflict")
    rows = rows.withColumn("test", F.concat(F.lit("T"), F.expr("substr(item, 2)")))
    own = spark.createDataFrame([("x5",)], "item string")
    seen = accepted(spark, folder).filter(F.col("value").isNotNull() | (F.col("disp") != ""))
    return X.drop_duplicates_shown(rows, seen.select("subject_id", "test", "day"), own).select(
        "subject_id", "item", "test", "day", "disp", "duplicate")


@query("unrecognized_summary", "A23", """
WITH v AS (
  SELECT subject_id, raw_name, shown_name IS NOT NULL AS shown, day, range_display,
         disp || CASE WHEN flag IS NOT NULL THEN ' ' || flag ELSE '' END || CASE WHEN coalesce(unit, '') <> '' THEN ' ' || unit ELSE '' END AS value
  FROM matched_rows WHERE value IS NOT NULL OR disp <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY subject_id, raw_name, shown ORDER BY day, value) AS up,
             row_number() OVER (PARTITION BY subject_id, raw_name, shown ORDER BY day DESC, value DESC) AS down FROM v)
SELECT subject_id, raw_name, shown, count(DISTINCT (day, value)) AS "values", count(*) AS "rows",
       min(day) AS first_day, max(CASE WHEN up = 1 THEN value END) AS first_value, max(day) AS last_day,
       max(CASE WHEN down = 1 THEN value END) AS last_value, count(DISTINCT range_display) > 1 AS ranges_differ
FROM o GROUP BY subject_id, raw_name, shown""", ("matched_rows",))
def unrecognized_summary(spark, folder):
    return X.unrecognized_summary(matched(spark, folder))


@query("review_items", "U6", """
SELECT CASE WHEN shown_name IS NOT NULL THEN 'shown' ELSE 'left_out' END AS handling, lower(raw_name) AS name, count(*) AS "rows"
FROM matched_rows WHERE staff_listed GROUP BY ALL""", ("matched_rows",))
def review_items(spark, folder):
    return X.review_items(matched(spark, folder))


@query("coverage_gaps", "J9", """
WITH n AS (SELECT subject_id, raw_name AS name FROM unknown_rows),
c AS (SELECT subject_id, raw_name AS name FROM matched_rows WHERE shown_name IS NOT NULL
      UNION SELECT subject_id, raw_name FROM matched_rows WHERE staff_listed AND flag IS NULL AND row_no % 3 = 0
      UNION SELECT subject_id, 'X' || substr(test, 2) FROM accepted WHERE test IN ('T1', 'T2'))
SELECT n.subject_id, n.name, count(*) AS "rows" FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.subject_id = n.subject_id AND lower(trim(c.name)) = lower(trim(n.name)))
GROUP BY ALL""", ("unknown_rows", "matched_rows", "accepted"))
def coverage_gaps(spark, folder):
    rows = unknown_rows(spark, folder).select("subject_id", F.col("raw_name").alias("name"))
    m = matched(spark, folder)
    shown = m.filter(F.col("shown_name").isNotNull()).select("subject_id", F.col("raw_name").alias("name"))
    staff = m.filter(F.col("staff_listed") & F.col("flag").isNull() & (F.col("row_no") % 3 == 0)).select(
        "subject_id", F.col("raw_name").alias("name"))
    scored = accepted(spark, folder).filter(F.col("test").isin("T1", "T2")).select(
        "subject_id", F.concat(F.lit("X"), F.expr("substr(test, 2)")).alias("name"))
    return X.coverage_gaps(rows, scored, shown, staff).groupBy("subject_id", "name").agg(F.count(F.lit(1)).alias("rows"))


@query("split_no_result", "F2", """
WITH p AS (
  SELECT l_orderkey AS doc_id, CASE l_partkey % 6 WHEN 0 THEN 'Comments:' WHEN 1 THEN 'note' ELSE 'X' || (l_partkey % 6) END AS raw_name,
         CASE l_suppkey % 4 WHEN 0 THEN 'TNP' WHEN 1 THEN ' ' WHEN 2 THEN 'Test  Not Performed' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS raw_value,
         l_partkey % 6 > 1 AND l_suppkey % 4 = 3 AS is_result FROM lineitem)
SELECT doc_id, raw_name, raw_value, is_result, count(*) AS "rows" FROM p GROUP BY ALL""")
def split_no_result(spark, folder):
    p, s = F.col("l_partkey") % 6, F.col("l_suppkey") % 4
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.when(p == 0, "Comments:").when(p == 1, "note").otherwise(F.concat(F.lit("X"), p.cast("string"))).alias("raw_name"),
        F.when(s == 0, "TNP").when(s == 1, " ").when(s == 2, "Test  Not Performed").otherwise(
            F.col("l_quantity").cast("bigint").cast("string")).alias("raw_value"))
    return X.split_no_result(rows).groupBy("doc_id", "raw_name", "raw_value", "is_result").agg(F.count(F.lit(1)).alias("rows"))
