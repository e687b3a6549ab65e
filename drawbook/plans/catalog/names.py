"""Queries over printed names, people and headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawbook.operators import names as N
from drawbook.plans.catalog.texts import SQL_NAME_KEY, printed_names
from drawbook.plans.registry import cte, query, values_cte
from drawbook.sources.tables import table


def alias_dim(spark, folder):
    """Aliases per canonical test, the canonical name being an alias of itself; urine tests in their own namespace."""
    parts = table(spark, folder, "part").select("p_name").distinct()
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    serum = parts.select(
        F.col("p_name").alias("canonical"), F.lit(False).alias("is_urine"),
        F.explode(F.array_compact(F.array("p_name", F.replace("p_name", F.lit(" "), F.lit("-")),
                                          F.when(first.isin("red", "blue"), last)))).alias("alias"))
    urine = parts.filter(last.isin("ring", "rod")).select(
        F.concat(F.lit("Urinalysis — "), F.col("p_name")).alias("canonical"), F.lit(True).alias("is_urine"),
        F.explode(F.array_compact(F.array("p_name", F.when(first == "hot", last)))).alias("alias"))
    return serum.unionByName(urine)


cte("alias_dim", """
SELECT DISTINCT p_name AS canonical, FALSE AS is_urine, p_name AS alias FROM part
UNION SELECT p_name, FALSE, replace(p_name, ' ', '-') FROM part
UNION SELECT p_name, FALSE, split_part(p_name, ' ', 2) FROM part WHERE split_part(p_name, ' ', 1) IN ('red', 'blue')
UNION SELECT 'Urinalysis — ' || p_name, TRUE, p_name FROM part WHERE split_part(p_name, ' ', 2) IN ('ring', 'rod')
UNION SELECT 'Urinalysis — ' || p_name, TRUE, split_part(p_name, ' ', 2) FROM part
      WHERE split_part(p_name, ' ', 2) IN ('ring', 'rod') AND split_part(p_name, ' ', 1) = 'hot'""")
cte("resolved_names", f"""
WITH k AS (SELECT *, {SQL_NAME_KEY.format('raw_name')} AS name_key, coalesce(section LIKE 'URINALYSIS%', FALSE) AS is_urine FROM printed_names),
e AS (SELECT k.row_id, count(DISTINCT d.canonical) AS n, min(d.canonical) AS canonical
      FROM k JOIN alias_dim d ON k.name_key = d.alias AND k.is_urine = d.is_urine GROUP BY k.row_id),
f AS (SELECT k.row_id, count(DISTINCT d.canonical) AS n, min(d.canonical) AS canonical
      FROM k JOIN alias_dim d ON translate(k.name_key, 'i1|0', 'lllo') = translate(d.alias, 'i1|0', 'lllo') AND k.is_urine = d.is_urine
      GROUP BY k.row_id)
SELECT k.*, CASE WHEN e.n > 1 THEN 'ambiguous' WHEN e.n = 1 THEN 'exact' WHEN f.n = 1 THEN 'look_alike' ELSE 'none' END AS match_kind,
       CASE WHEN e.n > 1 THEN NULL WHEN e.n = 1 THEN e.canonical WHEN f.n = 1 THEN f.canonical END AS canonical
FROM k LEFT JOIN e USING (row_id) LEFT JOIN f USING (row_id)""", ("printed_names", "alias_dim"))


def resolved_names(spark, folder):
    return N.resolve_names(printed_names(spark, folder), alias_dim(spark, folder))


@query("resolve_printed_names", "J1 J2 J3 S3", "SELECT * FROM resolved_names", ("resolved_names",))
def resolve_printed_names(spark, folder):
    return resolved_names(spark, folder)


_PANEL = [("old ring", "B3", "Ring (old panel)", "Hormones"), ("old rod", "B3", "Rod (old panel)", "Hormones"),
          ("cold gear", "B7", "Gear (cold panel)", "Chemistry"), ("blue bolt", "B11", "Bolt (blue panel)", "Hormones")]
values_cte("panel_codes", ["panel_name", "panel_code", "shown_name", "shown_group"], _PANEL)


@query("panel_code_scope", "J6", """
SELECT n.row_id, n.raw_name, n.lab_code, p.shown_name, p.shown_group FROM printed_names n
LEFT JOIN panel_codes p ON lower(trim(regexp_replace(n.raw_name, '\\s+', ' ', 'g'))) = p.panel_name AND n.lab_code = p.panel_code""",
       ("printed_names", "panel_codes"))
def panel_code_scope(spark, folder):
    dim = spark.createDataFrame(_PANEL, "panel_name string, panel_code string, shown_name string, shown_group string")
    return N.resolve_panel(printed_names(spark, folder), dim).select(
        "row_id", "raw_name", "lab_code", "shown_name", "shown_group")


def sectioned_rows(spark, folder):
    """Rows of each document with a section, or none."""
    s = F.col("l_suppkey") % 5
    section = F.when(s == 0, "URINALYSIS").when(s == 1, "CHEMISTRY").when(s == 2, "LIVER PANEL").when(s == 3, "CBC")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("row_no"),
        F.concat(F.lit("X"), (F.col("l_partkey") % 4).cast("string")).alias("raw_name"), section.alias("section"),
        F.floor(F.col("l_quantity") / 10).cast("double").alias("value"),
        F.when(F.col("l_returnflag") == "R", "H").alias("flag"),
        F.when(F.col("l_discount") < 0.05, "mg/dL").alias("unit"),
        F.floor(F.col("l_quantity") / 10).cast("string").alias("disp"))


cte("sectioned_rows", """
SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS row_no, 'X' || (l_partkey % 4) AS raw_name,
       CASE l_suppkey % 5 WHEN 0 THEN 'URINALYSIS' WHEN 1 THEN 'CHEMISTRY' WHEN 2 THEN 'LIVER PANEL' WHEN 3 THEN 'CBC' END AS section,
       floor(l_quantity / 10) AS value, CASE l_returnflag WHEN 'R' THEN 'H' END AS flag,
       CASE WHEN l_discount < 0.05::DOUBLE THEN 'mg/dL' END AS unit, CAST(CAST(floor(l_quantity / 10) AS BIGINT) AS VARCHAR) AS disp
FROM lineitem""")
_SCOPED = [("x2", "URINALYSIS"), ("x2", "CHEMISTRY"), ("x2", "LIVER")]
values_cte("scoped_names", ["scoped_name", "allowed"], _SCOPED)


@query("unsectioned_rows", "F9", """
WITH t AS (SELECT DISTINCT doc_id, raw_name, value, flag FROM sectioned_rows WHERE section IS NOT NULL)
SELECT s.doc_id, s.row_no, s.raw_name, s.section, s.value, s.flag, s.unit, s.disp,
       CASE WHEN s.section IS NULL AND t.doc_id IS NOT NULL THEN 'repeat_ignored' WHEN s.section IS NULL THEN 'no_section'
            WHEN s.raw_name = 'X2' AND s.section NOT IN ('URINALYSIS', 'CHEMISTRY', 'LIVER PANEL') THEN 'scope_unclear' ELSE 'kept' END AS verdict
FROM sectioned_rows s LEFT JOIN t ON t.doc_id = s.doc_id AND t.raw_name = s.raw_name AND t.value IS NOT DISTINCT FROM s.value
     AND t.flag IS NOT DISTINCT FROM s.flag""", ("sectioned_rows",))
def unsectioned_rows(spark, folder):
    scope = spark.createDataFrame(_SCOPED, "scoped_name string, allowed string")
    return N.check_unsectioned(sectioned_rows(spark, folder), scope)


@query("missing_units", "A36", """
SELECT doc_id, raw_name, count(*) AS "rows" FROM sectioned_rows WHERE coalesce(unit, '') = '' GROUP BY doc_id, raw_name""",
       ("sectioned_rows",))
def missing_units(spark, folder):
    return N.missing_units(sectioned_rows(spark, folder))


# --- people --------------------------------------------------------------------------------------------------------


def people(spark, folder):
    """Entered and printed two-word names built from nation and segment words."""
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    customers = table(spark, folder, "customer")
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    letters = F.translate(F.col("n_nationkey").cast("string"), "0123456789", "abcdefghij")
    first = F.concat(F.lit("Na"), letters)
    last = F.initcap("c_mktsegment")
    key = F.col("c_custkey")
    entered = F.when(key % 3 == 0, F.concat_ws(" ", first, F.substring(last, 1, 1))).otherwise(F.concat_ws(" ", first, last))
    printed = (F.when(key % 4 == 0, F.upper(F.concat_ws(" ", first, last)))
               .when(key % 4 == 1, F.concat(F.upper(last), F.lit(", "), F.upper(first)))
               .when(key % 4 == 2, F.concat_ws(" ", first, last)).otherwise(F.concat_ws(" ", F.lit("Other"), last)))
    return joined.select(key.alias("subject_id"), entered.alias("entered"), printed.alias("printed"))


cte("people_names", """
WITH n AS (SELECT c_custkey AS k, 'Na' || translate(CAST(n_nationkey AS VARCHAR), '0123456789', 'abcdefghij') AS f,
                  upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS l FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT k AS subject_id, CASE WHEN k % 3 = 0 THEN f || ' ' || left(l, 1) ELSE f || ' ' || l END AS entered,
       CASE k % 4 WHEN 0 THEN upper(f || ' ' || l) WHEN 1 THEN upper(l) || ', ' || upper(f) WHEN 2 THEN f || ' ' || l ELSE 'Other ' || l END AS printed,
       f, l FROM n""")


@query("person_name_match", "J16", """
SELECT subject_id, entered, printed,
       CASE WHEN subject_id % 4 = 3 THEN 'none' WHEN subject_id % 3 = 0 THEN 'initial' ELSE 'words' END AS match
FROM people_names""", ("people_names",))
def person_name_match(spark, folder):
    return N.match_people(people(spark, folder))


_KNOWN = [("x0", "lab-reported", None), ("x1", "excluded", None), ("x2", "excluded", ["0", "1", "see note"])]


@query("known_items", "J18", """
WITH i AS (
  SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS row_no, CASE l_partkey % 2 WHEN 0 THEN ' X' ELSE 'x' END || (l_partkey % 4) AS raw_name,
         CASE l_suppkey % 2 WHEN 0 THEN 'lab-reported' ELSE 'excluded' END AS handled_as,
         CAST(CAST(floor(l_quantity / 20) AS BIGINT) AS VARCHAR) AS r1, CASE l_returnflag WHEN 'R' THEN 'SEE  NOTE:' ELSE '1' END AS r2,
         l_partkey % 4 AS k FROM lineitem)
SELECT doc_id, row_no, raw_name, handled_as, CASE WHEN k = 0 AND handled_as = 'lab-reported' THEN 'known' WHEN k = 1 AND handled_as = 'excluded' THEN 'known'
       WHEN k = 2 AND handled_as = 'excluded' AND r1 IN ('0', '1') THEN 'known' ELSE 'review' END AS decision FROM i""")
def known_items(spark, folder):
    part = F.col("l_partkey")
    name = F.concat(F.when(part % 2 == 0, " X").otherwise("x"), (part % 4).cast("string"))
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("row_no"), name.alias("raw_name"),
        F.when(F.col("l_suppkey") % 2 == 0, "lab-reported").otherwise("excluded").alias("handled_as"),
        F.array(F.floor(F.col("l_quantity") / 20).cast("string"),
                F.when(F.col("l_returnflag") == "R", "SEE  NOTE:").otherwise("1")).alias("results"))
    known = spark.createDataFrame(_KNOWN, "name string, handling string, results array<string>")
    return N.apply_allowlist(items, known).drop("results")


cte("headers", """
SELECT o_orderkey AS doc_id, o_custkey AS subject_id, CAST(o_orderdate AS DATE) AS printed_day,
       CAST(20 + o_orderkey % 5 + o_custkey % 40 AS BIGINT) AS printed_age, CASE o_orderkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS printed_sex
FROM orders""")


def headers(spark, folder):
    key, person = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, folder, "orders").select(
        key.alias("doc_id"), person.alias("subject_id"), F.to_date("o_orderdate").alias("printed_day"),
        (20 + key % 5 + person % 40).alias("printed_age"),
        F.when(key % 3 == 0, "male").when(key % 3 == 1, "female").alias("printed_sex"))


@query("header_checks", "J20", """
WITH s AS (SELECT c_custkey AS subject_id, DATE '1998-06-01' + CAST(c_custkey % 30 AS INTEGER) AS entered_day, 22 + c_custkey % 40 AS entered_age,
                  CASE c_custkey % 2 WHEN 0 THEN 'male' ELSE 'female' END AS entered_sex FROM customer),
a AS (SELECT user_id AS subject_id, min(20 + floor(value) % 9 + user_id % 40) AS lo, max(20 + floor(value) % 9 + user_id % 40) AS hi
      FROM events GROUP BY user_id),
j AS (SELECT * FROM s JOIN headers USING (subject_id) LEFT JOIN a USING (subject_id))
SELECT subject_id, doc_id, 'date' AS "rule" FROM j WHERE printed_day <> entered_day
UNION ALL SELECT subject_id, doc_id, 'age' FROM j WHERE printed_age <> entered_age
UNION ALL SELECT subject_id, doc_id, 'scan_age' FROM j WHERE abs(lo - printed_age) > 2 OR abs(hi - printed_age) > 2
UNION ALL SELECT subject_id, doc_id, 'sex' FROM j WHERE printed_sex <> entered_sex""", ("headers",))
def header_checks(spark, folder):
    key = F.col("c_custkey")
    entered = table(spark, folder, "customer").select(
        key.alias("subject_id"), F.date_add(F.lit("1998-06-01").cast("date"), (key % 30).cast("int")).alias("entered_day"),
        (22 + key % 40).alias("entered_age"), F.when(key % 2 == 0, "male").otherwise("female").alias("entered_sex"))
    scans = table(spark, folder, "events").select(
        F.col("user_id").alias("subject_id"), (20 + F.floor("value") % 9 + F.col("user_id") % 40).alias("scan_age"))
    return N.header_checks(entered, headers(spark, folder), scans, 2)


@query("threshold_coverage", "A28", """
WITH t AS (SELECT DISTINCT 'T' || (p_partkey % 12) AS test FROM part),
c AS (SELECT t.test, s.sex, u.kind, CASE u.kind WHEN 'bounded' THEN u.optimal IS NULL OR u.moderate IS NULL ELSE g.lo IS NULL END AS missing
      FROM t JOIN rules u USING (test) CROSS JOIN (VALUES ('male'), ('female')) s(sex)
      LEFT JOIN rule_ranges g ON g.test = t.test AND g.sex = s.sex)
SELECT test, max(CASE WHEN sex = 'male' THEN CASE WHEN missing THEN 'missing' ELSE kind END END) AS male,
       max(CASE WHEN sex = 'female' THEN CASE WHEN missing THEN 'missing' ELSE kind END END) AS female
FROM c GROUP BY test""", ("rules", "rule_ranges"))
def threshold_coverage(spark, folder):
    from drawbook.operators.markers import missing_threshold
    from drawbook.sources import bindings as B

    tests = table(spark, folder, "part").select(
        F.concat(F.lit("T"), (F.col("p_partkey") % 12).cast("string")).alias("test")).distinct()
    sexes = tests.join(B.rules(spark), "test").withColumn("sex", F.explode(F.array(F.lit("male"), F.lit("female"))))
    cells = sexes.join(B.rule_ranges(spark), ["test", "sex"], "left").withColumn(
        "cell", F.when(missing_threshold(), "missing").otherwise(F.col("kind")))
    return cells.groupBy("test").pivot("sex", ["male", "female"]).agg(F.first("cell"))
