"""Queries over printed text: names, dates, cells, ranges, flags, times."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawbook.functions import cells, dates, scoring, status, text
from drawbook.plans.registry import cte, query
from drawbook.sources.tables import table

# --- printed names: part names with the noise a document adds -----------------------------------------------------


def printed_names(spark, folder):
    name, key = F.col("p_name"), F.col("p_partkey")
    noisy = (F.when(key % 7 == 0, F.upper(name))
             .when(key % 7 == 1, F.replace(name, F.lit(" "), F.lit("  ")))
             .when(key % 7 == 2, F.replace(name, F.lit(" "), F.lit("- ")))
             .when(key % 7 == 3, F.concat(name, F.lit(" ( "), F.col("p_type"), F.lit(" )")))
             .when(key % 7 == 4, F.translate(name, "lo", "10"))
             .when(key % 7 == 5, name)
             .otherwise(F.split_part(name, F.lit(" "), F.lit(2))))
    section = F.when(key % 4 == 0, "URINALYSIS, COMPLETE").when(key % 4 == 1, "CHEMISTRY").when(
        key % 4 == 2, "Metabolic panel")
    return table(spark, folder, "part").select(
        key.alias("row_id"), noisy.alias("raw_name"), section.alias("section"),
        F.concat(F.lit("B"), F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("lab_code"),
        F.col("p_size").cast("bigint").alias("size"), F.col("p_type").alias("category"))


cte("printed_names", """
SELECT p_partkey AS row_id,
       CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '  ')
            WHEN 2 THEN replace(p_name, ' ', '- ') WHEN 3 THEN p_name || ' ( ' || p_type || ' )'
            WHEN 4 THEN translate(p_name, 'lo', '10') WHEN 5 THEN p_name ELSE split_part(p_name, ' ', 2) END AS raw_name,
       CASE p_partkey % 4 WHEN 0 THEN 'URINALYSIS, COMPLETE' WHEN 1 THEN 'CHEMISTRY' WHEN 2 THEN 'Metabolic panel' END AS section,
       'B' || split_part(p_brand, '#', 2) AS lab_code, CAST(p_size AS BIGINT) AS size, p_type AS category
FROM part""")

SQL_NAME_KEY = ("regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), "
                "'-\\s+(\\w)', '-\\1', 'g'), '\\s+\\)', ')', 'g'), '\\(\\s+', '(', 'g')")


@query("name_keys", "C1 C2", f"""
SELECT row_id, {SQL_NAME_KEY.format('raw_name')} AS name_key,
       translate({SQL_NAME_KEY.format('raw_name')}, 'i1|0', 'lllo') AS folded_key FROM printed_names""", ("printed_names",))
def name_keys(spark, folder):
    return printed_names(spark, folder).select(
        "row_id", text.name_key(F.col("raw_name")).alias("name_key"), text.folded_key(F.col("raw_name")).alias("folded_key"))


@query("clean_row_names", "C12", """
WITH n AS (SELECT row_id, lab_code,
  CASE row_id % 4 WHEN 0 THEN raw_name || ' (1) ' || lab_code WHEN 1 THEN raw_name || ' (' || lab_code || ')'
       WHEN 2 THEN raw_name || ', ' || lab_code ELSE raw_name || '(2)' END AS printed FROM printed_names),
b AS (SELECT *, trim(regexp_replace(regexp_replace(printed, '\\(\\d+\\)', '', 'g'), '\\s+', ' ', 'g')) AS bare FROM n)
SELECT row_id, printed,
       CASE WHEN ends_with(bare, ' (' || lab_code || ')') THEN left(bare, length(bare) - length(lab_code) - 3)
            WHEN ends_with(bare, '(' || lab_code || ')') THEN left(bare, length(bare) - length(lab_code) - 2)
            WHEN ends_with(bare, ' ' || lab_code) AND NOT ends_with(bare, ', ' || lab_code)
              THEN left(bare, length(bare) - length(lab_code) - 1) ELSE bare END AS cleaned
FROM b""", ("printed_names",))
def clean_row_names(spark, folder):
    raw, code, key = F.col("raw_name"), F.col("lab_code"), F.col("row_id")
    printed = (F.when(key % 4 == 0, F.concat(raw, F.lit(" (1) "), code)).when(key % 4 == 1, F.concat(raw, F.lit(" ("), code, F.lit(")")))
               .when(key % 4 == 2, F.concat(raw, F.lit(", "), code)).otherwise(F.concat(raw, F.lit("(2)"))))
    # Every code a page may print: its own and a shorter one that must not win.
    codes = F.array(F.lit("B"), code)
    return printed_names(spark, folder).select("row_id", printed.alias("printed")).join(
        printed_names(spark, folder).select("row_id", codes.alias("codes")), "row_id").select(
        "row_id", "printed", text.clean_name(F.col("printed"), F.col("codes")).alias("cleaned"))


# --- printed dates -----------------------------------------------------------------------------------------------


def printed_dates(spark, folder):
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    odd = (key % 6 == 0) & (key % 11 == 0)
    printed = (F.when(odd, F.concat(F.lit("2/30/"), F.year(day).cast("string")))
               .when(key % 6 == 0, F.date_format(day, "M/d/yyyy"))
               .when(key % 6 == 1, F.date_format(day, "M-d-yy"))
               .when(key % 6 == 2, F.concat(F.lit("Collected "), F.date_format(day, "yyyy-MM-dd")))
               .when(key % 6 == 3, F.date_format(day, "MMMM d, yyyy"))
               .when(key % 6 == 4, F.date_format(day, "MMM'.' d yyyy'.'"))
               .otherwise(F.concat(F.lit("Pending "), (key % 97).cast("string"))))
    return table(spark, folder, "orders").select(
        key.alias("doc_id"), F.col("o_custkey").alias("subject_id"), F.to_date(day).alias("day"), printed.alias("printed"))


cte("printed_dates", """
SELECT o_orderkey AS doc_id, o_custkey AS subject_id, CAST(o_orderdate AS DATE) AS day,
       CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 11 = 0 THEN '2/30/' || year(o_orderdate)
            WHEN o_orderkey % 6 = 0 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN o_orderkey % 6 = 1 THEN strftime(o_orderdate, '%-m-%-d-%y')
            WHEN o_orderkey % 6 = 2 THEN 'Collected ' || strftime(o_orderdate, '%Y-%m-%d')
            WHEN o_orderkey % 6 = 3 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN o_orderkey % 6 = 4 THEN strftime(o_orderdate, '%b. %-d %Y.')
            ELSE 'Pending ' || (o_orderkey % 97) END AS printed
FROM orders""")


@query("printed_dates", "C3 C4", """
SELECT doc_id, printed, CASE WHEN printed LIKE 'Pending%' THEN NULL ELSE year(day) END AS y,
       CASE WHEN printed LIKE 'Pending%' THEN NULL WHEN printed LIKE '2/30/%' THEN 2 ELSE month(day) END AS m,
       CASE WHEN printed LIKE 'Pending%' THEN NULL WHEN printed LIKE '2/30/%' THEN 30 ELSE day(day) END AS d,
       CASE WHEN printed LIKE 'Pending%' OR printed LIKE '2/30/%' THEN NULL ELSE day END AS valid_day,
       CASE WHEN printed LIKE 'Pending%' OR printed LIKE '2/30/%' THEN NULL ELSE strftime(day, '%m/%d/%Y') END AS shown,
       CASE WHEN printed LIKE 'Pending%' THEN lower(printed) WHEN printed LIKE '2/30/%' THEN year(day) || '-02-30'
            ELSE strftime(day, '%Y-%m-%d') END AS date_group
FROM (SELECT doc_id, printed, CASE WHEN doc_id % 6 = 1 AND year(day) < 2000 THEN CAST(day + INTERVAL 100 YEAR AS DATE) ELSE day END AS day
      FROM printed_dates)""".replace("year(day) AS y", "CAST(year(day) AS BIGINT) AS y"),
       ("printed_dates",))
def printed_dates_query(spark, folder):
    key = dates.date_key(F.col("printed"))
    return (printed_dates(spark, folder).withColumn("k", key).withColumn("valid_day", dates.valid_day(F.col("k")))
            .select("doc_id", "printed", F.col("k.y").cast("bigint").alias("y"), F.col("k.m").cast("bigint").alias("m"),
                    F.col("k.d").cast("bigint").alias("d"), "valid_day",
                    dates.display_day(F.col("valid_day")).alias("shown"),
                    dates.date_group(F.col("printed")).alias("date_group")))


@query("clock_times", "C11", """
WITH t AS (
  SELECT event_id, ts, CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%H:%M') WHEN event_id % 5 = 1 THEN strftime(ts, '%-I:%M %p')
              WHEN event_id % 5 = 2 THEN '00:01 AM' WHEN event_id % 5 = 3 THEN '25:10' ELSE 'not recorded' END AS printed
  FROM events),
m AS (SELECT *, CASE WHEN event_id % 5 <= 1 THEN CAST(hour(ts) * 60 + minute(ts) AS BIGINT) END AS minutes FROM t)
SELECT event_id, printed, minutes, starts_with(printed, '00:01') AS placeholder,
       coalesce(minutes BETWEEN 360 AND 600, FALSE) AS in_morning FROM m""")
def clock_times(spark, folder):
    ts, key = F.col("ts"), F.col("event_id")
    printed = (F.when(key % 5 == 0, F.date_format(ts, "HH:mm")).when(key % 5 == 1, F.date_format(ts, "h:mm a"))
               .when(key % 5 == 2, "00:01 AM").when(key % 5 == 3, "25:10").otherwise("not recorded"))
    rows = table(spark, folder, "events").select("event_id", printed.alias("printed"))
    minutes = dates.clock_minutes(F.col("printed"))
    return rows.select("event_id", "printed", minutes.cast("bigint").alias("minutes"),
                       dates.is_placeholder_time(F.col("printed")).alias("placeholder"),
                       dates.in_window(minutes, F.lit(6), F.lit(10)).alias("in_morning"))


# --- printed cells -----------------------------------------------------------------------------------------------


def printed_cells(spark, folder):
    key, q = F.col("l_partkey") % 12, F.col("l_quantity").cast("bigint").cast("string")
    token = (F.when(key == 0, q).when(key == 1, F.concat(q, F.lit(".5"))).when(key == 2, F.concat(F.lit("<"), q))
             .when(key == 3, F.concat(q, F.lit("H"))).when(key == 4, F.concat(F.lit(">="), q, F.lit(".2L")))
             .when(key == 5, F.when(F.col("l_suppkey") % 2 == 0, "Negative").otherwise("Positive"))
             .when(key == 6, "TNP").when(key == 7, F.concat(F.lit("0-"), q)).when(key == 8, F.concat(q, F.lit("H"), q, F.lit("L")))
             .when(key == 9, F.concat(q, F.lit(".5"), q, F.lit(".7"))).when(key == 10, "see note")
             .otherwise(F.concat(F.lit("≥"), q)))
    reference = (F.when(F.col("l_suppkey") % 7 == 0, "10 – 35 mg/dL").when(F.col("l_suppkey") % 7 == 1, "≤ 30")
                 .when(F.col("l_suppkey") % 7 == 2, "> 20").when(F.col("l_suppkey") % 7 == 3, "")
                 .when(F.col("l_suppkey") % 7 == 4, "> OR = 25").when(F.col("l_suppkey") % 7 == 5, "see  Table")
                 .otherwise("0-5"))
    role = F.when(F.col("l_suppkey") % 3 == 0, "in_range").when(F.col("l_suppkey") % 3 == 1, "out_of_range")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey",
        token.alias("token"), reference.alias("reference"), role.alias("role"),
        F.when(F.col("l_returnflag") == "R", "H").when(F.col("l_returnflag") == "A", "L").alias("flag"))


cte("printed_cells", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
  CASE l_partkey % 12 WHEN 0 THEN q WHEN 1 THEN q || '.5' WHEN 2 THEN '<' || q WHEN 3 THEN q || 'H' WHEN 4 THEN '>=' || q || '.2L'
       WHEN 5 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'Negative' ELSE 'Positive' END WHEN 6 THEN 'TNP' WHEN 7 THEN '0-' || q
       WHEN 8 THEN q || 'H' || q || 'L' WHEN 9 THEN q || '.5' || q || '.7' WHEN 10 THEN 'see note' ELSE '≥' || q END AS token,
  CASE l_suppkey % 7 WHEN 0 THEN '10 – 35 mg/dL' WHEN 1 THEN '≤ 30' WHEN 2 THEN '> 20' WHEN 3 THEN '' WHEN 4 THEN '> OR = 25'
       WHEN 5 THEN 'see  Table' ELSE '0-5' END AS reference,
  CASE l_suppkey % 3 WHEN 0 THEN 'in_range' WHEN 1 THEN 'out_of_range' END AS role,
  CASE l_returnflag WHEN 'R' THEN 'H' WHEN 'A' THEN 'L' END AS flag, CAST(l_quantity AS BIGINT) AS n
FROM (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q FROM lineitem)""")


@query("cell_grammar", "C5 C10 C31 K4", """
SELECT token, count(*) AS cells,
       any_value(CASE l_partkey % 12 WHEN 6 THEN 'not_performed' WHEN 8 THEN token WHEN 9 THEN token WHEN 10 THEN token ELSE 'final' END) AS status,
       any_value(CASE l_partkey % 12 WHEN 0 THEN CAST(n AS DOUBLE) WHEN 1 THEN n + 0.5::DOUBLE WHEN 3 THEN CAST(n AS DOUBLE) END) AS value,
       any_value(CASE l_partkey % 12 WHEN 3 THEN rtrim(token, 'H') WHEN 4 THEN rtrim(token, 'L') WHEN 6 THEN '' ELSE token END) AS disp,
       any_value(l_partkey % 12 IN (2, 4, 11)) AS censored,
       any_value(CASE WHEN l_partkey % 12 = 5 THEN token = 'Negative' END) AS good,
       any_value(CASE WHEN l_partkey % 12 = 5 THEN CASE WHEN token = 'Negative' THEN 96 ELSE 55 END END) AS pct,
       any_value(CASE WHEN l_partkey % 12 = 5 THEN CASE WHEN token = 'Negative' THEN 'optimal' ELSE 'moderate' END END) AS tier
FROM printed_cells GROUP BY token""", ("printed_cells",))
def cell_grammar(spark, folder):
    per = printed_cells(spark, folder).groupBy("token").agg(F.count(F.lit(1)).alias("cells"))
    result = per.withColumn("r", cells.cell_result(F.col("token")))
    word = F.lower("token").isin("negative", "positive")
    good = F.when(word, cells.is_good(F.col("r.disp")))
    return result.select("token", "cells", F.col("r.status").alias("status"), F.col("r.value").alias("value"),
                         F.col("r.disp").alias("disp"), cells.is_censored(F.col("r.disp"), F.col("r.value")).alias("censored"),
                         good.alias("good"), scoring.categorical_pct(good).alias("pct"), scoring.categorical_tier(good).alias("tier"))


@query("split_cells", "C6", """
SELECT token, l_orderkey, l_linenumber, l_partkey,
       CASE l_partkey % 12 WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 10 THEN NULL
            WHEN 8 THEN n || 'H|' || n || 'L' WHEN 9 THEN n || '.5' || n || '|.7' ELSE token END AS pieces,
       l_partkey % 12 = 9 AS ambiguous
FROM printed_cells""", ("printed_cells",))
def split_cells(spark, folder):
    s = cells.split_cell(F.col("token"))
    return printed_cells(spark, folder).select(
        "token", "l_orderkey", "l_linenumber", "l_partkey", F.array_join(s["pieces"], "|").alias("pieces"),
        s["ambiguous"].alias("ambiguous"))


@query("range_texts", "C7 C8", """
WITH r AS (SELECT l_suppkey % 7 AS form, l_partkey % 12 AS kind, reference, token, any_value(n) AS n FROM printed_cells GROUP BY ALL),
t AS (SELECT *, CASE WHEN kind = 7 THEN token ELSE reference END AS printed FROM r)
SELECT printed, count(*) AS forms,
       any_value(CASE WHEN kind = 7 THEN CAST(0 AS DOUBLE) WHEN form = 0 THEN CAST(10 AS DOUBLE) WHEN form = 6 THEN CAST(0 AS DOUBLE) END) AS lo,
       any_value(CASE WHEN kind = 7 THEN CAST(n AS DOUBLE) WHEN form = 0 THEN CAST(35 AS DOUBLE) WHEN form = 6 THEN CAST(5 AS DOUBLE) END) AS hi,
       any_value(CASE WHEN kind = 7 THEN '0.0,' || n || '.0' ELSE CASE form WHEN 0 THEN '10.0,35.0' WHEN 1 THEN '30.0' WHEN 2 THEN '20.0'
            WHEN 4 THEN '25.0' WHEN 6 THEN '0.0,5.0' ELSE '' END END) AS numbers,
       any_value(CASE WHEN kind = 7 THEN CAST(n AS DOUBLE) ELSE CASE form WHEN 0 THEN 35 WHEN 1 THEN 30 WHEN 2 THEN 20 WHEN 4 THEN 25 WHEN 6 THEN 5 END::DOUBLE END) AS reference,
       any_value(CASE WHEN kind = 7 THEN token ELSE CASE form WHEN 0 THEN '10-35 mg/dl' WHEN 1 THEN '<=30' WHEN 2 THEN '>20' WHEN 3 THEN ''
            WHEN 4 THEN '>=25' WHEN 5 THEN 'see table' ELSE '0-5' END END) AS canonical
FROM t GROUP BY printed""", ("printed_cells",))
def range_texts(spark, folder):
    base = printed_cells(spark, folder).select(
        (F.col("l_suppkey") % 7).alias("form"), (F.col("l_partkey") % 12).alias("kind"), "reference", "token").distinct()
    printed = F.when(F.col("kind") == 7, F.col("token")).otherwise(F.col("reference"))
    per = base.groupBy(printed.alias("printed")).agg(F.count(F.lit(1)).alias("forms"))
    parsed = cells.parse_range(F.col("printed"))
    return per.select("printed", "forms", parsed["lo"].alias("lo"), parsed["hi"].alias("hi"),
                      cells.range_numbers(F.col("printed")).alias("numbers"),
                      cells.range_reference(F.col("printed")).alias("reference"),
                      cells.canonical_range(F.col("printed")).alias("canonical"))


@query("text_results", "C15", """
SELECT l_orderkey, l_linenumber, l_partkey, token, reference,
       l_partkey % 12 IN (5, 6) OR (l_partkey % 12 = 7 AND token <> CASE l_suppkey % 7 WHEN 6 THEN '0-5' ELSE '' END) AS is_text
FROM printed_cells""", ("printed_cells",))
def text_results(spark, folder):
    return printed_cells(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", "token", "reference",
        cells.is_text_result(F.col("token"), F.col("reference")).alias("is_text"))


@query("flag_consistency", "C16", """
WITH c AS (
  SELECT *, CASE l_suppkey % 7 WHEN 0 THEN 10.0::DOUBLE WHEN 2 THEN 20 WHEN 4 THEN 25 WHEN 6 THEN 0 END AS low,
         CASE l_suppkey % 7 WHEN 0 THEN 35.0::DOUBLE WHEN 1 THEN 30 WHEN 6 THEN 5 END AS high,
         l_suppkey % 7 <> 2 AS closed,
         CASE l_partkey % 12 WHEN 0 THEN n::DOUBLE WHEN 1 THEN n + 0.5::DOUBLE WHEN 2 THEN n WHEN 3 THEN n WHEN 4 THEN n + 0.2::DOUBLE WHEN 11 THEN n END AS num,
         CASE l_partkey % 12 WHEN 2 THEN '<' WHEN 4 THEN '>=' WHEN 11 THEN '≥' END AS op,
         CASE l_partkey % 12 WHEN 3 THEN 'H' WHEN 4 THEN 'L' END AS glued
  FROM printed_cells),
e AS (
  SELECT *, coalesce(num < low OR (num = low AND (NOT closed OR op = '<')), FALSE) AS under,
         coalesce(num > high OR (num = high AND NOT closed), FALSE) AS over_it FROM c),
x AS (
  SELECT *, CASE WHEN op = '<' THEN CASE WHEN under THEN 'L' END WHEN op IS NOT NULL THEN CASE WHEN over_it THEN 'H' END
                 WHEN under THEN 'L' WHEN over_it THEN 'H' END AS expected FROM e),
v AS (
  SELECT *, op IS NULL AND (
      (flag = 'H' AND l_suppkey % 7 = 2 AND num > 20) OR (flag = 'H' AND l_suppkey % 7 = 4 AND num >= 25)
      OR (flag = 'L' AND l_suppkey % 7 = 1 AND num <= 30)
      OR (flag IS NULL AND expected IS NOT NULL AND role = 'out_of_range')) AS banded FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, token, flag, reference, role,
       CASE WHEN num IS NULL THEN TRUE WHEN glued IS NOT NULL AND glued IS DISTINCT FROM flag THEN FALSE
            WHEN l_suppkey % 7 IN (3, 5) THEN TRUE
            WHEN op IS NULL OR expected IS NOT NULL THEN flag IS NOT DISTINCT FROM expected OR coalesce(banded, FALSE)
            ELSE flag IS NULL END AS consistent
FROM v""", ("printed_cells",))
def flag_consistency(spark, folder):
    return cells.with_flag_consistent(printed_cells(spark, folder), "token", "flag", "reference", "role")


@query("flags_and_units", "C13 C14", """
WITH f AS (
  SELECT CASE l_returnflag WHEN 'R' THEN CASE WHEN l_partkey % 3 = 0 THEN 'HIGH' WHEN l_partkey % 3 = 1 THEN 'h' ELSE 'HH' END
              WHEN 'A' THEN CASE WHEN l_partkey % 2 = 0 THEN 'Low ' ELSE 'LL' END ELSE '*' END AS printed_flag,
         CASE l_suppkey % 5 WHEN 0 THEN 'mg/dL' WHEN 1 THEN 'µg / L' WHEN 2 THEN 'μg/L' WHEN 3 THEN '10^3/uL' ELSE '' END AS printed_unit
  FROM lineitem)
SELECT printed_flag, printed_unit, count(*) AS cells,
       CASE upper(trim(printed_flag)) WHEN 'HIGH' THEN 'H' WHEN 'H' THEN 'H' WHEN 'HH' THEN 'HH' WHEN 'LOW' THEN 'L' WHEN 'LL' THEN 'LL' END AS flag,
       CASE upper(trim(printed_flag)) WHEN 'HIGH' THEN 'High' WHEN 'H' THEN 'High' WHEN 'HH' THEN 'Critical high' WHEN 'LOW' THEN 'Low'
            WHEN 'LL' THEN 'Critical low' END AS flag_word,
       CASE printed_unit WHEN 'mg/dL' THEN 'mg/dl' WHEN 'µg / L' THEN 'ug/l' WHEN 'μg/L' THEN 'ug/l' WHEN '10^3/uL' THEN '103/ul' ELSE '' END AS unit_key,
       CASE WHEN printed_unit = '' THEN '' ELSE 'mg/dL' END AS shown_unit
FROM f GROUP BY printed_flag, printed_unit""")
def flags_and_units(spark, folder):
    part, r = F.col("l_partkey"), F.col("l_returnflag")
    printed = (F.when(r == "R", F.when(part % 3 == 0, "HIGH").when(part % 3 == 1, "h").otherwise("HH"))
               .when(r == "A", F.when(part % 2 == 0, "Low ").otherwise("LL")).otherwise("*"))
    s = F.col("l_suppkey") % 5
    unit = F.when(s == 0, "mg/dL").when(s == 1, "µg / L").when(s == 2, "μg/L").when(s == 3, "10^3/uL").otherwise("")
    per = table(spark, folder, "lineitem").groupBy(printed.alias("printed_flag"), unit.alias("printed_unit")).agg(
        F.count(F.lit(1)).alias("cells"))
    flag = text.flag(F.col("printed_flag"))
    return per.select("printed_flag", "printed_unit", "cells", flag.alias("flag"), text.flag_word(flag).alias("flag_word"),
                      text.unit_key(F.col("printed_unit")).alias("unit_key"),
                      text.shown_unit(F.lit("mg/dL"), F.col("printed_unit")).alias("shown_unit"))


# --- notes and published text --------------------------------------------------------------------------------------

_STATEMENTS = ["Patient is on TRT since spring.", "Not on TRT at this time.", "Post-menopausal, started BHRT.",
               "Premenopausal; discussed hormone replacement.", "Testosterone therapy is active; no longer on TRT.",
               "Starting testosterone replacement therapy next week.", "Sleep and energy reviewed — no change."]


@query("stated_status", "C21", f"""
WITH n AS (SELECT c_custkey, ([{', '.join("'" + s + "'" for s in _STATEMENTS)}])[1 + c_custkey % 7] || ' ' || c_name AS note,
                  c_custkey % 4 = 0 AS has_section, CASE c_custkey % 8 WHEN 0 THEN TRUE END AS section_trt FROM customer),
s AS (SELECT *, CASE WHEN c_custkey % 7 = 2 THEN TRUE END AS bhrt, CASE WHEN c_custkey % 7 IN (0, 5) THEN TRUE END AS stated_trt FROM n)
SELECT c_custkey AS subject_id, note, bhrt, stated_trt, CASE WHEN has_section THEN section_trt ELSE stated_trt END AS on_trt,
       has_section AND coalesce(stated_trt, FALSE) AND NOT coalesce(section_trt, FALSE) AS mismatch FROM s""")
def stated_status(spark, folder):
    key = F.col("c_custkey")
    note = F.concat_ws(" ", F.get(F.array(*[F.lit(s) for s in _STATEMENTS]), (key % 7).cast("int")), F.col("c_name"))
    rows = table(spark, folder, "customer").select(
        key.alias("subject_id"), note.alias("note"), (key % 4 == 0).alias("has_section"),
        F.when(key % 8 == 0, True).alias("section_trt"))
    stated = status.stated_status(F.col("note"))
    return rows.select(
        "subject_id", "note", stated["bhrt"].alias("bhrt"), stated["on_trt"].alias("stated_trt"),
        status.resolve_status(F.col("has_section"), F.col("section_trt"), stated["on_trt"]).alias("on_trt"),
        status.status_mismatch(F.col("has_section"), F.col("section_trt"), stated["on_trt"]).alias("mismatch"))


@query("published_text", "C28", """
SELECT o_orderkey, replace(replace('Order — ' || o_orderpriority || '—done', ' — ', '; '), '—', ', ') AS clean_text,
       strftime(o_orderdate, '%B %-d, %Y') AS long_date, strftime(o_orderdate, '%m/%d/%Y') AS short_date FROM orders""")
def published_text(spark, folder):
    line = F.concat(F.lit("Order — "), F.col("o_orderpriority"), F.lit("—done"))
    return table(spark, folder, "orders").select(
        "o_orderkey", text.sanitize(line).alias("clean_text"), dates.long_date(F.col("o_orderdate")).alias("long_date"),
        dates.display_day(F.col("o_orderdate")).alias("short_date"))
