"""Queries over priority, change and narrative columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawbook.constants import CATEGORY_ORDER
from drawbook.operators import attention as A
from drawbook.operators import reroute as X
from drawbook.plans.catalog.reroute import draw_headers
from drawbook.plans.catalog.results import accepted
from drawbook.plans.catalog.scores import scored
from drawbook.plans.registry import cte, query, values_cte
from drawbook.sources import bindings as B
from drawbook.sources.tables import table

values_cte("category_ranks", ["category", "category_rank"], [(c, i) for i, c in enumerate(CATEGORY_ORDER)])
RETESTED = "(now_value IS NOT NULL OR now_tier IS NOT NULL OR coalesce(now_disp, '') <> '')"
TIER_NO = "CASE {0} WHEN 'flag' THEN 0 WHEN 'moderate' THEN 1 WHEN 'optimal' THEN 2 END"

cte("ranked", f"""
WITH p AS (
  SELECT s.*, c.category_rank, CAST(substr(test, 2) AS INTEGER) AS test_no,
         CASE WHEN NOT {RETESTED} THEN CASE WHEN then_tier = 'flag' THEN 0 END WHEN now_tier = 'flag' THEN 1
              WHEN now_tier = 'moderate' THEN CASE WHEN then_tier = 'optimal' OR (then_tier = 'moderate' AND now_pct < then_pct) THEN 2 ELSE 3 END END AS precedence
  FROM scored s JOIN category_ranks c USING (category))
SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY precedence, category_rank, test_no) AS place FROM p WHERE precedence IS NOT NULL""",
    ("scored", "category_ranks"))


@query("attention_ranking", "W7 T5", "SELECT subject_id, place, test, category, precedence, now_tier, then_tier FROM ranked", ("ranked",))
def attention_ranking(spark, folder):
    return A.rank_attention(scored(spark, folder)).select(
        "subject_id", "place", "test", "category", "precedence", "now_tier", "then_tier")


@query("top_attention", "T1", """
WITH s AS (SELECT subject_id, system, test, precedence, row_number() OVER (PARTITION BY subject_id, system ORDER BY place) AS system_place,
                  count(*) OVER (PARTITION BY subject_id, system) AS total FROM ranked WHERE system IS NOT NULL)
SELECT subject_id, system, system_place, test, precedence, greatest(total - 3, 0) AS more FROM s WHERE system_place <= 3""", ("ranked",))
def top_attention(spark, folder):
    return A.top_attention(A.rank_attention(scored(spark, folder)))


SIDE = """CASE WHEN now_tier IN ('moderate', 'flag') AND now_value IS NOT NULL AND coalesce(range_source, '') <> 'lab' THEN
  CASE WHEN kind = 'bounded' AND optimal IS NOT NULL AND direction = 'lower' AND now_value >= optimal THEN 'above'
       WHEN kind = 'bounded' AND optimal IS NOT NULL AND direction = 'higher' AND now_value <= optimal THEN 'below'
       WHEN kind = 'range' AND now_value < lo THEN 'below' WHEN kind = 'range' AND now_value > hi THEN 'above' END END"""
cte("moved_results", """
SELECT a.subject_id, a.test, a.day FROM accepted a JOIN fasting_only f USING (test)
LEFT JOIN draw_status s ON s.subject_id = a.subject_id AND s.day = a.day
WHERE (a.value IS NOT NULL OR a.disp <> '') AND s.status IS DISTINCT FROM 'Y'
  AND EXISTS (SELECT 1 FROM draw_status k WHERE k.subject_id = a.subject_id)""", ("accepted", "fasting_only", "draw_status"))
cte("kept_markers", f"""
WITH m AS (SELECT subject_id, test, max(day) AS moved_day FROM moved_results GROUP BY subject_id, test),
j AS (SELECT s.*, m.moved_day, CASE WHEN then_day IS NULL THEN now_day WHEN now_day IS NULL THEN then_day ELSE greatest(then_day, now_day) END AS shown_day
      FROM halved s LEFT JOIN m USING (subject_id, test))
SELECT * EXCLUDE (moved_day, shown_day), CASE WHEN shown_day IS NULL OR moved_day > shown_day THEN moved_day END AS latest_reported FROM j""",
    ("halved", "moved_results"))
# Tests whose newest results were moved: the marker keeps only its first result.
cte("halved", """
SELECT * REPLACE (CASE WHEN subject_id % 2 = 0 AND test IN ('T4', 'T5') THEN NULL ELSE now_day END AS now_day,
                  CASE WHEN subject_id % 2 = 0 AND test IN ('T4', 'T5') THEN NULL ELSE now_value END AS now_value,
                  CASE WHEN subject_id % 2 = 0 AND test IN ('T4', 'T5') THEN NULL ELSE now_disp END AS now_disp,
                  CASE WHEN subject_id % 2 = 0 AND test IN ('T4', 'T5') THEN NULL ELSE now_flag END AS now_flag,
                  CASE WHEN subject_id % 2 = 0 AND test IN ('T4', 'T5') THEN NULL ELSE now_pct END AS now_pct,
                  CASE WHEN subject_id % 2 = 0 AND test IN ('T4', 'T5') THEN NULL ELSE now_tier END AS now_tier)
FROM scored""", ("scored",))


def kept_markers(spark, folder):
    gone = (F.col("subject_id") % 2 == 0) & F.col("test").isin("T4", "T5")
    markers = scored(spark, folder)
    for name in ("now_day", "now_value", "now_disp", "now_flag", "now_pct", "now_tier"):
        markers = markers.withColumn(name, F.when(~gone, F.col(name)))
    # Only the tests of the fasting list can be moved: the others need no second pass over the results.
    results = accepted(spark, folder).filter(F.col("test").isin([test for test, _, _ in B.FASTING_ONLY]))
    rows = X.apply_fasting(results, X.draw_status(draw_headers(spark, folder)), B.fasting_only(spark))
    return A.latest_reported(markers, rows.filter("moved"))


CENSORED = "(now_value IS NULL AND regexp_matches(coalesce(now_disp, ''), '^\\s*[<>]'))"
_US = "strftime({0}, '%m/%d/%Y')"


@query("narrative_columns", "C23 C24 C25 C26", f"""
WITH t AS (
  SELECT *, coalesce(now_unit, then_unit, '') AS u, {RETESTED} AS again,
         coalesce(then_disp, '') <> '' AND then_day IS NOT NULL AS dated FROM kept_markers),
x AS (SELECT *, CASE WHEN u <> '' AND coalesce(then_disp, '') <> '' THEN then_disp || ' ' || u ELSE coalesce(then_disp, '') END AS tt,
             CASE WHEN u <> '' AND coalesce(now_disp, '') <> '' THEN now_disp || ' ' || u ELSE coalesce(now_disp, '') END AS nt FROM t)
SELECT subject_id, test, {SIDE} AS side,
  CASE WHEN unscored_reason = 'missing_threshold' THEN 'no range, no score' WHEN NOT again AND latest_reported IS NOT NULL THEN 'in the reported list'
       WHEN NOT again THEN 'no later result' WHEN {CENSORED} THEN 'a limit, no score'
       WHEN now_tier IS NULL OR now_tier = 'unscored' THEN 'listed, no score'
       WHEN now_tier = 'optimal' THEN 'Optimal' WHEN now_tier = 'moderate' THEN 'Moderate' ELSE 'Flagged' END AS chip,
  coalesce(now_flag IN ('H', 'L') AND now_tier = 'optimal', FALSE) AND NOT {CENSORED} AS flag_differs,
  CASE WHEN again THEN CASE WHEN dated THEN test || ' went from ' || tt || ' on ' || {_US.format('then_day')} || ' to ' || nt ELSE test || ' came to ' || nt END
            || ' on ' || {_US.format('now_day')} || '.' || CASE now_tier WHEN 'optimal' THEN ' Rated optimal.' WHEN 'moderate' THEN ' Rated moderate.'
                 WHEN 'flag' THEN ' Rated flagged.' ELSE '' END
       WHEN latest_reported IS NOT NULL THEN CASE WHEN dated THEN test || ' was ' || tt || ' on ' || {_US.format('then_day')} || '; its ' ELSE test || '''s ' END
            || {_US.format('latest_reported')} || ' result is in the reported list.'
       WHEN dated THEN test || ' was ' || tt || ' on ' || {_US.format('then_day')} || ', without a later result.'
       ELSE test || ' has no later result.' END AS sentence
FROM x""", ("kept_markers",))
def narrative_columns(spark, folder):
    return A.with_narrative(kept_markers(spark, folder)).select("subject_id", "test", "side", "chip", "flag_differs", "sentence")


@query("not_retested", "W10", f"""
SELECT subject_id, test, latest_reported, then_day, CASE WHEN latest_reported IS NULL THEN 'not_retested' ELSE 'lab_reported' END AS state
FROM kept_markers WHERE NOT {RETESTED} AND ((latest_reported IS NULL AND (then_value IS NOT NULL OR coalesce(then_disp, '') <> ''))
     OR latest_reported IS NOT NULL)""", ("kept_markers",))
def not_retested(spark, folder):
    markers = kept_markers(spark, folder).filter(~A.retested())
    keep = F.col("latest_reported").isNotNull() | A.had_then()
    return markers.filter(keep).select(
        "subject_id", "test", "latest_reported", "then_day",
        F.when(F.col("latest_reported").isNull(), "not_retested").otherwise("lab_reported").alias("state"))


@query("next_steps", "C24", f"""
WITH f AS (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n FROM ranked),
e AS (SELECT DISTINCT subject_id FROM scored)
SELECT e.subject_id, coalesce(f.test, 'none open') AS next_30,
       CASE WHEN f.test IS NULL THEN 'no open test' WHEN f.precedence = 0 THEN 'last result ' || {_US.format('f.then_day')}
            ELSE f.now_disp || ' on ' || {_US.format('f.now_day')} END AS next_30_sub,
       CASE WHEN f.n > 0 THEN 'repeat' ELSE 'keep' END AS next_90,
       CASE WHEN f.n > 0 THEN f.n || ' open' ELSE 'all optimal' END AS next_90_sub
FROM e LEFT JOIN f ON f.subject_id = e.subject_id AND f.place = 1""", ("ranked", "scored"))
def next_steps(spark, folder):
    return A.next_steps(scored(spark, folder))


@query("earlier_draw_results", "W9", """
SELECT subject_id, system, test, now_day, now_disp, latest_day FROM scored
WHERE system IS NOT NULL AND now_day < latest_day AND (now_value IS NOT NULL OR coalesce(now_disp, '') <> '')""", ("scored",))
def earlier_draw_results(spark, folder):
    return A.earlier_draw_results(scored(spark, folder))


@query("column_dates", "A26", f"""
SELECT subject_id,
       CASE count(DISTINCT then_day) WHEN 0 THEN '' WHEN 1 THEN {_US.format('min(then_day)')} ELSE 'Earlier' END AS earlier,
       CASE count(DISTINCT now_day) WHEN 0 THEN '' WHEN 1 THEN {_US.format('min(now_day)')} ELSE 'Latest' END AS latest
FROM scored GROUP BY subject_id""", ("scored",))
def column_dates(spark, folder):
    return A.column_dates(scored(spark, folder))


_EFFECTS = [("P0", 1, "raises", "T3"), ("P0", 2, "raises", "T10"), ("P1", 1, "lowers", "T0"), ("P1", 2, "lowers", "T2"),
            ("P2", 1, "lowers", "T5"), ("P2", 2, "raises", "T8")]
_ITEM_SYSTEMS = [("P0", "Flow"), ("P0", "Reserves"), ("P1", "Repair"), ("P2", "Fuel"), ("P2", "Pace"), ("P4", "Drive")]
values_cte("effects", ["item", "effect_no", "effect", "test"], _EFFECTS)
values_cte("item_systems", ["item", "system"], _ITEM_SYSTEMS)
cte("protocol", """
SELECT o_custkey AS subject_id, 'P' || (o_orderkey % 5) AS item,
       min(CASE o_orderkey % 4 WHEN 0 THEN 'Start' WHEN 1 THEN 'Continue' WHEN 2 THEN 'Stop' ELSE 'Adjust' END) AS action
FROM orders GROUP BY ALL""")


def protocol(spark, folder):
    key = F.col("o_orderkey")
    action = F.when(key % 4 == 0, "Start").when(key % 4 == 1, "Continue").when(key % 4 == 2, "Stop").otherwise("Adjust")
    return table(spark, folder, "orders").groupBy(
        F.col("o_custkey").alias("subject_id"), F.concat(F.lit("P"), (key % 5).cast("string")).alias("item")).agg(
        F.min(action).alias("action"))


@query("regimen_lines", "J21", f"""
WITH t AS (SELECT subject_id, test, system, {SIDE} AS side FROM scored WHERE now_tier IN ('moderate', 'flag') AND coalesce(range_source, '') <> 'lab'),
j AS (SELECT p.subject_id, p.item, p.action, e.effect_no, e.effect, e.test, t.system, t.side,
             CASE WHEN t.system IS NOT NULL AND ((e.effect = 'raises' AND t.side = 'below') OR (e.effect = 'lowers' AND t.side = 'above')) THEN 0
                  WHEN t.subject_id IS NOT NULL THEN 1 ELSE 2 END AS rank
      FROM protocol p LEFT JOIN effects e USING (item) LEFT JOIN t ON t.subject_id = p.subject_id AND t.test = e.test WHERE p.action <> 'Stop'),
b AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY rank, item, effect_no NULLS FIRST) AS n FROM j)
SELECT subject_id, rank, CASE rank WHEN 0 THEN CASE action WHEN 'Start' THEN 'Starting' WHEN 'Continue' THEN 'Continuing' ELSE 'Adjusting' END || ' ' || item
         || ' acts on ' || test || ' within ' || system || ' in the wanted direction.'
       WHEN 1 THEN 'On the list: ' || item || ', aimed at ' || test || '.' ELSE 'Nothing on the list matches.' END AS line
FROM b WHERE n = 1""", ("protocol", "effects", "scored"))
def regimen_lines(spark, folder):
    effects = spark.createDataFrame(_EFFECTS, "item string, effect_no int, effect string, test string")
    return A.regimen_lines(protocol(spark, folder), effects, scored(spark, folder))


@query("protocol_targets", "J21", """
WITH j AS (SELECT p.subject_id, p.item, r.test, r.system, row_number() OVER (PARTITION BY p.subject_id, p.item ORDER BY r.place) AS n
           FROM protocol p JOIN item_systems i USING (item) JOIN ranked r ON r.subject_id = p.subject_id AND r.system = i.system)
SELECT * FROM j WHERE n <= 3""", ("protocol", "item_systems", "ranked"))
def protocol_targets(spark, folder):
    dim = spark.createDataFrame(_ITEM_SYSTEMS, "item string, system string")
    return A.protocol_targets(protocol(spark, folder), dim, A.rank_attention(scored(spark, folder)))


_COPY = [(f"T{i}", f"Test {i} in plain words", f"Test {i} reflects one pathway" if i % 3 else None) for i in range(12)]
values_cte("copy_dim", ["test", "description", "clause"], _COPY)


@query("fixed_copy", "C30", f"""
WITH m AS (SELECT s.*, {SIDE} AS side FROM scored s)
SELECT m.subject_id, m.test, c.description, CASE WHEN then_value <> now_value AND side IS NOT NULL AND clause IS NOT NULL AND system IS NOT NULL
       THEN clause || ', now ' || side || ' the range, part of ' || system || '.' END AS explanation
FROM m LEFT JOIN copy_dim c USING (test)""", ("scored", "copy_dim"))
def fixed_copy(spark, folder):
    return A.with_copy(scored(spark, folder), spark.createDataFrame(_COPY, "test string, description string, clause string"))


@query("visible_systems", "F11 T3", """
SELECT s.subject_id, s.system, s.now_score, s.zone FROM system_scores s WHERE s.markers > 0""", ("system_scores",))
def visible_systems(spark, folder):
    from drawbook.operators.markers import rollup_systems

    return rollup_systems(scored(spark, folder)).filter(F.col("markers") > 0).select(
        "subject_id", "system", "now_score", "zone").orderBy("subject_id", "now_score", "system")


@query("draw_time_labels", "W13 A30 C11", """
WITH t AS (SELECT o_custkey AS subject_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS day,
                  CASE o_orderkey % 8 WHEN 0 THEN '00:01 AM' WHEN 1 THEN '1:30 PM' WHEN 2 THEN NULL ELSE '7:45 AM' END AS printed FROM orders),
u AS (SELECT subject_id, day, CASE WHEN count(DISTINCT printed) = 1 THEN min(printed) END AS time FROM t GROUP BY subject_id, day),
m AS (SELECT subject_id, then_day AS day FROM scored WHERE test = 'T6' AND then_day IS NOT NULL
      UNION SELECT subject_id, now_day FROM scored WHERE test = 'T6' AND now_day IS NOT NULL),
j AS (SELECT m.subject_id, m.day, u.time, coalesce(u.time = '7:45 AM' AND m.subject_id % 3 <> 0, FALSE) AS inside,
             CASE WHEN u.time IS NULL OR u.time LIKE '00:01%' THEN 'time not recorded' ELSE 'collected ' || u.time END AS said
      FROM m LEFT JOIN u USING (subject_id, day))
SELECT subject_id, count(*) AS draws, CASE WHEN bool_and(inside) THEN 'Cortisol, Total (AM)' ELSE 'Cortisol, Total' END AS label,
       first(said ORDER BY day, said) AS first_note, first(said ORDER BY day DESC, said DESC) AS last_note
FROM j GROUP BY subject_id""", ("scored",))
def draw_time_labels(spark, folder):
    from drawbook.operators.checks import unique_or_null

    key = F.col("o_orderkey") % 8
    printed = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("day"),
        F.when(key == 0, "00:01 AM").when(key == 1, "1:30 PM").when(key != 2, "7:45 AM").alias("time"))
    times = unique_or_null(printed, ["subject_id", "day"], "time").select("subject_id", "day", "time")
    markers = scored(spark, folder).filter(F.col("test") == "T6")
    days = markers.select("subject_id", F.explode(F.array_distinct(F.array_compact(F.array("then_day", "now_day")))).alias("day"))
    windows = table(spark, folder, "customer").filter(F.col("c_custkey") % 3 != 0).select(
        F.col("c_custkey").alias("subject_id"), F.lit(6).alias("from_hour"), F.lit(10).alias("to_hour"))
    return A.draw_time_labels(days.join(times, ["subject_id", "day"], "left"), windows)
