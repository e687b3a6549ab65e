"""Queries over body-composition scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawbook.operators import markers as M
from drawbook.operators import scans as S
from drawbook.operators.checks import hard_stops
from drawbook.plans.catalog.results import accepted
from drawbook.plans.catalog.scores import answers, overall_sql, scored
from drawbook.plans.registry import cte, query
from drawbook.sources import bindings as B
from drawbook.sources.tables import table

cte("raw_scans", """
SELECT subject_id, doc_id, day, CASE k WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE t END::DOUBLE AS total, CASE k WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE f END::DOUBLE AS fat,
       CASE k WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE t - f - 6 END::DOUBLE AS lean,
       CASE WHEN k = 0 THEN '' WHEN k = 1 THEN '0%' WHEN k IN (3, 4) THEN NULL ELSE (15 + doc_id % 30) || '.' || (doc_id % 10) || '%' END AS body_fat_text,
       CASE WHEN k IN (1, 5) THEN (1 + doc_id % 4)::DOUBLE END AS vat_mass, CASE WHEN k IN (2, 4) THEN NULL ELSE (60 + doc_id % 120)::DOUBLE END AS vat_area
FROM (SELECT o_custkey AS subject_id, o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS day, o_orderkey % 7 AS k, 150 + o_orderkey % 60 AS t, 30 + o_orderkey % 17 AS f FROM orders)""")
cte("scans", """
WITH p AS (SELECT *, total = 0 AND fat = 0 AND lean = 0 AND (coalesce(vat_mass, 0) <> 0 OR coalesce(vat_area, 0) <> 0) AS partial FROM raw_scans),
c AS (SELECT subject_id, doc_id, day, CASE WHEN NOT partial AND total <> -1 THEN total END AS total, CASE WHEN NOT partial AND fat <> -1 THEN fat END AS fat,
             CASE WHEN NOT partial AND lean <> -1 THEN lean END AS lean, CASE WHEN NOT partial THEN nullif(body_fat_text, '') END AS body_fat_text, vat_mass, vat_area FROM p)
SELECT *, coalesce(CAST(rtrim(body_fat_text, '%') AS DOUBLE), CASE WHEN fat + lean <> 0 THEN fat / (fat + lean) * 100 END) AS body_fat_pct,
       body_fat_text IS NULL AND fat IS NOT NULL AS computed FROM c""", ("raw_scans",))
COMPLETE = "(body_fat_pct IS NOT NULL OR (total IS NOT NULL AND fat IS NOT NULL AND lean IS NOT NULL))"
cte("scan_ends", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY day, doc_id) AS n, count(*) OVER (PARTITION BY subject_id) AS c FROM scans WHERE {COMPLETE})
SELECT a.subject_id, a.c AS complete_scans, a.day AS f_day, a.body_fat_pct AS f_fat, a.lean AS f_lean, a.vat_area AS f_vat, z.day AS l_day, z.body_fat_pct AS l_fat,
       z.lean AS l_lean, z.vat_area AS l_vat FROM r a JOIN r z ON a.subject_id = z.subject_id AND a.n = 1 AND z.n = z.c""", ("scans",))
cte("latest_draws", "SELECT subject_id, max(day) AS latest_draw FROM accepted GROUP BY subject_id", ("accepted",))


def raw_scans(spark, folder):
    key = F.col("o_orderkey")
    k, t, f = key % 7, 150 + key % 60, 30 + key % 17

    def mass(value):
        return F.when(k == 0, -1).when(k == 1, 0).otherwise(value).cast("double")

    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("subject_id"), key.alias("doc_id"), F.to_date("o_orderdate").alias("day"),
        mass(t).alias("total"), mass(f).alias("fat"), mass(t - f - 6).alias("lean"),
        F.when(k == 0, "").when(k == 1, "0%").when(~k.isin(3, 4), F.concat(
            (15 + key % 30).cast("string"), F.lit("."), (key % 10).cast("string"), F.lit("%"))).alias("body_fat_text"),
        F.when(k.isin(1, 5), (1 + key % 4).cast("double")).alias("vat_mass"),
        F.when(~k.isin(2, 4), (60 + key % 120).cast("double")).alias("vat_area"))


def scans(spark, folder):
    return S.with_body_fat(S.clear_sentinels(raw_scans(spark, folder)))


def latest_draws(spark, folder):
    return accepted(spark, folder).groupBy("subject_id").agg(F.max("day").alias("latest_draw"))


@query("clean_scans", "C9 C17 C18", "SELECT * FROM scans", ("scans",))
def clean_scans(spark, folder):
    return scans(spark, folder)


def _band(expr, sex):
    if sex == "female":
        return (f"CASE WHEN {expr} < 0 THEN NULL WHEN {expr} < 10 THEN 20 WHEN {expr} < 14 THEN 75 WHEN {expr} < 25 THEN 96 WHEN {expr} < 32 THEN 50 WHEN {expr} >= 32 THEN 20 END")
    return (f"CASE WHEN {expr} < 0 THEN NULL WHEN {expr} < 2 THEN 20 WHEN {expr} < 6 THEN 75 WHEN {expr} < 18 THEN 96 WHEN {expr} < 25 THEN 50 WHEN {expr} >= 25 THEN 20 END")


def _structure(fat, vat):
    f = f"CASE p.sex WHEN 'female' THEN {_band(fat, 'female')} WHEN 'male' THEN {_band(fat, 'male')} END"
    v = f"CASE WHEN {vat} < 100 THEN 96 WHEN {vat} < 160 THEN 50 WHEN {vat} >= 160 THEN 20 END"
    return f"(SELECT CAST(avg(x) AS DOUBLE) FROM (VALUES ({f}), ({v})) AS s(x))"


cte("structure_scores", f"""
SELECT e.subject_id, e.complete_scans, {_structure('e.l_fat', 'e.l_vat')} AS structure_now,
       CASE WHEN e.complete_scans > 1 THEN {_structure('e.f_fat', 'e.f_vat')} END AS structure_then
FROM scan_ends e LEFT JOIN people p USING (subject_id)""", ("scan_ends", "people"))


@query("score_scans", "K6", "SELECT * FROM structure_scores", ("structure_scores",))
def score_scans(spark, folder):
    return S.score_scans(scans(spark, folder), B.subjects(spark, folder))


@query("overall_with_scans", "A20 K6 K8", overall_sql("system_scores", "structure_scores"), ("system_scores", "symptoms", "structure_scores"))
def overall_with_scans(spark, folder):
    structure = S.score_scans(scans(spark, folder), B.subjects(spark, folder))
    return M.rollup_overall(M.rollup_systems(scored(spark, folder)), M.symptom_score(answers(spark, folder)), structure)


@query("scan_changes", "W8", """
WITH v AS (SELECT subject_id, count(*) AS n, first(vat_mass ORDER BY day, doc_id) AS a, first(vat_mass ORDER BY day DESC, doc_id DESC) AS z
           FROM scans WHERE vat_mass IS NOT NULL GROUP BY subject_id)
SELECT e.subject_id, e.complete_scans, CASE WHEN complete_scans > 1 THEN l_fat - f_fat END AS body_fat_delta, CASE WHEN complete_scans > 1 THEN l_lean - f_lean END AS lean_delta,
       coalesce(complete_scans > 1 AND l_fat < f_fat, FALSE) AS improved,
       CASE WHEN v.n IS NULL OR v.n < 2 THEN 'none' WHEN z < a THEN 'down' WHEN z > a THEN 'up' ELSE 'steady' END AS vat_trend
FROM scan_ends e LEFT JOIN v USING (subject_id)""", ("scan_ends", "scans"))
def scan_changes(spark, folder):
    return S.scan_changes(scans(spark, folder))


cte("paired_scans", f"""
WITH d AS (SELECT s.*, date_diff('day', l.latest_draw, s.day) AS days FROM scans s LEFT JOIN latest_draws l USING (subject_id)),
c AS (SELECT subject_id, max(days) AS current_days FROM d WHERE {COMPLETE} AND abs(days) <= 400 GROUP BY subject_id)
SELECT d.subject_id, d.doc_id, d.day, d.days, CASE WHEN c.current_days IS NULL THEN 'unpaired' WHEN d.days > c.current_days THEN 'excluded'
       WHEN d.days = c.current_days AND {COMPLETE} THEN 'current' ELSE 'history' END AS role
FROM d LEFT JOIN c USING (subject_id)""", ("scans", "latest_draws"))


@query("pair_scans", "J13", "SELECT * FROM paired_scans", ("paired_scans",))
def pair_scans(spark, folder):
    return S.pair_scans(scans(spark, folder), latest_draws(spark, folder), window=400)


@query("scan_gap", "W11", """
SELECT subject_id, l_day AS scan_day, latest_draw, date_diff('day', l_day, latest_draw) AS gap_days, date_diff('day', l_day, latest_draw) > 60 AS stale
FROM scan_ends JOIN latest_draws USING (subject_id)""", ("scan_ends", "latest_draws"))
def scan_gap(spark, folder):
    return S.scan_gap(scans(spark, folder), latest_draws(spark, folder))


@query("hard_stops", "F7", """
SELECT subject_id, 'sex_ranges_unconfirmed' AS reason FROM subjects WHERE lower(sex) IN ('f', 'female')
UNION ALL SELECT DISTINCT subject_id, 'scan_left_out' FROM paired_scans WHERE role = 'excluded'
UNION ALL SELECT o_custkey, 'no_printed_name' FROM orders GROUP BY o_custkey HAVING count(CASE WHEN o_orderkey % 7 = 0 THEN 1 END) = 0""",
       ("subjects", "paired_scans"))
def hard_stop_conditions(spark, folder):
    excluded = S.pair_scans(scans(spark, folder), latest_draws(spark, folder), window=400).filter(F.col("role") == "excluded")
    pages = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.when(F.col("o_orderkey") % 7 == 0, "name").alias("printed_name"))
    return hard_stops(B.subjects(spark, folder), excluded, pages)


# --- two reads of two pages of every scan --------------------------------------------------------------------------


def scan_reads(spark, folder):
    k = F.col("o_orderkey")
    base = table(spark, folder, "orders").select(
        k.alias("doc_id"), F.to_date("o_orderdate").alias("day"), (150 + k % 60).alias("t"), (30 + k % 17).alias("f"), (k % 5).alias("k"))
    base = base.withColumn("l", F.col("t") - F.col("f") - 6).withColumn("bf", F.floor(F.col("f") * 1000 / (F.col("f") + F.col("l"))))
    rows = base.withColumn("page", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("read_no", F.explode(F.array(F.lit(0), F.lit(1))))
    page, read, c = F.col("page"), F.col("read_no"), F.col("k")
    fat = (F.when((c == 1) & (page == 1) & (read == 1), F.col("f") + 1).when((c == 4) & (read == 1), F.col("f") + 1 + page).otherwise(F.col("f")))
    total = F.when((c == 2) & (page == 2), F.col("t") + 20).otherwise(F.col("t"))
    tenths = F.when((c == 3) & (page == 1), F.col("bf") + 10).otherwise(F.col("bf"))
    body = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" %"))
    lean = F.concat(F.col("l").cast("string"), F.when((c == 0) & (read == 1), " (e)").otherwise(" lb"))
    lean = F.when(F.col("doc_id") % 35 == 7, "n/a").otherwise(lean)

    def entry(field, text):
        return F.struct(F.lit(field).alias("field"), text.cast("string").alias("text"))

    second = F.when(F.col("doc_id") % 18 == 0, total + 3).otherwise(total)
    fields = F.array_compact(F.array(
        entry("total", total), entry("fat", fat), entry("lean", lean), entry("body_fat", F.when((c != 2) | (read == 0), body)),
        F.when(F.col("doc_id") % 9 == 0, entry("total", second))))
    out = rows.filter(~((F.col("doc_id") % 41 == 0) & (page == 2) & (read == 1))).select(
        "doc_id", "day", F.col("page").cast("bigint").alias("page"), F.col("read_no").cast("bigint").alias("read_no"), F.inline(fields))
    numbers = base.filter((F.col("k") == 1) & (F.col("doc_id") % 2 == 0)).select(
        "doc_id", F.lit(1).cast("bigint").alias("page"), F.col("f").cast("string").alias("number"))
    return out, numbers


cte("scan_reads", """
WITH b AS (SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS day, 150 + o_orderkey % 60 AS t, 30 + o_orderkey % 17 AS f, o_orderkey % 5 AS k FROM orders),
x AS (SELECT b.*, t - f - 6 AS l, CAST(floor(f * 1000 / (t - 6)) AS BIGINT) AS bf, CAST(p.page AS BIGINT) AS page, CAST(r.read_no AS BIGINT) AS read_no
      FROM b CROSS JOIN (VALUES (1), (2)) p(page) CROSS JOIN (VALUES (0), (1)) r(read_no) WHERE NOT (doc_id % 41 = 0 AND page = 2 AND read_no = 1)),
y AS (SELECT *, CASE WHEN k = 1 AND page = 1 AND read_no = 1 THEN f + 1 WHEN k = 4 AND read_no = 1 THEN f + 1 + page ELSE f END AS fat,
             CASE WHEN k = 2 AND page = 2 THEN t + 20 ELSE t END AS total, CASE WHEN k = 3 AND page = 1 THEN bf + 10 ELSE bf END AS tenths FROM x)
SELECT doc_id, day, page, read_no, 'total' AS field, CAST(total AS VARCHAR) AS text FROM y
UNION ALL SELECT doc_id, day, page, read_no, 'total', CAST(CASE WHEN doc_id % 18 = 0 THEN total + 3 ELSE total END AS VARCHAR) FROM y WHERE doc_id % 9 = 0
UNION ALL SELECT doc_id, day, page, read_no, 'fat', CAST(fat AS VARCHAR) FROM y
UNION ALL SELECT doc_id, day, page, read_no, 'lean', CASE WHEN doc_id % 35 = 7 THEN 'n/a' ELSE l || CASE WHEN k = 0 AND read_no = 1 THEN ' (e)' ELSE ' lb' END END FROM y
UNION ALL SELECT doc_id, day, page, read_no, 'body_fat', CASE WHEN k <> 2 OR read_no = 0 THEN (tenths // 10) || '.' || (tenths % 10) || ' %' END FROM y""")
cte("agreed_fields", """
WITH m AS (SELECT *, trim(replace(replace(replace(text, '(e)', ''), ' lb', ''), ' %', '')) AS num, coalesce(contains(text, '(e)'), FALSE) AS e FROM scan_reads),
r AS (SELECT doc_id, page, day, field, read_no, count(DISTINCT coalesce(try_cast(num AS DOUBLE)::VARCHAR, text)) > 1 AS ambiguous, bool_or(text IS NOT NULL AND try_cast(num AS DOUBLE) IS NULL) AS bad,
             bool_or(e AND try_cast(num AS DOUBLE) IS NOT NULL) AS e, first(num ORDER BY length(num), num) FILTER (WHERE try_cast(num AS DOUBLE) IS NOT NULL) AS num FROM m GROUP BY ALL),
p AS (SELECT doc_id, page, day, field, bool_or(ambiguous) AS ambiguous, bool_or(bad) AS bad, max(CASE WHEN read_no = 0 THEN num END) AS a_text, max(CASE WHEN read_no = 1 THEN num END) AS b_text,
             coalesce(bool_or(CASE WHEN read_no = 0 THEN e END), FALSE) AS ae, coalesce(bool_or(CASE WHEN read_no = 1 THEN e END), FALSE) AS be FROM r GROUP BY ALL),
d AS (SELECT doc_id, page, day, count(DISTINCT read_no) AS reads FROM scan_reads GROUP BY ALL),
n AS (SELECT o_orderkey AS doc_id, CAST(30 + o_orderkey % 17 AS VARCHAR) AS number FROM orders WHERE o_orderkey % 5 = 1 AND o_orderkey % 2 = 0),
t AS (SELECT p.*, d.reads, p.a_text::DOUBLE AS a_value, p.b_text::DOUBLE AS b_value, coalesce(p.a_text = n.number, FALSE) AS a_in, coalesce(p.b_text = n.number, FALSE) AS b_in
      FROM p JOIN d USING (doc_id, page, day) LEFT JOIN n ON n.doc_id = p.doc_id AND p.page = 1),
o AS (SELECT *, coalesce(a_value <> b_value AND a_in <> b_in, FALSE) AS tie FROM t),
q AS (SELECT *, CASE WHEN reads < 2 THEN 'day_in_one_read' WHEN ambiguous THEN 'ambiguous' WHEN bad THEN 'unreadable' WHEN a_value IS NULL AND b_value IS NULL THEN 'absent'
                     WHEN a_value IS NULL OR b_value IS NULL THEN 'one_read' WHEN tie THEN 'text_layer' WHEN a_value <> b_value THEN 'differ' ELSE 'agreed' END AS outcome FROM o)
SELECT doc_id, page, day, field, outcome, CASE WHEN outcome IN ('agreed', 'text_layer') THEN CASE WHEN tie AND b_in THEN b_value ELSE a_value END END AS value,
       CASE WHEN outcome = 'text_layer' THEN CASE WHEN a_in THEN a_text ELSE b_text END WHEN outcome = 'agreed' THEN CASE WHEN (length(a_text), a_text) <= (length(b_text), b_text) THEN a_text ELSE b_text END END AS text,
       CASE WHEN outcome = 'text_layer' THEN CASE WHEN a_in THEN ae ELSE be END WHEN outcome = 'agreed' THEN ae OR be END AS estimated, a_value, b_value, a_text, b_text
FROM q""", ("scan_reads",))


@query("agree_scan_fields", "A11 A12 C9", "SELECT * FROM agreed_fields", ("agreed_fields",))
def agree_scan_fields(spark, folder):
    return S.agree_fields(*scan_reads(spark, folder))


@query("settle_scan_fields", "A13 A14 A15", """
WITH a AS (SELECT doc_id, day, field, value, count(*) AS pages, first(text ORDER BY length(text), text) AS text, bool_or(estimated) AS estimated
           FROM agreed_fields WHERE value IS NOT NULL GROUP BY doc_id, day, field, value),
s AS (SELECT doc_id, day, max(CASE WHEN field = 'total' AND k = 1 THEN v END) AS st, max(CASE WHEN field = 'fat' AND k = 1 THEN v END) AS sf,
             max(CASE WHEN field = 'lean' AND k = 1 THEN v END) AS sl FROM (SELECT doc_id, day, field, count(*) AS k, max(value) AS v FROM a GROUP BY ALL) GROUP BY ALL),
b AS (SELECT a.*, CASE field WHEN 'total' THEN value - sf - sl WHEN 'fat' THEN st - sl - value WHEN 'lean' THEN st - sf - value END AS bone,
             count(*) OVER (PARTITION BY doc_id, day, field) AS n FROM a JOIN s USING (doc_id, day)),
c AS (SELECT *, coalesce(bone > 0 AND bone <= 15, FALSE) AS fits, n > 1 AND sum(CASE WHEN bone > 0 AND bone <= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, day, field) = 1 AS balanced FROM b),
d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, day, field) AS remain, max(pages) OVER (PARTITION BY doc_id, day, field) AS top FROM c WHERE NOT balanced OR fits),
e AS (SELECT *, sum(CASE WHEN pages = top THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, day, field) AS at_top FROM d),
picked AS (SELECT doc_id, day, field, value, text, estimated, CASE WHEN balanced THEN 'mass_balance' WHEN remain = 1 THEN 'agreed' ELSE 'page_vote' END AS how
           FROM e WHERE balanced OR remain = 1 OR (top >= 2 AND at_top = 1 AND pages = top)),
l AS (SELECT doc_id, day, field, value, count(DISTINCT page) AS pages, min(text) AS text FROM (
        SELECT doc_id, day, field, page, a_value AS value, a_text AS text FROM agreed_fields WHERE outcome IN ('one_read', 'differ') AND a_value IS NOT NULL
        UNION ALL SELECT doc_id, day, field, page, b_value, b_text FROM agreed_fields WHERE outcome IN ('one_read', 'differ') AND b_value IS NOT NULL) z
      WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = z.doc_id AND a.day = z.day AND a.field = z.field) GROUP BY ALL),
lt AS (SELECT *, max(pages) OVER (PARTITION BY doc_id, day, field) AS top FROM l),
lu AS (SELECT *, sum(CASE WHEN pages = top THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, day, field) AS at_top FROM lt),
decided AS (SELECT * FROM picked UNION ALL SELECT doc_id, day, field, value, text, FALSE, 'cross_page' FROM lu WHERE top >= 2 AND at_top = 1 AND pages = top),
opts AS (SELECT doc_id, day, field, value, text, estimated FROM e WHERE remain > 1 AND NOT (top >= 2 AND at_top = 1)
         UNION ALL SELECT doc_id, day, field, value, text, FALSE FROM lu WHERE NOT (top >= 2 AND at_top = 1)),
k AS (SELECT f.doc_id, f.day, f.value AS kf, m.value AS kl FROM decided f JOIN decided m ON f.doc_id = m.doc_id AND f.day = m.day AND f.field = 'fat' AND m.field = 'lean'),
conf AS (SELECT doc_id, day, field, min(value) AS value, first(text ORDER BY length(text), text) AS text, bool_or(estimated) AS estimated, 'masses_confirm' AS how
         FROM opts JOIN k USING (doc_id, day) WHERE field = 'body_fat' AND round(value, 1) = round_even(kf / (kf + kl) * 100, 1)
         GROUP BY ALL HAVING count(DISTINCT value) = 1),
done AS (SELECT * FROM decided UNION ALL SELECT * FROM conf)
SELECT * FROM done UNION ALL
SELECT DISTINCT doc_id, day, field, NULL::DOUBLE, NULL, NULL::BOOLEAN, 'withheld' FROM agreed_fields f
WHERE outcome NOT IN ('absent', 'day_in_one_read') AND NOT EXISTS (SELECT 1 FROM done x WHERE x.doc_id = f.doc_id AND x.day = f.day AND x.field = f.field)""",
       ("agreed_fields",))
def settle_scan_fields(spark, folder):
    # A scan is settled over the pages of its document, so its reads meet by document at once.
    return S.settle_fields(S.agree_fields(*scan_reads(spark, folder), by=("doc_id",)))


@query("attribute_pages", "A10", """
WITH b AS (SELECT o_orderkey // 8 AS doc_id, o_orderkey % 8 AS page, o_orderkey AS k, CAST(date_trunc('month', DATE '2020-01-01' + CAST((o_orderkey % 3) * 31 + (o_orderkey // 8) % 90 AS INTEGER)) AS DATE) AS day FROM orders),
r AS (SELECT b.*, x.read_no, CASE WHEN page = 1 AND doc_id % 3 = 0 THEN 'Someone Else' WHEN page = 0 THEN 'DOE, PAT' WHEN page = 2 AND x.read_no = 0 THEN 'Pat Doe' END AS patient_name,
             CASE WHEN page IN (6, 7) THEN NULL WHEN page = 5 THEN 50 + doc_id % 10 WHEN page = 3 AND x.read_no = 1 AND doc_id % 4 = 0 THEN 30 ELSE 40 + doc_id % 10 + k % 3 - 1 END AS age
      FROM b CROSS JOIN (VALUES (0), (1)) x(read_no)),
g0 AS (SELECT doc_id, page, count(CASE WHEN patient_name IN ('DOE, PAT', 'Pat Doe') THEN 1 END) AS named, count(CASE WHEN patient_name = 'Someone Else' THEN 1 END) AS other,
             CASE WHEN count(age) = 2 AND min(age) = max(age) THEN max(age) END AS age FROM r GROUP BY ALL),
g AS (SELECT * REPLACE (CASE WHEN (page = 4 AND doc_id % 7 = 0) OR (page = 3 AND doc_id % 5 = 0) THEN NULL ELSE age::DOUBLE END AS age) FROM g0),
p AS (SELECT *, CASE WHEN other > 0 THEN 'other' WHEN named = 2 THEN 'named' WHEN age IS NOT NULL THEN 'aged' WHEN page = 7 THEN 'blank' ELSE 'ageless' END AS kind FROM g),
m AS (SELECT doc_id, median(age) AS center, count(*) AS n FROM p WHERE kind IN ('named', 'aged') AND age IS NOT NULL GROUP BY doc_id),
w AS (SELECT p.doc_id, count(*) AS in_band FROM p JOIN m USING (doc_id) WHERE kind IN ('named', 'aged') AND abs(age - center) <= 2 GROUP BY p.doc_id),
v AS (SELECT p.*, CASE kind WHEN 'other' THEN 'other_name' WHEN 'named' THEN 'accepted_by_name' WHEN 'blank' THEN 'blank' WHEN 'aged' THEN
             CASE WHEN NOT coalesce(w.in_band, 0) * 2 > m.n THEN 'no_clear_cluster' WHEN abs(age - m.center) > 2 THEN 'age_off_center'
                  WHEN abs(age - (41 + p.doc_id % 10)) > 2 THEN 'age_off_entered' ELSE 'accepted_by_age' END END AS verdict
      FROM p LEFT JOIN m USING (doc_id) LEFT JOIN w USING (doc_id)),
good AS (SELECT DISTINCT b.doc_id, b.day FROM b JOIN v USING (doc_id, page) WHERE v.verdict IN ('accepted_by_name', 'accepted_by_age'))
SELECT v.doc_id, v.page, v.kind, v.age, coalesce(v.verdict, CASE WHEN EXISTS (SELECT 1 FROM b JOIN good USING (doc_id, day) WHERE b.doc_id = v.doc_id AND b.page = v.page)
       THEN 'accepted_by_dates' ELSE 'unconfirmed' END) AS verdict FROM v""")
def attribute_scan_pages(spark, folder):
    k = F.col("o_orderkey")
    doc, page = F.floor(k / 8), k % 8
    base = table(spark, folder, "orders").select(doc.alias("doc_id"), page.alias("page"), k.alias("k"), F.to_date(F.date_trunc("month", F.date_add(
        F.lit("2020-01-01").cast("date"), ((k % 3) * 31 + doc % 90).cast("int")))).alias("day"))
    reads = base.withColumn("read_no", F.explode(F.array(F.lit(0), F.lit(1))))
    p, d = F.col("page"), F.col("doc_id")
    name = F.when((p == 1) & (d % 3 == 0), "Someone Else").when(p == 0, "DOE, PAT").when((p == 2) & (F.col("read_no") == 0), "Pat Doe")
    age = F.when(p.isin(6, 7), None).when(p == 5, 50 + d % 10).when((p == 3) & (F.col("read_no") == 1) & (d % 4 == 0), 30).otherwise(
        40 + d % 10 + F.col("k") % 3 - 1)
    # Ages as printed: a header in one of two wordings, a scan row a year earlier; some reads add an age or print a word.
    number = lambda n: n.cast("int").cast("string")
    first = F.col("read_no") == 0
    header = F.when((p == 3) & (d % 5 == 0) & first, "forty").when(first, F.concat(F.lit("Age: "), number(age))).otherwise(F.concat(number(age), F.lit("  yrs.")))
    texts = F.array(header, number(age - 1), F.when((p == 4) & (d % 7 == 0) & first, "12 y"))
    page_reads = reads.select("doc_id", "page", name.alias("patient_name"), texts.alias("age_texts"), F.array("day").alias("days"), (p != 7).alias("has_scans"))
    expected = base.select("doc_id").distinct().select("doc_id", F.lit("doe pat").alias("expected_key"), (41 + F.col("doc_id") % 10).alias("entered_age"))
    return S.attribute_pages(page_reads, expected)
