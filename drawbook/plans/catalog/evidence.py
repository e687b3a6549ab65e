"""Queries over document text."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawbook.operators import attention as A
from drawbook.functions.plan import compute_once
from drawbook.operators import evidence as V
from drawbook.plans.registry import cte, query
from drawbook.sources.tables import table

TESTS = [f"T{i}" for i in range(12)]
UNITS = {t: "mg/dL" if i % 2 == 0 else "ug/L" for i, t in enumerate(TESTS)}


def report_docs(spark, folder):
    """Documents as printed reports: header, heading and result lines made from the text, then the document's own lines."""
    d = F.col("doc_id")

    def shape(line, i):
        n, k = F.length(line), i % 9
        order = F.when((d % 4 == 3) & (i >= 9), F.lit("--")).otherwise(
            F.concat(F.lit("Order ID: A"), (d % 50).cast("string"), F.lit("-"), (i % 2).cast("string")))
        day = F.concat_ws("/", (1 + (d + i) % 12).cast("string"), (1 + n % 28).cast("string"), (2020 + i % 5).cast("string"))
        dated = F.when(d % 10 == 9, F.concat(F.lit("Current "), day, F.lit(" Previous 1/2/2019"))).otherwise(
            F.concat(F.lit("Collected: "), day, F.lit(" 7:45 AM")))
        facts = F.concat(F.lit("Fasting: "), F.get(F.array(F.lit("Y"), F.lit("N"), F.lit("Unknown"), F.lit("")), (n % 4).cast("int")),
                         F.lit(" Patient: Pat Doe DOB: 3/4/19"), (50 + d % 40).cast("string"), F.lit(" Sex: "), F.when(d % 2 == 0, "Female").otherwise("M"))
        heading = F.when((d + i) % 3 == 0, "LIPID PANEL").when((d + i) % 3 == 1, "Urine Screening Report").otherwise("Progress Summary")
        result = F.concat(F.lit("T"), (n % 12).cast("string"), F.lit(" "), F.when(i % 5 == 0, "<").otherwise(""), (n % 97).cast("string"), F.lit("."),
                          (i % 10).cast("string"), F.lit(" mg/dL"), F.when(i % 4 == 0, " H").otherwise(""), F.lit(" reference range 10-30"))
        return F.when(k == 0, order).when(k == 1, dated).when(k == 2, facts).when(k == 3, heading).when(k == 8, line).otherwise(result)

    docs = table(spark, folder, "documents")
    return compute_once(docs.select("doc_id", "text"), lines=F.concat(F.transform(F.split("text", "\n"), shape), F.split("text", "\n"))).select("doc_id", "lines")


cte("report_lines", """
SELECT doc_id, i AS line_no, raw, n, k,
  CASE k WHEN 0 THEN CASE WHEN doc_id % 4 = 3 AND i >= 9 THEN '--' ELSE 'Order ID: A' || (doc_id % 50) || '-' || (i % 2) END
         WHEN 1 THEN CASE WHEN doc_id % 10 = 9 THEN 'Current ' || us || ' Previous 1/2/2019' ELSE 'Collected: ' || us || ' 7:45 AM' END
         WHEN 2 THEN 'Fasting: ' || (['Y', 'N', 'Unknown', ''])[1 + n % 4] || ' Patient: Pat Doe DOB: 3/4/19' || (50 + doc_id % 40) || ' Sex: ' || CASE WHEN doc_id % 2 = 0 THEN 'Female' ELSE 'M' END
         WHEN 3 THEN CASE (doc_id + i) % 3 WHEN 0 THEN 'LIPID PANEL' WHEN 1 THEN 'Urine Screening Report' ELSE 'Progress Summary' END
         WHEN 8 THEN raw ELSE 'T' || (n % 12) || ' ' || CASE WHEN i % 5 = 0 THEN '<' ELSE '' END || (n % 97) || '.' || (i % 10) || ' mg/dL' || CASE WHEN i % 4 = 0 THEN ' H' ELSE '' END || ' reference range 10-30' END AS line,
  us, strftime(make_date(CAST(2020 + i % 5 AS INTEGER), CAST(1 + (doc_id + i) % 12 AS INTEGER), CAST(1 + n % 28 AS INTEGER)), '%Y-%m-%d') AS iso
FROM (SELECT *, length(raw) AS n, (1 + (doc_id + i) % 12) || '/' || (1 + length(raw) % 28) || '/' || (2020 + i % 5) AS us
      FROM (SELECT doc_id, i, i % 9 AS k, l[i + 1] AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(len(l))) AS t(i)
            UNION ALL SELECT doc_id, len(l) + i, 8, l[i + 1] FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(len(l))) AS t(i)))""")
# A prose line can mention a test only by chance; the derived lines are the only ones that do.
cte("evidence_rows", """
WITH r AS (SELECT *, 'T' || (n % 12) AS test FROM report_lines WHERE k BETWEEN 4 AND 7 AND (n % 12) % 2 = 0),
b AS (SELECT doc_id, line_no AS at, us, iso FROM report_lines WHERE k = 1),
e AS (SELECT r.doc_id, r.test, r.line_no, b.us, b.iso, r.n, r.line,
             CASE WHEN r.doc_id % 10 = 9 THEN 9 ELSE 0 END AS fallback
      FROM r JOIN b ON b.doc_id = r.doc_id AND b.at = (SELECT max(x.at) FROM b x WHERE x.doc_id = r.doc_id AND x.at <= r.line_no)),
f AS (SELECT doc_id, test, line_no, us AS printed, iso AS day FROM e WHERE fallback = 0)
SELECT doc_id, test, day, line_no, printed FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, test, day ORDER BY line_no, printed) AS c FROM f) WHERE c = 1""",
    ("report_lines",))


def evidence(spark, folder):
    return V.evidence(report_docs(spark, folder), UNITS)


@query("evidence_dates", "F1 W6", """
SELECT e.doc_id, e.test, e.day, CAST(e.line_no AS BIGINT) AS line_no, e.printed,
       CASE WHEN l.line_no % 5 = 0 THEN '<' ELSE '' END || (l.n % 97) || '.' || (l.line_no % 10) AS tokens
FROM evidence_rows e JOIN report_lines l USING (doc_id, line_no)""", ("evidence_rows", "report_lines"))
def evidence_dates(spark, folder):
    return evidence(spark, folder).select("doc_id", "test", "day", F.col("line_no").cast("bigint").alias("line_no"), "printed",
                                          F.array_join("tokens", "|").alias("tokens"))


def extracted(spark, folder):
    """What an extraction claims: most evidence rows, some with a wrong value."""
    e = evidence(spark, folder)
    value = F.get("tokens", F.lit(0))
    return e.filter(F.col("line_no") % 5 != 3).select("doc_id", "test", "day", F.when(
        F.col("doc_id") % 6 == 0, F.concat(value, F.lit("1"))).otherwise(F.replace(value, F.lit("<"), F.lit("< "))).alias("disp"),
        (F.col("line_no") % 3 != 0).alias("current"))


@query("missing_evidence", "J10", "SELECT doc_id, test, day, printed FROM evidence_rows WHERE line_no % 5 = 3", ("evidence_rows",))
def missing_evidence(spark, folder):
    return V.missing_evidence(evidence(spark, folder), extracted(spark, folder)).select("doc_id", "test", "day", "printed")


@query("value_mismatches", "J11 C22", """
SELECT e.doc_id, e.test, e.day, CASE WHEN l.line_no % 5 = 0 THEN '<' ELSE '' END || (l.n % 97) || '.' || (l.line_no % 10) || '1' AS disp
FROM evidence_rows e JOIN report_lines l USING (doc_id, line_no) WHERE e.line_no % 5 <> 3 AND e.doc_id % 6 = 0""", ("evidence_rows", "report_lines"))
def value_mismatches(spark, folder):
    return V.value_mismatches(extracted(spark, folder), evidence(spark, folder)).select("doc_id", "test", "day", "disp")


@query("unsupported_names", "J10 A34", """
WITH p AS (SELECT doc_id, 'T' || (n % 12) AS test, count(*) AS mentions FROM report_lines WHERE k BETWEEN 4 AND 7 GROUP BY ALL),
x AS (SELECT doc_id, test, bool_or(line_no % 3 <> 0) AS cur FROM evidence_rows WHERE line_no % 5 <> 3 GROUP BY ALL)
SELECT p.doc_id, p.test, p.mentions, CASE WHEN x.cur IS NULL THEN 'not_extracted' ELSE 'no_current_value' END AS "rule"
FROM p LEFT JOIN x USING (doc_id, test) WHERE x.cur IS NULL OR (p.mentions >= 2 AND NOT x.cur)""", ("report_lines", "evidence_rows"))
def unsupported_names(spark, folder):
    return V.unsupported_current(report_docs(spark, folder), extracted(spark, folder), TESTS)


@query("report_headers", "C29", """
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CASE WHEN k = 0 THEN 'A' || (doc_id % 50) || '-' || (line_no % 2) END AS order_id,
       CASE WHEN k = 1 THEN us END AS collected, CASE WHEN k = 1 THEN '7:45 AM' END AS collected_time,
       CASE WHEN k = 2 THEN (['Y', 'N', 'UNKNOWN', 'PATIENT'])[1 + n % 4] END AS fasting, CASE WHEN k = 2 THEN '3/4/19' || (50 + doc_id % 40) END AS dob,
       CASE WHEN k = 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'f' ELSE 'm' END END AS sex, CASE WHEN k = 2 THEN 'Pat Doe' END AS patient
FROM report_lines WHERE (k = 0 AND line <> '--') OR (k = 1 AND doc_id % 10 <> 9) OR k = 2""", ("report_lines",))
def report_headers(spark, folder):
    return V.extract_headers(report_docs(spark, folder)).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("report_sections", "W17 A30", """
WITH e AS (SELECT doc_id, line_no AS pos, k, us, iso, 'A' || (doc_id % 50) || '-' || (line_no % 2) AS oid FROM report_lines
           WHERE (k = 0 AND line <> '--') OR (k = 1 AND doc_id % 10 <> 9)),
g AS (SELECT *, CASE WHEN doc_id % 4 = 3 AND pos > 1 THEN us IS DISTINCT FROM lag(us) OVER (PARTITION BY doc_id ORDER BY pos) END AS fresh FROM e),
n AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS made FROM g),
s AS (SELECT *, CASE WHEN doc_id % 4 = 3 AND made > 0 THEN 'section ' || made
                     ELSE 'order A' || (doc_id % 50) || '-' || ((pos - k) % 2) END AS section FROM n)
SELECT doc_id, section, CAST(min(pos) AS BIGINT) AS first_line, count(*) AS openers, min(CASE WHEN k = 1 THEN iso END) AS day,
       count(DISTINCT CASE WHEN k = 1 THEN iso END) > 1 AS conflicting_dates FROM s GROUP BY doc_id, section""", ("report_lines",))
def report_sections(spark, folder):
    return V.sections(report_docs(spark, folder)).withColumn("first_line", F.col("first_line").cast("bigint"))


@query("headings_and_restatements", "W18 F5", """
WITH h AS (SELECT *, last_value(CASE WHEN k = 3 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS heading FROM report_lines)
SELECT doc_id, heading, coalesce(heading = 'Progress Summary', FALSE) AS restatement, count(*) AS lines, CAST(min(line_no) AS BIGINT) AS first_line
FROM h WHERE k <> 3 GROUP BY ALL""", ("report_lines",))
def headings_and_restatements(spark, folder):
    return V.headings(report_docs(spark, folder)).groupBy("doc_id", "heading", "restatement").agg(
        F.count(F.lit(1)).alias("lines"), F.min("line_no").cast("bigint").alias("first_line"))


# Reports of odd documents are looked up under the heading URINALYSIS, so this query prints it for the urine heading.
@query("attach_dates", "A29", """
WITH p AS (SELECT doc_id, line_no, k, CASE WHEN line = 'Urine Screening Report' THEN 'URINALYSIS' ELSE line END AS line FROM report_lines),
m AS (SELECT doc_id, line_no AS at FROM p WHERE k = 3 AND line = CASE WHEN doc_id % 2 = 0 THEN 'LIPID PANEL' ELSE 'URINALYSIS' END),
d AS (SELECT doc_id, line_no AS at, us FROM report_lines WHERE k = 1 AND doc_id % 10 <> 9),
j AS (SELECT doc_id, count(DISTINCT d.us) AS dates, min(d.us) AS one FROM m JOIN d USING (doc_id) WHERE d.at BETWEEN m.at - 12 AND m.at + 24 GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id)
SELECT x.doc_id, CASE WHEN x.doc_id % 2 = 0 THEN 'Lipid Panel Report' ELSE 'Urinalysis Section' END AS label, coalesce(c.n, 0) AS label_lines,
       coalesce(j.dates, 0) AS dates, CASE WHEN j.dates = 1 THEN j.one END AS printed
FROM documents x LEFT JOIN c USING (doc_id) LEFT JOIN j USING (doc_id)""", ("report_lines",))
def attach_dates(spark, folder):
    docs = report_docs(spark, folder).withColumn("lines", F.transform("lines", lambda line: F.when(line == "Urine Screening Report", "URINALYSIS").otherwise(line)))
    docs = docs.withColumn("label", F.when(F.col("doc_id") % 2 == 0, "Lipid Panel Report").otherwise("Urinalysis Section"))
    return V.attach_dates(docs).select("doc_id", "label", F.col("label_lines").cast("bigint").alias("label_lines"),
                                       F.col("dates").cast("bigint").alias("dates"), "printed")


@query("unread_pages", "A34", """
WITH f AS (SELECT doc_id, 'T' || (n % 12) AS test, min(line_no) AS pos FROM report_lines WHERE k BETWEEN 4 AND 7 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM f)
SELECT doc_id, count(*) AS names, string_agg(CASE WHEN n <= 8 THEN test END, ', ' ORDER BY n) AS first_names FROM r GROUP BY doc_id""", ("report_lines",))
def unread_pages(spark, folder):
    return V.unread_pages(report_docs(spark, folder), TESTS).withColumn("names", F.col("names").cast("bigint"))


@query("phase_ranges", "A31", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Estradiol' WHEN 1 THEN 'FSH' ELSE 'LH' END AS test,
       'Follicular phase: ' || (n_chars % 90) || '-200; Luteal: 5-9' AS phases FROM documents""")
def phase_ranges(spark, folder):
    name = F.when(F.col("doc_id") % 3 == 0, "Estradiol").when(F.col("doc_id") % 3 == 1, "Follicle Stimulating Hormone").otherwise("LH")
    docs = table(spark, folder, "documents").select("doc_id", F.concat(
        name, F.lit(" pg/mL Follicular phase: "), (F.col("n_chars") % 90).cast("string"), F.lit("-200; Luteal: 5-9. Next "), F.col("text")).alias("text"))
    return V.phase_ranges(docs, {"Estradiol": ["Estradiol"], "FSH": ["Follicle Stimulating Hormone", "FSH"], "LH": ["Luteinizing Hormone", "LH"]})


_PHRASES = ["token =", "&&&", "license", "password"]


@query("leak_guard", "F10", f"""
WITH h AS (SELECT doc_id, list_filter([{', '.join("'" + p + "'" for p in _PHRASES)}], lambda p: contains(text, p)) AS hits FROM documents)
SELECT doc_id, array_to_string(hits, '|') AS phrases FROM h WHERE len(hits) > 0""")
def leak_guard(spark, folder):
    return V.leaks(table(spark, folder, "documents"), _PHRASES)


_ITEMS = {"Omega-3 HP-D": ["omega-3 hp-d", "omega-3"], "Vitamin D-3": ["vitamin d-3", "vitamin d"], "Progesterone": ["progesterone"]}


@query("missing_protocol", "J22", """
WITH m AS (SELECT c_custkey AS subject_id, 'Omega-3 HP-D' AS item, 'daily' AS cadence FROM customer WHERE c_custkey % 3 <> 0
           UNION ALL SELECT c_custkey, 'Vitamin D-3', CASE WHEN c_custkey % 2 = 0 THEN 'weekly' ELSE 'as directed' END FROM customer
           UNION ALL SELECT c_custkey, 'Progesterone', NULL FROM customer WHERE c_custkey % 5 = 0)
SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = subject_id AND item = 'Vitamin D-3' AND o_orderpriority = '1-URGENT')""")
def missing_protocol(spark, folder):
    k = F.col("c_custkey")
    note = F.concat(F.when(k % 3 != 0, "Takes omega-3 daily. ").otherwise(""), F.lit("Vitamin D "),
                    F.when(k % 2 == 0, "weekly, plan unchanged").otherwise("as directed, plan unchanged"),
                    F.lit(" and no other supplements were mentioned at the visit. "),
                    F.when(k % 5 == 0, "Later on progesterone was discussed").otherwise("Seen by staff"))
    notes = table(spark, folder, "customer").select(k.alias("subject_id"), note.alias("text"))
    listed = table(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("subject_id"), F.lit("Vitamin D-3").alias("item"))
    return V.missing_protocol(notes, listed, _ITEMS)


# --- structured notes ----------------------------------------------------------------------------------------------


def notes(spark, folder):
    k = F.col("c_custkey")
    lines = F.array_compact(F.array(
        F.when(k % 6 == 0, "stray text"), F.lit("# Note"), F.lit("## Consultation Note"), F.concat(F.lit("Seen as "), F.col("c_name")), F.lit(""),
        F.lit("## Treatment Status"), F.concat(F.lit("- On TRT: "), F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "no").otherwise("maybe")),
        F.lit("## Patient Concerns"), F.concat(F.lit("- Low energy | Systems: Fuel, "), F.when(k % 2 == 0, "Drive").otherwise("Spirit")),
        F.lit("- Poor sleep | System: Repair"), F.lit("no bullet"),
        F.lit("## Protocol"), F.concat(F.lit("- "), F.initcap("c_mktsegment"), F.lit(" | Cadence: daily | Action: "), F.when(k % 4 == 0, "stop").otherwise("Start")),
        F.lit("## Marker Targets"), F.concat(F.lit("- T"), (k % 15).cast("string"), F.lit(": 10 - 2"), (k % 10).cast("string")),
        F.when(k % 5 == 0, "## Protocol"), F.when(k % 5 == 0, "- Second list"), F.when(k % 7 == 0, "## Odd Section"), F.when(k % 7 == 0, "- x"),
        F.lit("## Vitality Index"), F.concat(F.lit("- Sleep: "), F.when(k % 2 == 0, "Some Concern").otherwise("Fine")), F.lit("- Physical Performance: 3")))
    # Many customers are few bytes of file, so reading them is one task: they are spread before their notes are made.
    people = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    people = people.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return people.select(k.alias("subject_id"), F.array_join(lines, "\n").alias("text"))


cte("note_lines", """
WITH a AS (
  SELECT c_custkey AS k, c_name, c_mktsegment AS seg, [
    CASE WHEN c_custkey % 6 = 0 THEN 'stray text' END, '# Note', '## Consultation Note', 'Seen as ' || c_name, '', '## Treatment Status',
    '- On TRT: ' || CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE 'maybe' END, '## Patient Concerns',
    '- Low energy | Systems: Fuel, ' || CASE WHEN c_custkey % 2 = 0 THEN 'Drive' ELSE 'Spirit' END, '- Poor sleep | System: Repair', 'no bullet', '## Protocol',
    '- ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' | Cadence: daily | Action: ' || CASE WHEN c_custkey % 4 = 0 THEN 'stop' ELSE 'Start' END,
    '## Marker Targets', '- T' || (c_custkey % 15) || ': 10 - 2' || (c_custkey % 10), CASE WHEN c_custkey % 5 = 0 THEN '## Protocol' END,
    CASE WHEN c_custkey % 5 = 0 THEN '- Second list' END, CASE WHEN c_custkey % 7 = 0 THEN '## Odd Section' END, CASE WHEN c_custkey % 7 = 0 THEN '- x' END,
    '## Vitality Index', '- Sleep: ' || CASE WHEN c_custkey % 2 = 0 THEN 'Some Concern' ELSE 'Fine' END, '- Physical Performance: 3'] AS l FROM customer),
f AS (SELECT k, list_filter(l, lambda x: x IS NOT NULL) AS l FROM a)
SELECT k AS subject_id, i AS line_no, l[i] AS line FROM f, unnest(range(1, len(l) + 1)) AS t(i)""")


@query("parse_notes", "W5 T4 C21", """
WITH h AS (SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY line_no) AS block FROM note_lines),
b AS (SELECT subject_id, block, lower(substr(line, 4)) AS name, row_number() OVER (PARTITION BY subject_id, line ORDER BY block) AS seen FROM h WHERE starts_with(line, '## ')),
s AS (SELECT h.*, CASE WHEN b.name = 'odd section' THEN 'unknown' WHEN b.seen > 1 THEN 'duplicate' ELSE b.name END AS section
      FROM h LEFT JOIN b ON b.subject_id = h.subject_id AND b.block = h.block WHERE line <> ''),
r AS (SELECT *, CASE WHEN starts_with(line, '## ') THEN CASE section WHEN 'unknown' THEN 'unknown section' WHEN 'duplicate' THEN 'section appears twice' END
                     WHEN section IS NULL THEN CASE WHEN NOT starts_with(line, '# ') THEN 'text outside a section' END
                     WHEN section = 'unknown' THEN 'under an unknown section' WHEN section = 'duplicate' THEN 'under a repeated section'
                     WHEN section = 'consultation note' THEN NULL WHEN NOT starts_with(line, '- ') THEN 'expected an item'
                     WHEN line LIKE '%maybe' OR line LIKE '%Spirit' OR line LIKE '%: Fine' OR (section = 'marker targets' AND subject_id % 15 > 11) THEN 'does not fit the section' END AS reason FROM s)
SELECT subject_id, line_no, section, reason,
       CASE WHEN reason IS NULL AND starts_with(line, '- ') THEN CASE section WHEN 'patient concerns' THEN trim(split_part(substr(line, 3), '|', 1)) WHEN 'protocol' THEN trim(split_part(substr(line, 3), '|', 1))
            ELSE split_part(substr(line, 3), ':', 1) END END AS key,
       CASE WHEN reason IS NULL AND starts_with(line, '- ') THEN CASE section WHEN 'patient concerns' THEN trim(split_part(line, ':', 2)) WHEN 'protocol' THEN trim(split_part(line, 'Action:', 2))
            WHEN 'marker targets' THEN '10-2' || (subject_id % 10) ELSE trim(split_part(line, ':', 2)) END END AS value
FROM r""", ("note_lines",))
def parse_notes(spark, folder):
    return V.parse_notes(notes(spark, folder), TESTS).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("lead_concerns", "T4", """
SELECT subject_id, system, 'Low energy' AS concern FROM (SELECT c_custkey AS subject_id, unnest(['Fuel', 'Drive']) AS system FROM customer WHERE c_custkey % 2 = 0)
UNION ALL SELECT c_custkey, 'Repair', 'Poor sleep' FROM customer""")
def lead_concerns(spark, folder):
    read = V.parse_notes(notes(spark, folder), TESTS).filter((F.col("section") == "patient concerns") & F.col("key").isNotNull())
    concerns = read.select("subject_id", F.col("line_no").alias("ord"), F.col("key").alias("concern"),
                           F.transform(F.split("value", ","), lambda s: F.trim(s)).alias("systems"))
    return A.lead_concerns(concerns)
