"""Queries over whole printed pages: two tables a page, Current and Historical columns, ruled bands, two layouts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from drawbook.constants import NOT_PERFORMED_WORDS, QUALITATIVE_WORDS
from drawbook.functions.plan import compute_once
from drawbook.operators import tables as T
from drawbook.plans.registry import cte, query
from drawbook.sources.tables import table

ROWS, WORDS = 24, 8
_WORDS = ", ".join(f"'{w}'" for w in NOT_PERFORMED_WORDS + QUALITATIVE_WORDS)

# Every eight words of every document become a printed row: their letters are part of the name, their length decides what
# the cells print. Pages of four documents in five hold two tables of twelve rows in the columns layout, every third page with rules
# around the rows and names on two lines; those of the fifth hold one table in the accession layout.
cte("printed_words", rf"""
WITH t AS (SELECT doc_id, regexp_split_to_array(text, '[ \n]') AS l FROM documents),
g AS (SELECT doc_id, k, array_to_string(l[{WORDS} * k + 1:{WORDS} * k + {WORDS}], '') AS j FROM t, unnest(range((len(l) + {WORDS} - 1) // {WORDS})) AS u(k)),
k AS (SELECT doc_id, k, length(j) AS n, regexp_replace(lower(j), '[^a-z]', '', 'g') AS w FROM g)
SELECT doc_id, k // {ROWS} AS page, k % {ROWS} AS r, n, n % 10 AS v, w, doc_id % 5 = 4 AS acc, (k // {ROWS}) % 3 = 2 AS ruled, (k // {ROWS}) % 2 = 1 AS odd,
       make_date(2026, CAST(doc_id % 12 + 1 AS INTEGER), CAST((k // {ROWS}) % 27 + 1 AS INTEGER)) AS day FROM k""")

cte("printed_results", rf"""
WITH a AS (SELECT *, 'T' || (n % 12) || CASE WHEN w = '' OR w IN ({_WORDS}) THEN '' ELSE ' ' || w END AS name, v <> 4 AND n % 3 <> 0 AS h1, n % 4 = 0 AS h2 FROM printed_words WHERE NOT acc),
f AS (SELECT *, v NOT IN (1, 6) OR (v = 6 AND ruled) OR h1 OR h2 AS seen FROM a WHERE r < 12),
c0 AS (SELECT doc_id, page, r, name, 0 AS column_no, 'current' AS column_kind, day, CASE v WHEN 5 THEN 'digits_run_together' WHEN 6 THEN CASE WHEN NOT ruled THEN 'not_a_result' END END AS reason,
              CASE WHEN v = 1 THEN 'not_performed' WHEN v = 6 AND ruled THEN 'pending' WHEN v IN (5, 6) THEN NULL ELSE 'final' END AS status,
              CASE WHEN v IN (3, 7, 8, 9) THEN n::DOUBLE WHEN v = 4 THEN n + 0.5::DOUBLE END AS value,
              CASE v WHEN 0 THEN 'Not Detected' WHEN 2 THEN '<' || n WHEN 4 THEN n || '.5' WHEN 6 THEN CASE WHEN ruled THEN 'pending' END WHEN 1 THEN NULL WHEN 5 THEN NULL ELSE n::VARCHAR END AS disp,
              CASE WHEN v IN (3, 4, 8) THEN 'H' END AS flag, 'mg/dL' AS unit, 10::DOUBLE AS range_lo, (20 + n % 20)::DOUBLE AS range_hi FROM f WHERE seen),
c1 AS (SELECT doc_id, page, r, name, 1, 'historical', DATE '2025-02-09', CASE WHEN v = 5 AND NOT h1 THEN 'digits_run_together' END, CASE WHEN h1 OR v = 4 THEN 'final' WHEN v <> 5 THEN 'not_performed' END,
              CASE WHEN h1 OR v = 4 THEN (n + 1)::DOUBLE END, CASE WHEN h1 OR v = 4 THEN (n + 1)::VARCHAR END, CASE WHEN h1 AND n % 3 = 2 THEN 'L' END, NULL, NULL, NULL FROM f WHERE seen),
c2 AS (SELECT doc_id, page, r, name, 2, 'historical', CASE WHEN odd THEN DATE '2024-07-08' END, CASE WHEN v = 5 AND NOT h2 THEN 'digits_run_together' WHEN h2 AND NOT odd THEN 'no_date' END,
              CASE WHEN h2 AND odd THEN 'final' WHEN NOT h2 AND v <> 5 THEN 'not_performed' END, CASE WHEN h2 AND odd THEN (n + 2)::DOUBLE END, CASE WHEN h2 AND odd THEN (n + 2)::VARCHAR END,
              NULL, NULL, NULL, NULL FROM f WHERE seen AND (h2 OR odd OR v = 5)),
d0 AS (SELECT doc_id, page, r, name, 0, 'historical', DATE '2024-03-04', NULL, CASE WHEN n % 2 = 0 THEN 'final' ELSE 'not_performed' END, CASE WHEN n % 2 = 0 THEN (n + 3)::DOUBLE END,
              CASE WHEN n % 2 = 0 THEN (n + 3)::VARCHAR END, NULL, NULL, NULL, NULL FROM a WHERE r >= 12),
d1 AS (SELECT doc_id, page, r, name, 1, 'current', day, CASE WHEN n % 7 = 0 AND n % 3 <> 0 THEN 'more_than_one_result' END, CASE WHEN NOT (n % 7 = 0 AND n % 3 <> 0) THEN 'final' END,
              CASE WHEN NOT (n % 7 = 0 AND n % 3 <> 0) THEN n::DOUBLE END, CASE WHEN NOT (n % 7 = 0 AND n % 3 <> 0) THEN n::VARCHAR END, CASE WHEN n % 3 = 0 THEN 'H' END, '', 10::DOUBLE, (20 + n % 20)::DOUBLE
       FROM a WHERE r >= 12),
e AS (SELECT doc_id, page, r, 'T' || (n % 12) || CASE WHEN w = '' THEN '' ELSE ' ' || w END AS name, n, n % 4 AS v, day FROM printed_words WHERE acc AND page % 5 <> 3),
g AS (SELECT doc_id, page, r, name, CASE WHEN v <> 3 THEN 0 END, CASE WHEN v <> 3 THEN 'current' END, CASE WHEN v <> 3 THEN day END, CASE WHEN v = 3 THEN 'not_a_result' END, CASE WHEN v <> 3 THEN 'final' END,
             CASE WHEN v = 0 THEN n::DOUBLE END, CASE v WHEN 0 THEN n::VARCHAR WHEN 1 THEN 'Negative' WHEN 2 THEN '<' || n END, CASE WHEN v = 0 THEN 'H' END, CASE WHEN v <> 3 THEN 'mg/dL' END,
             CASE WHEN v <> 3 THEN 10::DOUBLE END, CASE WHEN v <> 3 THEN (20 + n % 20)::DOUBLE END FROM e),
q AS (SELECT DISTINCT doc_id, page, 0, NULL, NULL::INTEGER, NULL, NULL::DATE, 'page_without_collection_date', NULL, NULL::DOUBLE, NULL, NULL, NULL, NULL::DOUBLE, NULL::DOUBLE FROM printed_words WHERE acc AND page % 5 = 3)
SELECT *, 'LIPID PANEL' AS heading FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM d0 UNION ALL SELECT * FROM d1)
UNION ALL SELECT *, 'GENERAL CHEMISTRY' FROM (SELECT * FROM g UNION ALL SELECT * FROM q)""", ("printed_words",))


def split_texts(spark, folder):
    """The words of each document, and the numbers of its printed rows."""
    # The text is split once; inside the lambda it would be split again for every row of the document.
    base = compute_once(table(spark, folder, "documents").select("doc_id", "text"), split=F.split("text", "[ \\n]")).select("doc_id", "split")
    return base.withColumn("rows", F.sequence(F.lit(0), F.ceil(F.size("split") / WORDS).cast("int") - 1))


def page_numbers(rows):
    return F.sequence(F.lit(0), F.ceil(F.size(rows) / ROWS).cast("int") - 1)


def printed_pages(spark, folder):
    """Pages of positioned words; see the view ``printed_words``."""
    base = split_texts(spark, folder)
    groups = F.transform("rows", lambda i: F.array_join(F.slice("split", i * WORDS + 1, F.lit(WORDS)), ""))
    items = F.transform(groups, lambda w: F.struct(F.length(w).alias("n"), F.regexp_replace(F.lower(w), "[^a-z]", "").alias("w")))
    base = compute_once(base, items=items).select("doc_id", "items")
    cut = F.transform(page_numbers("items"), lambda p: F.struct(p.cast("bigint").alias("page"), F.slice("items", p * ROWS + 1, F.lit(ROWS)).alias("items")))
    # Rows are spread by page before their words are made: few tasks read the documents, and small partitions would be merged.
    base = compute_once(base, cut=cut).select("doc_id", F.inline("cut")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *T.PAGE)

    def word(x, y, text):
        x, y = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in (x, y))
        text = F.lit(text) if isinstance(text, str) else text
        return F.struct(x.alias("x0"), y.alias("y0"), (x + 4.0 * F.least(F.length(text), F.lit(12))).alias("x1"), (y + 9.0).alias("y1"), text.alias("text"))

    def fixed(x, line, said):
        out = []
        for part in said.split(" "):
            out.append(word(x, 12.0 * line, part))
            x += 4.0 * len(part) + 3
        return out

    page, ruled, odd = F.col("page"), F.col("page") % 3 == 2, F.col("page") % 2 == 1
    two = lambda x: F.lpad((x + 1).cast("string"), 2, "0")
    day = F.concat(two(F.col("doc_id") % 12), F.lit("/"), two(page % 27), F.lit("/2026"))
    short = F.concat(two(F.col("doc_id") % 12), F.lit("/"), two(page % 27), F.lit("/26"))
    top = [*fixed(40, 0, "Collected:"), word(90, 0, day), *fixed(40, 1, "Test Name"), *fixed(200, 1, "Current"), *fixed(300, 1, "Historical"), *fixed(400, 1, "Historical"), *fixed(480, 1, "Units"),
           *fixed(540, 1, "Reference Range"), word(300, 24, "02/09/2025"), word(400, 24, F.when(odd, "07/08/2024").otherwise("/")), word(408, 24, F.when(odd, "").otherwise("/")),
           *fixed(40, 3, "LIPID PANEL"), *fixed(40, 16, "Second Panel Report"), *fixed(40, 17, "Test Name"), *fixed(200, 17, "Historical 03/04/2024"), *fixed(400, 17, "In Range"),
           *fixed(480, 17, "Out Of Range"), *fixed(580, 17, "Reference Range")]
    none = F.lit("")

    def cells(item, r):
        n, t = item["n"], item["n"].cast("string")
        v, y = n % 10, 12.0 * (r + F.when(r < 12, 4).otherwise(6))
        plus = lambda k: (n + k).cast("string")
        current = (F.when(v == 0, "Not").when(v == 1, "").when(v == 2, F.concat(F.lit("<"), t)).when(v == 4, F.concat(t, F.lit(".5H"), plus(1))).when(v == 5, F.concat(F.lit("1.25"), t, F.lit(".7")))
                   .when(v == 6, "pending").when(v == 8, F.concat(t, F.lit("H"))).otherwise(t))
        name = [word(40, y, F.concat(F.lit("T"), (n % 12).cast("string"))), word(60, y + F.when(ruled, 5.0).otherwise(0.0), item["w"])]
        limits = F.concat(F.lit("10-"), (20 + n % 20).cast("string"))
        first = [word(200, y, current), word(215, y, F.when(v == 0, "Detected").otherwise(none)), word(232, y, F.when(v == 3, "H").otherwise(none)),
                 word(300, y, F.when((v == 4) | (n % 3 == 0), none).when(n % 3 == 2, F.concat(plus(1), F.lit("L"))).otherwise(plus(1))), word(400, y, F.when(n % 4 == 0, plus(2)).otherwise(none)),
                 word(480, y, "mg/dL"), word(540, y, limits)]
        both = (n % 3 == 0) | (n % 7 == 0)
        second = [word(210, y, F.when(n % 2 == 0, plus(3)).otherwise(none)), word(405, y, F.when(n % 3 != 0, t).otherwise(none)), word(485, y, F.when(both, t).otherwise(none)),
                  word(488 + 4.0 * F.length(t), y, F.when(both, "H").otherwise(none)), word(580, y, limits)]
        return F.when(r < 12, F.array(*name, *first)).otherwise(F.array(*name, *second))

    def accession_cells(item, r):
        n, t, y = item["n"], item["n"].cast("string"), 12.0 * (r + 3)
        result = F.when(n % 4 == 1, "Negative").when(n % 4 == 2, F.concat(F.lit("<"), t)).when(n % 4 == 3, "pending").otherwise(t)
        return F.array(word(40, y, F.concat(F.lit("T"), (n % 12).cast("string"))), word(60, y, item["w"]), word(200, y, result), word(203 + 4.0 * F.length(t), y, F.when(n % 4 == 0, "H").otherwise(none)),
                       *[word(x, y, p) for x, p in ((300, F.lit("10")), (311, F.lit("-")), (318, (20 + n % 20).cast("string")))], word(400, y, "mg/dL"))

    dated = page % 5 != 3
    acc_top = [*fixed(40, 0, "Acc#"), word(60, 0, F.concat(F.lit("A"), F.col("doc_id").cast("string"))), word(200, 0, F.when(dated, "Coll.").otherwise(none)), word(223, 0, F.when(dated, "Date:").otherwise(none)),
               word(246, 0, F.when(dated, short).otherwise(none)), *fixed(400, 0, "Report Status: FINAL"), *fixed(40, 1, "Test Name"), *fixed(200, 1, "Results"), *fixed(300, 1, "Reference Range"),
               *fixed(400, 1, "Units"), *fixed(40, 2, "GENERAL CHEMISTRY")]
    acc = F.col("doc_id") % 5 == 4
    words = F.when(acc, F.concat(F.array(*acc_top), F.flatten(F.transform("items", accession_cells)))).otherwise(F.concat(F.array(*top), F.flatten(F.transform("items", cells))))
    return compute_once(base, words=F.filter(words, lambda w: w["text"] != "")).select("doc_id", "page", "words")


def page_keys(spark, folder):
    """The keys of :func:`printed_pages`, without their words."""
    return split_texts(spark, folder).select("doc_id", F.explode(page_numbers("rows").cast("array<bigint>")).alias("page"))


def printed_rules(pages):
    """Rules around the rows of every third page: the edge of the names, and the whole width."""
    lines = F.array(*[F.lit(12.0 * k - 1.5) for k in (*range(3, 17), *range(18, 31))])
    return pages.filter((F.col("page") % 3 == 2) & (F.col("doc_id") % 5 != 4)).select("doc_id", "page", F.explode(lines).alias("y")).select(
        "doc_id", "page", "y", F.lit(40.0).alias("x0"), F.explode(F.array(F.lit(150.0), F.lit(640.0))).alias("x1"))


@query("printed_tables", "W16 W15 W4 J15 C32 C6 W17", """
SELECT doc_id, page, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY r) AS row_no, heading, name, column_no::BIGINT AS column_no, column_kind, day, reason, status, value, disp, flag, unit, range_lo, range_hi
FROM printed_results""", ("printed_results",))
def printed_tables(spark, folder):
    pages = printed_pages(spark, folder)
    rows = T.read_tables(pages, printed_rules(page_keys(spark, folder)))
    at = Window.partitionBy("doc_id", "page").orderBy("line_no")
    return rows.select("doc_id", "page", F.dense_rank().over(at).cast("bigint").alias("row_no"), "heading", "name", F.col("column_no").cast("bigint").alias("column_no"), "column_kind", "day", "reason", "status",
                       "value", "disp", "flag", "unit", "range_lo", "range_hi")


@query("line_roles", "W17 W15 W18", f"""
WITH p AS (SELECT doc_id, page, bool_or(acc) AS acc, bool_or(ruled) AND NOT bool_or(acc) AS ruled, count(*) AS n, count(*) FILTER (WHERE w <> '') AS named FROM printed_words GROUP BY ALL),
r(role, acc, n) AS (VALUES ('section', FALSE, 1), ('header', FALSE, 2), ('refining', FALSE, 1), ('title', FALSE, 1), ('outside', TRUE, 1), ('header', TRUE, 1), ('heading', TRUE, 1))
SELECT p.doc_id, p.page, r.role, r.n::BIGINT AS lines FROM p JOIN r ON p.acc = r.acc
UNION ALL SELECT doc_id, page, 'row', (n + CASE WHEN acc THEN 0 ELSE 1 END + CASE WHEN ruled THEN named ELSE 0 END)::BIGINT FROM p""", ("printed_words",))
def line_roles(spark, folder):
    return T.line_roles(printed_pages(spark, folder)).groupBy("doc_id", "page", "role").agg(F.count(F.lit(1)).alias("lines"))
