"""Queries over positioned words."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawbook.functions.plan import compute_once
from drawbook.operators import layout as L
from drawbook.plans.registry import cte, query
from drawbook.sources.tables import table

_HEADER = ["Test", "Name", "Current", "Flag", "Units", "Reference", "Range", "Lab"]
WORDS_PER_PAGE, WORDS_PER_LINE = 304, 8

# Every word of every document, in reading order, becomes a printed word of an eight-column table: 38 lines a page,
# the first a header. Word lengths of the document choose what each cell prints.
cte("positioned", """
WITH t AS (SELECT doc_id, regexp_split_to_array(text, '[ \\n]') AS l FROM documents),
k AS (SELECT doc_id, k, length(l[k + 1]) AS n FROM t, unnest(range(len(l))) AS u(k)),
p AS (SELECT doc_id, k // 304 AS page, (k % 304) // 8 AS line_no, k % 8 AS i, n FROM k),
w AS (SELECT *, CASE WHEN line_no = 0 THEN (['Test', 'Name', 'Current', 'Flag', 'Units', 'Reference', 'Range', 'Lab'])[i + 1] ELSE CASE i
   WHEN 0 THEN 'T' || (n % 12) WHEN 1 THEN 'total' WHEN 2 THEN CASE WHEN n % 13 = 0 THEN '1.25' || n || '.7' WHEN n % 7 = 0 THEN 'Negative' WHEN n % 5 = 0 THEN '<' || n WHEN n % 4 = 0 THEN n || '.5H' WHEN n = 3 THEN 'pending' ELSE CAST(n AS VARCHAR) END
   WHEN 3 THEN CASE WHEN n % 3 = 0 THEN 'H' WHEN n % 3 = 1 THEN '' ELSE 'LOW' END WHEN 4 THEN 'mg/dL' WHEN 5 THEN '10-' || (20 + n % 20) WHEN 6 THEN '' ELSE CASE WHEN n % 4 = 0 THEN 'AMD' ELSE '' END END END AS text FROM p)
SELECT * FROM w WHERE text <> ''""")


def pages(spark, folder):
    words = F.split("text", "[ \\n]")
    base = compute_once(table(spark, folder, "documents").select("doc_id", "text"), sizes=F.transform(words, lambda w: F.length(w))).select("doc_id", "sizes")
    count = F.ceil(F.size("sizes") / WORDS_PER_PAGE).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda p: F.struct(
        p.cast("bigint").alias("page"), F.slice("sizes", p * WORDS_PER_PAGE + 1, F.lit(WORDS_PER_PAGE)).alias("sizes")))
    # Word sizes are spread by page before the words are made: few tasks read the documents, and all work on pages is by page.
    # The number is given, since partitions so small would be merged into few tasks again.
    base = compute_once(base, cut=cut).select("doc_id", F.inline("cut")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *L.PAGE)

    def word(n, j):
        line, i = F.floor(j / WORDS_PER_LINE), j % WORDS_PER_LINE
        value = (F.when(n % 13 == 0, F.concat(F.lit("1.25"), n.cast("string"), F.lit(".7"))).when(n % 7 == 0, "Negative")
                 .when(n % 5 == 0, F.concat(F.lit("<"), n.cast("string"))).when(n % 4 == 0, F.concat(n.cast("string"), F.lit(".5H")))
                 .when(n == 3, "pending").otherwise(n.cast("string")))
        cell = (F.when(i == 0, F.concat(F.lit("T"), (n % 12).cast("string"))).when(i == 1, "total").when(i == 2, value)
                .when(i == 3, F.when(n % 3 == 0, "H").when(n % 3 == 1, "").otherwise("LOW")).when(i == 4, "mg/dL")
                .when(i == 5, F.concat(F.lit("10-"), (20 + n % 20).cast("string"))).when(i == 6, "").otherwise(F.when(n % 4 == 0, "AMD").otherwise("")))
        text = F.when(line == 0, F.get(F.array(*[F.lit(h) for h in _HEADER]), i.cast("int"))).otherwise(cell)
        # Two header words of one label stand close together; everything else sits under its own label.
        x0 = 40.0 + 60.0 * i - F.when((line == 0) & i.isin(1, 6), 26.0).otherwise(0.0) + F.when(line > 0, n % 3).otherwise(0)
        y0 = 12.0 * line + ((i * 7) % 3) * 0.8
        return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + F.least(F.length(text), F.lit(8)) * 4.0).cast("double").alias("x1"),
                        (y0 + 9.0).cast("double").alias("y1"), text.alias("text"))

    return compute_once(base, words=F.filter(F.transform("sizes", word), lambda w: w["text"] != "")).select("doc_id", "page", "words")


def lines(spark, folder):
    return L.group_lines(pages(spark, folder))


@query("group_lines", "W3", """
SELECT doc_id, page, CAST(line_no AS BIGINT) AS line_no, count(*) AS words, string_agg(text, ' ' ORDER BY i) AS text FROM positioned GROUP BY ALL""", ("positioned",))
def group_lines(spark, folder):
    return lines(spark, folder).select("doc_id", "page", F.col("line_no").cast("bigint").alias("line_no"),
                                       F.size("words").cast("bigint").alias("words"), L.line_text().alias("text"))


@query("group_cells", "W4", """
WITH p AS (SELECT *, 40.0 + 60.0 * i - CASE WHEN line_no = 0 AND i IN (1, 6) THEN 26 ELSE 0 END + CASE WHEN line_no > 0 THEN n % 3 ELSE 0 END AS x0 FROM positioned),
g AS (SELECT *, lag(x0 + least(length(text), 8) * 4) OVER w AS px FROM p WINDOW w AS (PARTITION BY doc_id, page, line_no ORDER BY i)),
b AS (SELECT *, sum(CASE WHEN px IS NULL OR x0 - px > 5.4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_no ORDER BY i) AS cell FROM g),
c AS (SELECT doc_id, page, line_no, cell, string_agg(text, ' ' ORDER BY i) AS text FROM b GROUP BY ALL)
SELECT doc_id, page, CAST(line_no AS BIGINT) AS line_no, count(*) AS cells, string_agg(text, '|' ORDER BY cell) AS text FROM c GROUP BY doc_id, page, line_no""", ("positioned",))
def group_cells(spark, folder):
    return L.group_cells(lines(spark, folder)).select(
        "doc_id", "page", F.col("line_no").cast("bigint").alias("line_no"), F.size("cells").cast("bigint").alias("cells"),
        F.array_join(F.transform("cells", lambda c: c["text"]), "|").alias("text"))


@query("header_columns", "W15", """
WITH h AS (SELECT doc_id, page, max(i) AS last_i FROM positioned WHERE line_no = 0 GROUP BY ALL),
c AS (SELECT * FROM (VALUES (0, 'name', 0), (1, 'current', 2), (2, 'flag', 3), (3, 'units', 4), (4, 'range', 6), (5, 'lab', 7)) v(column_no, kind, at_word))
SELECT doc_id, page, CAST(column_no AS BIGINT) AS column_no, kind, CASE kind WHEN 'range' THEN 340.0 ELSE 40.0 + 60 * at_word END::DOUBLE AS x0,
       CASE kind WHEN 'name' THEN 74 + 16 WHEN 'current' THEN 160 + 28 WHEN 'flag' THEN 220 + 16 WHEN 'units' THEN CASE WHEN last_i = 5 THEN 340 + 32 ELSE 280 + 20 END WHEN 'range' THEN 374 + 20 ELSE 460 + 12 END::DOUBLE AS x1
FROM h JOIN c ON c.at_word <= h.last_i WHERE last_i >= 2""", ("positioned",))
def header_columns(spark, folder):
    return L.header_columns(L.page_lines(pages(spark, folder))).withColumn("column_no", F.col("column_no").cast("bigint"))


@query("assign_columns", "J14", """
WITH p AS (SELECT w.*, 40.0 + 60.0 * i + n % 3 AS x0, max(CASE WHEN line_no = 0 THEN i END) OVER (PARTITION BY doc_id, page) AS last_i FROM positioned w),
c AS (SELECT *, CASE i WHEN 0 THEN 'name' WHEN 1 THEN 'name' WHEN 2 THEN 'current' WHEN 3 THEN 'flag' WHEN 4 THEN 'units' WHEN 5 THEN 'range' ELSE 'lab' END AS kind
      FROM p WHERE line_no > 0 AND last_i = 7)
SELECT doc_id, page, kind, i, count(*) AS words FROM c GROUP BY ALL""", ("positioned",))
def assign_columns(spark, folder):
    words = L.assign_columns(L.page_lines(pages(spark, folder)))
    return words.withColumn("i", F.floor((F.col("x0") - 40) / 60)).groupBy("doc_id", "page", "kind", "i").agg(F.count(F.lit(1)).alias("words"))


@query("table_rows", "W16 F5 C5 C7 C13", """
WITH f AS (SELECT doc_id, page FROM positioned WHERE line_no = 0 GROUP BY ALL HAVING max(i) = 7),
r AS (SELECT p.doc_id, p.page, p.line_no, string_agg(CASE WHEN i IN (0, 1) THEN text END, ' ' ORDER BY i) AS name, max(CASE WHEN i = 2 THEN text END) AS token, max(CASE WHEN i = 2 THEN n END) AS n,
             max(CASE WHEN i = 3 THEN text END) AS ft, coalesce(max(CASE WHEN i = 4 THEN text END), '') AS unit, max(CASE WHEN i = 5 THEN n END) AS rn, coalesce(max(CASE WHEN i = 7 THEN text END), '') AS lab_code
      FROM positioned p JOIN f USING (doc_id, page) WHERE line_no > 0 GROUP BY ALL),
x AS (SELECT *, CASE WHEN token IS NULL THEN 'no_result' WHEN n % 13 = 0 THEN 'digits_run_together' WHEN n % 7 <> 0 AND n % 5 <> 0 AND n % 4 <> 0 AND n = 3 THEN 'not_a_result' END AS reason FROM r)
SELECT doc_id, page, CAST(line_no AS BIGINT) AS line_no, name, reason, CASE WHEN reason IS NULL THEN 'final' END AS status,
       CASE WHEN reason IS NOT NULL OR n % 7 = 0 OR n % 5 = 0 THEN NULL WHEN n % 4 = 0 THEN n + 0.5::DOUBLE ELSE n END::DOUBLE AS value,
       CASE WHEN reason IS NULL THEN rtrim(token, 'H') END AS disp, CASE WHEN token LIKE '%.5H' THEN 'H' WHEN ft = 'H' THEN 'H' WHEN ft = 'LOW' THEN 'L' END AS flag, unit, lab_code,
       CASE WHEN rn IS NOT NULL THEN 10::DOUBLE END AS range_lo, (20 + rn % 20)::DOUBLE AS range_hi
FROM x""", ("positioned",))
def table_rows(spark, folder):
    return L.rows_from_cells(L.page_lines(pages(spark, folder))).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("rule_bands", "J15", """
WITH q AS (SELECT DISTINCT doc_id, page FROM positioned)
SELECT doc_id, page, CAST(line_no // 4 AS BIGINT) AS band, count(*) AS words FROM positioned GROUP BY ALL""", ("positioned",))
def rule_bands(spark, folder):
    p = pages(spark, folder)
    rules = p.select("doc_id", "page", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i * 48.0)).alias("y"))
    return L.assign_bands(p, rules).groupBy("doc_id", "page", F.col("band").cast("bigint").alias("band")).agg(F.count(F.lit(1)).alias("words"))


@query("table_prose", "F6", """
WITH p AS (SELECT *, 40.0 + 60.0 * i - CASE WHEN line_no = 0 AND i IN (1, 6) THEN 26 ELSE 0 END + CASE WHEN line_no > 0 THEN n % 3 ELSE 0 END AS x0 FROM positioned),
g AS (SELECT *, x0 + least(length(text), 8) * 4 AS x1, lag(x0 + least(length(text), 8) * 4) OVER (PARTITION BY doc_id, page, line_no ORDER BY i) AS px FROM p)
SELECT doc_id, page, CAST(line_no AS BIGINT) AS line_no, bool_or((x0 < 181 AND 181 < x1) OR coalesce(px <= 181 AND 181 < x1 AND x0 - px >= 0 AND x0 - px < 12, FALSE)) AS prose
FROM g GROUP BY ALL""", ("positioned",))
def table_prose(spark, folder):
    return lines(spark, folder).select("doc_id", "page", F.col("line_no").cast("bigint").alias("line_no"), L.is_prose(F.lit(181.0)).alias("prose"))


@query("repair_glyphs", "C27", """
WITH g AS (SELECT DISTINCT doc_id, page FROM positioned WHERE doc_id % 3 = 0)
SELECT p.doc_id, p.page, count(CASE WHEN i = 2 AND line_no > 0 AND starts_with(text, '<') THEN 1 END) AS marked,
       CASE WHEN g.doc_id IS NULL THEN 0 ELSE count(CASE WHEN i = 2 AND line_no > 0 AND starts_with(text, '<') AND n % 3 = 0 THEN 1 END) END AS repaired
FROM positioned p LEFT JOIN g USING (doc_id, page) GROUP BY p.doc_id, p.page, g.doc_id""", ("positioned",))
def repair_glyphs(spark, folder):
    # The words printed with "<" here carry the wrong glyph instead; boxes are recorded where the word starts at x=160.
    def broken(w):
        return F.struct(w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["y1"].alias("y1"), F.regexp_replace(w["text"], "^<", "!").alias("text"))

    p = pages(spark, folder).withColumn("words", F.transform("words", broken))
    boxes = p.filter(F.col("doc_id") % 3 == 0).select("doc_id", "page", F.explode("words").alias("w")).filter(
        F.col("w.text").startswith("!") & (F.col("w.x0") == 160)).select("doc_id", "page", (F.col("w.x0") + 0.2).alias("x0"), (F.col("w.y0") + 1).alias("y0"), F.lit("!").alias("glyph"))
    fixed = L.repair_glyphs(p, boxes)
    return fixed.select("doc_id", "page", F.size(F.filter("words", lambda w: w["text"].rlike("^[!≥]"))).cast("bigint").alias("marked"),
                        F.size(F.filter("words", lambda w: w["text"].startswith("≥"))).cast("bigint").alias("repaired"))


@query("verify_on_page", "J17", """
WITH r AS (SELECT doc_id, page, line_no, max(CASE WHEN i = 2 THEN text END) AS token, max(CASE WHEN i = 2 THEN n END) AS n, max(CASE WHEN i = 0 THEN n % 12 END) AS t, max(CASE WHEN i = 3 THEN text END) AS ft
           FROM positioned WHERE line_no > 0 GROUP BY ALL),
c AS (SELECT DISTINCT doc_id, page, 'T' || t || ' total' AS name, CASE WHEN n % 3 = 1 THEN token || '9' ELSE token END AS disp, CASE WHEN ft = 'H' THEN 'H' END AS flag FROM r WHERE token IS NOT NULL),
l AS (SELECT doc_id, page, line_no, string_agg(text, ' ' ORDER BY i) AS line FROM positioned GROUP BY ALL)
SELECT c.doc_id, c.page, c.name, c.disp, c.flag,
       EXISTS (SELECT 1 FROM l WHERE l.doc_id = c.doc_id AND l.page = c.page AND contains(lower(l.line), lower(c.name))
               AND CASE WHEN c.flag = 'H' THEN contains(' ' || l.line || ' ', ' ' || c.disp || ' H ') OR contains(' ' || l.line || ' ', ' ' || c.disp || 'H ')
                        ELSE contains(' ' || l.line || ' ', ' ' || c.disp || ' ') AND NOT contains(' ' || l.line || ' ', ' ' || c.disp || ' H ')
                             AND NOT contains(' ' || l.line || ' ', ' ' || c.disp || ' L ') END) AS verified
FROM c""", ("positioned",))
def verify_on_page(spark, folder):
    placed = L.page_lines(pages(spark, folder))
    rows = placed.select("doc_id", "page", F.inline("lines"))
    texts = placed.select("doc_id", "page", F.transform("lines", lambda n: F.array_join(F.transform(n["words"], lambda w: w["text"]), " ")).alias("lines"))
    word = lambda x: F.get(F.filter("words", lambda w: F.floor((w["x0"] - 40) / 60) == x), F.lit(0))["text"]
    claims = rows.filter(F.col("line_no") > 0).select(
        "doc_id", "page", F.concat(word(0), F.lit(" total")).alias("name"), word(2).alias("token"),
        F.get(F.filter("words", lambda w: F.floor((w["x0"] - 40) / 60) == 2), F.lit(0))["x0"].alias("x0"), F.when(word(3) == "H", "H").alias("flag"))
    # x0 shifts by word length modulo three, so this marks the same third of the claims as wrong.
    disp = F.when(F.col("x0") == 161, F.concat(F.col("token"), F.lit("9"))).otherwise(F.col("token"))
    claims = claims.filter(F.col("token").isNotNull()).select("doc_id", "page", "name", disp.alias("disp"), "flag").distinct()
    return L.verify_on_page(claims, texts)


@query("governing_dates", "C32", """
SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS row_no, l_partkey, CASE WHEN l_linestatus = 'F' THEN 'historical' ELSE 'current' END AS column_kind,
       CASE WHEN l_linestatus <> 'F' THEN CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END ELSE CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_shipdate AS DATE) END END AS day,
       CASE WHEN l_linestatus <> 'F' THEN o_orderkey % 7 <> 0 ELSE l_suppkey % 5 <> 0 END AS dated
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def governing_dates(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("section_day"))
    rows = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("row_no"), "l_partkey",
        F.when(F.col("l_linestatus") == "F", "historical").otherwise("current").alias("column_kind"), "section_day",
        F.when(F.col("l_suppkey") % 5 != 0, F.to_date("l_shipdate")).alias("column_day"))
    return L.with_governing_date(rows).drop("section_day", "column_day")


@query("tier_ranges", "A32", """
WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE '<' || (10 + o_orderkey % 9) END AS a, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '10-' || (20 + o_orderkey % 9) END AS b,
                  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '>=' || (20 + o_orderkey % 9) END AS c FROM orders),
u AS (SELECT k, 1 AS n, 'Optimal' AS label, a AS t FROM c UNION ALL SELECT k, 2, 'Moderate', b FROM c UNION ALL SELECT k, 3, 'High', c FROM c)
SELECT k AS doc_id, k % 7 AS row_no, CASE WHEN count(*) = 1 THEN min(t) ELSE string_agg(label || ' ' || t, '; ' ORDER BY n) END AS range_display
FROM u WHERE coalesce(t, '') <> '' AND t <> 'N/A' GROUP BY k""")
def tier_ranges(spark, folder):
    k = F.col("o_orderkey")
    low, top = (10 + k % 9).cast("string"), (20 + k % 9).cast("string")

    def cell(n, label, value):
        return F.struct(F.lit(n).alias("column_no"), F.lit(label).alias("label"), value.alias("text"))

    rows = table(spark, folder, "orders").select(k.alias("doc_id"), (k % 7).alias("row_no"), F.inline(F.array(
        cell(1, "Optimal", F.when(k % 3 == 0, "N/A").otherwise(F.concat(F.lit("<"), low))),
        cell(2, "Moderate", F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("10-"), top))),
        cell(3, "High", F.when(k % 5 != 0, F.concat(F.lit(">="), top))))))
    return L.tier_range(rows)
