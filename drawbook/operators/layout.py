"""Tables from positioned words.

A page is one row holding the array of its words (a printed page bounds it), so grouping, column assignment and row
building are array functions inside the row: no shuffle. ``page_arrays`` builds that row from a words table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawbook.constants import COLUMN_LABELS, DATE_COLUMN_PAD, HEADER_WORDS, LINE_TOLERANCE, MULTIWORD_CELLS, PRINTED_DATE
from drawbook.functions import cells, text
from drawbook.functions.dates import let
from drawbook.functions.plan import compute_once

PAGE = ["doc_id", "page"]
WORD = "struct<x0:double,y0:double,x1:double,y1:double,text:string>"


def page_arrays(words: DataFrame) -> DataFrame:
    """One row per (document, page) with its words; keyed by page, never by document alone."""
    return words.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "text")).alias("words"))


def repair_glyphs(pages: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Mis-mapped inequality glyphs at recorded boxes become the printed sign.

    Both sides are one row per page, so the join is on the page key and the box test runs inside the row.
    """
    boxes = glyphs.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "y0", "glyph")).alias("boxes"))
    signs = F.create_map(F.lit("!"), F.lit("≥"), F.lit("∀"), F.lit("≤"))
    j = pages.join(boxes, PAGE, "left")

    def fix(w: Column) -> Column:
        head = F.substring(w["text"], 1, 1)
        hit = F.exists("boxes", lambda b: (b["glyph"] == head) & (F.abs(w["x0"] - b["x0"]) < 0.5) & (F.abs(w["y0"] - b["y0"]) < 3))
        sign = F.try_element_at(signs, head)
        fixed = F.when(F.coalesce(hit, F.lit(False)) & sign.isNotNull(), F.concat(sign, F.substr(w["text"], F.lit(2)))).otherwise(w["text"])
        return F.struct(w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["y1"].alias("y1"), fixed.alias("text"))

    return j.select(*PAGE, F.transform("words", fix).alias("words"))


def page_lines(pages: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Each page with its lines. A line's centre is its first word's, so drift never chains words together.

    Words are in order of their centres, so a line is a stretch of them: the fold keeps one anchor and the place of its
    word per line, and each line is cut out at once, without a look at the page's other words.
    """
    centred = F.array_sort(F.transform("words", lambda w: F.struct(((w["y0"] + w["y1"]) / 2).alias("c"), w["x0"].alias("x"), w.alias("w"))))
    keyed = compute_once(pages, placed=centred)

    def step(s: Column, e: Column) -> Column:
        last, at = s["last"], s["at"] + 1
        same = last.isNotNull() & (F.abs(e["c"] - last) <= tolerance)
        return F.struct(at.alias("at"), F.when(same, last).otherwise(e["c"]).alias("last"), F.when(same, s["anchors"]).otherwise(
            F.array_append(s["anchors"], F.struct(e["c"].alias("a"), at.alias("at")))).alias("anchors"))

    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("double").alias("last"), F.array().cast("array<struct<a:double,at:int>>").alias("anchors"))
    keyed = compute_once(keyed, anchors=F.aggregate("placed", start, step, lambda s: s["anchors"]))
    end = F.struct(F.lit(float("inf")).alias("a"), (F.size("placed") + 1).alias("at"))
    spans = F.arrays_zip(F.col("anchors").alias("f"), F.array_append(F.slice("anchors", F.lit(2), F.size("anchors")), end).alias("n"))

    def words_of(span: Column) -> Column:
        first, after = span["f"], span["n"]
        stretch = F.slice("placed", F.coalesce(first["at"], F.lit(1)), after["at"] - F.coalesce(first["at"], F.lit(1)))
        return F.array_sort(F.transform(F.filter(stretch, lambda p: (p["c"] >= first["a"]) & (p["c"] < after["a"])), lambda p: p["w"]))

    lines = F.transform(spans, lambda span, i: F.struct(i.alias("line_no"), words_of(span).alias("words")))
    return compute_once(keyed, lines=lines).select(*PAGE, "lines")


def group_lines(pages: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """One row per line of words, left to right."""
    return page_lines(pages, tolerance).select(*PAGE, F.inline("lines"))


def line_text() -> Column:
    return F.array_join(F.transform("words", lambda w: w["text"]), " ")


def group_cells(lines: DataFrame) -> DataFrame:
    """Cells of each line: a gap wider than 0.6 of the smaller word height starts a new one; the words of a fixed phrase
    join however far apart they stand, but only if the next words are the whole phrase."""
    shape = "array<struct<x0:double,x1:double,h:double,text:string>>"
    phrases = sorted(MULTIWORD_CELLS, key=lambda p: -len(p.split()))

    def fold(lowered: Column) -> Column:
        def mark(w: Column, i: Column) -> Column:
            hits = [F.when(F.array_join(F.slice(lowered, i + 1, len(p.split())), " ") == p, F.lit(len(p.split()))) for p in phrases]
            return F.struct(w.alias("w"), F.coalesce(*hits, F.lit(1)).alias("n"))

        def step(s: Column, m: Column) -> Column:
            w, last = m["w"], F.get(s["out"], F.size(s["out"]) - 1)
            height = w["y1"] - w["y0"]
            joins = (F.size(s["out"]) > 0) & ((s["skip"] > 0) | (((w["x0"] - last["x1"]) <= F.least(height, last["h"]) * 0.6)))
            merged = F.struct(last["x0"].alias("x0"), w["x1"].alias("x1"), height.alias("h"), F.concat_ws(" ", last["text"], w["text"]).alias("text"))
            fresh = F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), height.alias("h"), w["text"].alias("text"))
            head = F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0)))
            return F.struct(F.when(s["skip"] > 0, s["skip"] - 1).otherwise(m["n"] - 1).alias("skip"),
                            F.when(joins, F.array_append(head, merged)).otherwise(F.array_append(s["out"], fresh)).alias("out"))

        start = F.struct(F.lit(0).alias("skip"), F.array().cast(shape).alias("out"))
        return F.aggregate(F.transform("words", mark), start, step, lambda s: s["out"])

    return compute_once(lines, cells=let(F.transform("words", lambda w: F.lower(w["text"])), fold))


def header_token(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), r"[^\w%\-]", "")


def is_header_line(words: Column) -> Column:
    """A repeated column-header line: only labels, empty date slots and printed dates."""
    return (F.size(words) >= 2) & F.forall(words, lambda w: header_token(w["text"]).isin(HEADER_WORDS)
                                           | w["text"].rlike(r"^[/&]+\z") | w["text"].rlike(rf"(?i)^{PRINTED_DATE}\z"))


def with_header(pages: DataFrame) -> DataFrame:
    """Pages of lines with the columns of their header line: longest label first; other words widen the label before.

    Current sub-labels share one value column; each historical label is its own. Pages without a header line, or
    whose header has no result column, are dropped: nothing on them is read.
    """
    longest = max(len(label.split()) for _, label in COLUMN_LABELS)
    kinds = F.create_map(*[F.lit(x) for kind, label in COLUMN_LABELS for x in (label, kind)])

    def is_header(line: Column) -> Column:
        named = header_token(F.get(line["words"], F.lit(0))["text"]).isin("test", "tests", "analyte")
        return named & F.exists(line["words"], lambda w: header_token(w["text"]).isin("current", "historical", "result", "in", "out"))

    head = pages.withColumn("head", F.get(F.filter("lines", is_header), F.lit(0))).filter(F.col("head").isNotNull()).select(
        *PAGE, "lines", F.col("head.line_no").alias("header_line"), F.col("head.words").alias("words"))
    head = head.withColumn("tokens", F.transform("words", lambda w: header_token(w["text"])))

    def labelled(w: Column, i: Column) -> Column:
        """The longest label that starts at word ``i``, if any."""

        def of(n: int) -> Column:
            key = F.array_join(F.slice("tokens", i + 1, F.lit(n)), " ")
            end = F.get("words", i + n - 1)["x1"]
            return let(F.try_element_at(kinds, key), lambda kind: F.when(
                kind.isNotNull() & end.isNotNull(), F.struct(kind.alias("kind"), F.lit(n).alias("n"), end.alias("x1"))))

        return F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), F.coalesce(*[of(n) for n in range(longest, 0, -1)]).alias("label"))

    head = head.withColumn("marks", F.transform("words", labelled))
    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<struct<kind:string,x0:double,x1:double>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        label, last = e["label"], F.get(s["out"], F.size(s["out"]) - 1)
        made = F.struct(label["kind"].alias("kind"), e["x0"].alias("x0"), label["x1"].alias("x1"))
        wider = F.struct(last["kind"].alias("kind"), last["x0"].alias("x0"), F.greatest(last["x1"], e["x1"]).alias("x1"))
        rest = F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0)))
        out = F.when((s["skip"] > 0) | (label.isNull() & last.isNull()), s["out"]).when(
            label.isNotNull(), F.array_append(s["out"], made)).otherwise(F.array_append(rest, wider))
        skip = F.when(s["skip"] > 0, s["skip"] - 1).otherwise(F.coalesce(label["n"] - 1, F.lit(0)))
        return F.struct(skip.alias("skip"), out.alias("out"))

    columns = F.aggregate("marks", start, step, lambda s: s["out"])
    found = compute_once(head, columns=columns).select(*PAGE, "lines", "header_line", "columns")
    found = found.filter((F.get("columns", F.lit(0))["kind"] == "name") & F.exists("columns", lambda c: c["kind"].isin("current", "historical")))
    return with_bounds(found)


def header_columns(pages: DataFrame) -> DataFrame:
    """One row per column of each page's header."""
    return with_header(pages).select(*PAGE, F.posexplode("columns").alias("column_no", "c")).select(*PAGE, "column_no", "c.*")


def with_bounds(headers: DataFrame) -> DataFrame:
    """Midpoints between neighbouring labels bound the columns; the outer ones are open."""
    inf = F.lit(float("inf"))
    before = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("kind"), (-inf).alias("x0"), (-inf).alias("x1"))), F.col("columns"))
    after = F.concat(F.slice("columns", F.lit(2), F.size("columns")), F.array(F.struct(F.lit(None).cast("string").alias("kind"), inf.alias("x0"), inf.alias("x1"))))
    zipped = F.arrays_zip(F.col("columns").alias("c"), F.slice(before, F.lit(1), F.size("columns")).alias("p"), after.alias("n"))
    return compute_once(headers, bounds=F.transform(zipped, lambda z, i: F.struct(
        i.alias("no"), z["c"]["kind"].alias("kind"), z["c"]["x0"].alias("x0"), z["c"]["x1"].alias("x1"),
        ((z["p"]["x1"] + z["c"]["x0"]) / 2).alias("lo"), ((z["c"]["x1"] + z["n"]["x0"]) / 2).alias("hi"))))


def column_at(x: Column, bounds: Column) -> Column:
    return F.get(F.filter(bounds, lambda b: (x >= b["lo"]) & (x < b["hi"])), F.lit(0))


def body_lines(pages: DataFrame) -> DataFrame:
    """Lines below each page's header, with the header's column bounds."""
    headed = with_header(pages)
    below = F.filter("lines", lambda line: line["line_no"] > F.col("header_line"))
    return headed.select(*PAGE, "columns", "bounds", F.inline(below))


def assign_columns(pages: DataFrame) -> DataFrame:
    """Each word below a page's header with its column, and whether it sits inside a dated column's own label span."""
    words = body_lines(pages).select(*PAGE, "line_no", "bounds", F.explode("words").alias("w"))
    center = (F.col("w.x0") + F.col("w.x1")) / 2
    placed = words.withColumn("center", center).withColumn("col", column_at(F.col("center"), F.col("bounds")))
    inside = F.col("center").between(F.col("col.x0") - DATE_COLUMN_PAD, F.col("col.x1") + DATE_COLUMN_PAD)
    return placed.select(*PAGE, "line_no", F.col("w.x0").alias("x0"), F.col("w.text").alias("text"), F.col("col.no").alias("column_no"),
                         F.col("col.kind").alias("kind"), inside.alias("inside"))


def assign_bands(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Word counts per band between horizontal rules of the same page; words outside every band are dropped."""
    marks = rules.groupBy(*PAGE).agg(F.array_sort(F.collect_set("y")).alias("rules"))
    j = pages.join(marks, PAGE).select(*PAGE, "rules", F.explode("words").alias("w"))
    center = (F.col("w.y0") + F.col("w.y1")) / 2
    above = F.size(F.filter("rules", lambda y: y <= center))
    return j.select(*PAGE, (above - 1).alias("band"), F.col("w.text").alias("text"), F.size("rules").alias("n")).filter(
        (F.col("band") >= 0) & (F.col("band") < F.col("n") - 1)).drop("n")


def is_prose(name_right: Column) -> Column:
    """Text that crosses the border between names and values within a normal word gap."""
    pairs = F.arrays_zip(F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))).alias("l"),
                         F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))).alias("r"))
    crossing = F.exists("words", lambda w: (w["x0"] < name_right) & (name_right < w["x1"]))
    running = F.exists(pairs, lambda p: (p["l"]["x1"] <= name_right) & (name_right < p["r"]["x1"])
                       & (p["r"]["x0"] - p["l"]["x1"]).between(0, 11.999))
    return crossing | running


def rows_from_cells(pages: DataFrame) -> DataFrame:
    """Observations of each table row: name, result, flag, unit and range by column role.

    For tables with one header line and one value column a page; ``tables.read_tables`` reads the others. One unreadable
    result excludes only itself (``reason``). A row is folded inside the row, so no pivot or shuffle is needed.
    """
    j = body_lines(pages).filter(~is_header_line(F.col("words")))
    placed = F.transform("words", lambda w: F.struct(
        column_at((w["x0"] + w["x1"]) / 2, F.col("bounds")).alias("col"), ((w["x0"] + w["x1"]) / 2).alias("c"), w["text"].alias("text")))
    j = compute_once(j, placed=placed)

    def printed(*kinds: str) -> Column:
        return F.array_join(F.transform(F.filter("placed", lambda p: p["col"]["kind"].isin(*kinds)), lambda p: p["text"]), " ")

    j = j.select(*PAGE, "line_no", printed("name").alias("name"), printed("flag").alias("flag_text"), printed("units").alias("unit"),
                 printed("range").alias("range_text"), printed("lab").alias("lab_code"),
                 F.transform(F.filter("placed", lambda p: p["col"]["kind"].isin("current", "historical")), lambda p: F.struct(
                     p["text"].alias("text"), p["c"].between(p["col"]["x0"] - DATE_COLUMN_PAD, p["col"]["x1"] + DATE_COLUMN_PAD).alias("inside"))).alias("values"))
    j = j.withColumn("token", F.get("values", F.lit(0))["text"]).withColumn("inside", F.coalesce(F.get("values", F.lit(0))["inside"], F.lit(False)))
    split = cells.split_cell(F.col("token"))
    j = j.withColumn("ambiguous", split["ambiguous"]).withColumn("pieces", F.size(split["pieces"])).withColumn("r", cells.cell_result(F.col("token")))
    readable = F.col("r.status").isin("final", "not_performed")
    reason = (F.when(F.col("name") == "", "no_row_name").when(F.col("token").isNull(), "no_result").when(~F.col("inside"), "outside_column")
              .when(F.size("values") > 1, "more_than_one_result").when(F.col("ambiguous"), "digits_run_together").when(~readable, "not_a_result"))
    glued = F.nullif(F.regexp_extract("token", cells.CELL, 3), F.lit(""))
    kept = reason.isNull()
    parsed = cells.parse_range(F.col("range_text"))
    return j.select(
        *PAGE, "line_no", "name", reason.alias("reason"), F.when(kept, F.col("r.status")).alias("status"), F.when(kept, F.col("r.value")).alias("value"),
        F.when(kept, F.col("r.disp")).alias("disp"), F.coalesce(glued, text.flag(F.col("flag_text"))).alias("flag"), "unit", "lab_code",
        parsed["lo"].alias("range_lo"), parsed["hi"].alias("range_hi"))


def with_governing_date(rows: DataFrame) -> DataFrame:
    """A current cell takes its section's date, a historical cell its column's; a result with neither is set apart."""
    day = F.when(F.col("column_kind") == "current", F.col("section_day")).otherwise(F.col("column_day"))
    return rows.withColumn("day", day).withColumn("dated", day.isNotNull())


def tier_range(cells_by_row: DataFrame) -> DataFrame:
    """Risk-category text as the printed range: one band as it is, several as ``label text; ...`` in column order.

    A row has at most one cell per column of its table.
    """
    used = cells_by_row.filter((F.coalesce("text", F.lit("")) != "") & (F.upper("text") != "N/A"))
    per = used.groupBy("doc_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("column_no", "label", "text"))).alias("bands"))
    joined = F.array_join(F.transform("bands", lambda b: F.concat_ws(" ", b["label"], b["text"])), "; ")
    return per.select("doc_id", "row_no", F.when(F.size("bands") == 1, F.get("bands", F.lit(0))["text"]).otherwise(joined).alias("range_display"))


def verify_on_page(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """A row is corroborated when its name and exact value (and flag) stand on one text line of its page.

    ``pages`` has one row per page with its text lines, so the join is on the page key; the token test runs inside
    the row.
    """
    squashed = lambda said: F.lower(text.squash(said))
    # What a line or a claim says is worked out once, not once per pair; a line is split into windows only where it holds the value.
    read = compute_once(pages, read=F.transform("lines", lambda line: F.struct(
        squashed(line).alias("low"), F.concat(F.lit(" "), line, F.lit(" ")).alias("spaced"), F.split(line, " ").alias("tokens")))).select(*PAGE, "read")
    claims = compute_once(rows, claim=F.struct(squashed(F.col("name")).alias("name"), F.split("disp", " ").alias("wanted"), F.concat(F.lit(" "), F.col("disp")).alias("spaced"),
                                               F.concat("disp", F.coalesce("flag", F.lit(""))).alias("glued")))
    j = claims.join(read, PAGE, "left")
    wanted = F.col("claim.wanted")

    def on_line(line: Column) -> Column:
        tokens = line["tokens"]
        n = F.size(wanted)
        last = F.size(tokens) - n

        def at(i: Column) -> Column:
            window = F.slice(tokens, i + 1, n)
            following = F.get(tokens, i + n)
            plain = (window == wanted) & F.when(F.col("flag").isNotNull(), F.coalesce(following == F.col("flag"), F.lit(False))).otherwise(
                ~F.coalesce(following.isin("H", "L", "HH", "LL"), F.lit(False)))
            glued = F.col("flag").isNotNull() & (F.array_join(window, " ") == F.col("claim.glued"))
            return plain | glued

        return F.contains(line["low"], F.col("claim.name")) & F.contains(line["spaced"], F.col("claim.spaced")) & (last >= 0) & F.exists(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)

    return j.select(*rows.columns, F.coalesce(F.exists("read", on_line), F.lit(False)).alias("verified"))
