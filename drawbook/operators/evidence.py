"""Evidence in document text.

A document's text is one value, so everything that depends on the order of its lines is computed inside the row
with array functions: no shuffle, and no group wider than one document. Lines are exploded last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawbook.constants import (EVIDENCE_LINE_LIMIT, METHODOLOGY_PHRASES, NOTE_SECTIONS, PATIENT_SYSTEMS, PRINTED_DATE,
                                SECTION_TITLE, TREND_TITLES, VITALITY_DOMAINS, VITALITY_VALUES)
from drawbook.functions import dates, text
from drawbook.functions.plan import compute_once

_DATE = rf"(?i)(?<!\d)({PRINTED_DATE})(?!\d)"
_COLLECTION = rf"(?i)(?:collected|collection|specimen|draw|service|received)[^\n:]{{0,35}}[:#]?\s*({PRINTED_DATE})"
_HEADER_WORD = r"(?i)\b(?:collected|collection|specimen|draw|current|historical|previous|result date|report date)\b"
_BIRTH = r"(?i)\b(?:date of birth|birth date|dob)\b"
_RESULT = r"(?i)((?:[<>]=?\s*)?\d+(?:\.\d+)?|\b(?:negative|positive|detected|not detected|not performed|cancelled|canceled)\b)"


def is_methodology(line: Column) -> Column:
    return text.contains_any(F.lower(line), METHODOLOGY_PHRASES)


def printed_dates(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(_DATE), F.lit(1))


def is_boundary(line: Column) -> Column:
    """A line that prints exactly one date with a collection keyword opens a dated section."""
    return (line.rlike(_COLLECTION) & ~line.rlike(_BIRTH) & ~is_methodology(line) & (F.size(printed_dates(line)) == 1))


def explode_segments(docs: DataFrame, opens: Callable[[Column], Column], keep: list[str]) -> DataFrame:
    """One row per run of lines that starts at a line for which ``opens`` holds (or at the first line)."""
    marked = compute_once(docs, _marks=F.filter(
        F.transform("lines", lambda line, i: F.when(opens(line), i)), lambda i: i.isNotNull()))
    first = F.coalesce(F.get("_marks", F.lit(0)), F.lit(-1))
    marked = marked.withColumn("_starts", F.when(first == 0, F.col("_marks")).otherwise(F.concat(F.array(F.lit(0)), F.col("_marks"))))
    ends = F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(F.size("lines")))
    # Each segment takes its own slice before the explode, so that a row never carries the lines of the whole document.
    spans = F.zip_with("_starts", ends, lambda s, e: F.struct(s.alias("s"), F.slice("lines", s + 1, e - s).alias("lines")))
    parts = marked.select(*keep, F.posexplode(spans).alias("segment", "_part"))
    return parts.select(*keep, "segment", F.col("_part.s").alias("start"), F.col("_part.lines").alias("lines")).withColumn(
        "opener", F.get("lines", F.lit(0)))


def names_in(line: Column, aliases: list[str]) -> Column:
    """Every library name printed in a line; the library is a fixed list, so this is one pattern, not a join."""
    import re

    body = "|".join(re.escape(a) for a in sorted(aliases, key=lambda a: (-len(a), a)))
    return F.array_distinct(F.regexp_extract_all(line, F.lit(rf"(?i)(?<!\w)({body})(?!\w)"), F.lit(1)))


def evidence(docs: DataFrame, units: dict[str, str]) -> DataFrame:
    """(document, test, day) with the first evidence line, its tokens and its printed date.

    A line counts when it is short, not methodology, and prints a number in the test's own unit. Its date is the
    one on the line, else the nearest preceding dated section's; only a document without any section falls back
    to dated column headers at most 40 lines above.
    """
    import re

    marked = docs.withColumn("sectioned", F.exists("lines", is_boundary))

    def header(line: Column, i: Column) -> Column:
        around = F.array_join(F.slice("lines", F.greatest(i - 1, F.lit(1)), F.lit(5)), " ")
        fits = around.rlike(_HEADER_WORD) & ~around.rlike(_BIRTH) & ~is_methodology(around)
        return F.when(fits & (F.size(printed_dates(line)) > 0), F.struct(i.alias("at"), printed_dates(line).alias("dates")))

    marked = marked.withColumn("headers", F.when(~F.col("sectioned"), F.filter(F.transform("lines", header), lambda h: h.isNotNull())))
    segments = explode_segments(marked, is_boundary, ["doc_id", "sectioned", "headers"])
    section = F.when(F.col("sectioned") & is_boundary(F.col("opener")), F.regexp_extract("opener", _COLLECTION, 1))
    lines = segments.select("doc_id", "sectioned", "headers", "start", section.alias("section_date"), F.posexplode("lines").alias("at", "line"))
    lines = lines.withColumn("line_no", F.col("start") + F.col("at")).filter(
        (F.length("line") <= EVIDENCE_LINE_LIMIT) & ~is_methodology(F.col("line")))
    named = lines.withColumn("test", F.explode(names_in(F.col("line"), list(units))))
    rest = F.regexp_replace(F.col("line"), F.concat(F.lit(r"(?i)(?<!\w)\Q"), F.col("test"), F.lit(r"\E(?!\w)")), F.lit(""))
    named = named.withColumn("result", F.get(F.split(rest, r"(?i)\breference\s+range\b", 2), F.lit(0)))
    by_unit: dict[str, list[str]] = {}
    for test, unit in units.items():
        by_unit.setdefault(unit, []).append(test)
    has_unit = F.lit(False)
    for unit, tests in by_unit.items():
        has_unit = has_unit | (F.col("test").isin(tests) & F.col("result").rlike(
            rf"(?i)(?:[<>]=?\s*)?\d+(?:\.\d+)?\s*{re.escape(unit)}(?!\w)"))
    named = named.filter(has_unit).withColumn("tokens", F.regexp_extract_all("result", F.lit(_RESULT), F.lit(1)))
    own = printed_dates(F.col("line"))
    near = F.filter("headers", lambda h: (h["at"] <= F.col("line_no")) & (F.col("line_no") - h["at"] <= 40))
    nearest = F.array_max(F.transform(near, lambda h: h["at"]))
    above = F.flatten(F.transform(F.filter(near, lambda h: nearest - h["at"] <= 2), lambda h: h["dates"]))
    fallback = F.when(F.size("tokens") >= F.size(above), above)
    shown = F.when(F.size(own) > 0, own).when(F.col("section_date").isNotNull(), F.array("section_date")).otherwise(fallback)
    dated = named.withColumn("printed", F.explode(shown)).withColumn("day", dates.date_group(F.col("printed"))).select(
        "doc_id", "test", "day", "line_no", "printed", "tokens")
    best = dated.groupBy("doc_id", "test", "day").agg(F.min(F.struct("line_no", "printed", "tokens")).alias("e"))
    # Filtered after the aggregate, on its key: the date is normalised once per line, not again in the predicate.
    best = best.filter(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}\z"))
    return best.select("doc_id", "test", "day", "e.line_no", "e.printed", "e.tokens")


def missing_evidence(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Evidence (document, test, day) that no extracted row covers."""
    return found.join(rows.select("doc_id", "test", "day").distinct(), ["doc_id", "test", "day"], "left_anti")


def value_mismatches(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Extracted values that are none of their evidence line's tokens."""
    j = rows.join(found.select("doc_id", "test", "day", "tokens"), ["doc_id", "test", "day"])
    keys = F.transform("tokens", text.token_key)
    return j.filter((F.size("tokens") > 0) & ~F.array_contains(keys, text.token_key(F.col("disp"))))


def unsupported_current(docs: DataFrame, rows: DataFrame, aliases: list[str]) -> DataFrame:
    """Names printed as result rows in a document that no extracted row has, or only without a current value."""
    import re

    body = "|".join(re.escape(a) for a in sorted(aliases, key=lambda a: (-len(a), a)))
    starts = rf"(?i)^({body})\s+[<>]?=?\d"
    lines = docs.select("doc_id", F.explode("lines").alias("line"))
    names = F.regexp_extract("line", starts, 1)
    printed = lines.filter(names != "").groupBy("doc_id", names.alias("test")).agg(F.count(F.lit(1)).alias("mentions"))
    have = rows.groupBy("doc_id", "test").agg(F.bool_or("current").alias("has_current"))
    j = printed.join(have, ["doc_id", "test"], "left")
    rule = (F.when(F.col("has_current").isNull(), "not_extracted")
            .when((F.col("mentions") >= 2) & ~F.col("has_current"), "no_current_value"))
    return j.withColumn("rule", rule).filter(F.col("rule").isNotNull()).select("doc_id", "test", "mentions", "rule")


_ORDER = r"(?i)\border\s*(?:id|#|number)\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9-]*)"
_COLLECTED = rf"(?i)\bcollected\s*:?\s*({PRINTED_DATE})"


def extract_headers(docs: DataFrame) -> DataFrame:
    """Printed header fields, one row per line that prints any of them."""
    lines = docs.select("doc_id", F.posexplode("lines").alias("line_no", "line"))

    def field(pattern: str, group: int = 1) -> Column:
        found = F.regexp_extract("line", pattern, group)
        return F.when(found != "", found)

    out = lines.select(
        "doc_id", "line_no", field(_ORDER).alias("order_id"), field(_COLLECTED).alias("collected"),
        field(rf"{_COLLECTED}\s*,?\s*(\d{{1,2}}:\d{{2}}(?:\s*[AaPp][Mm])?)", 2).alias("collected_time"),
        F.when(F.col("line").rlike(r"(?i)\bfasting\s*:"), F.upper(F.regexp_extract("line", r"(?i)\bfasting\s*:\s*([A-Za-z-]*)", 1))).alias("fasting"),
        field(rf"(?i)\b(?:DOB|D\.O\.B\.?|Date of Birth|Birth Date)\s*[:#]?\s*({PRINTED_DATE})").alias("dob"),
        F.lower(F.substring(field(r"\b(?:Gender|Sex)\s*:\s*(Female|Male|F|M)\b"), 1, 1)).alias("sex"),
        F.trim(F.regexp_replace(field(r"(?i)\bPatient(?: Name)?:\s*([A-Za-z ,'-]+)"),
                                r"(?i)\s+(?:DOB|D\.?O\.?B|Date of Birth|Birth|Sex|Gender|Age|ID|MRN|Phone|Acct)\b.*\z", "")).alias("patient"))
    return out.filter(F.coalesce(*[F.col(c) for c in out.columns[2:]]).isNotNull())


def sections(docs: DataFrame) -> DataFrame:
    """Sections opened by order-id and collected-date lines; a repeated order id rejoins its section.

    The fold runs over the header lines of one document only.
    """
    events = F.filter(F.transform("lines", lambda line, i: F.struct(
        i.alias("at"), F.regexp_extract(line, _ORDER, 1).alias("order_id"), F.regexp_extract(line, _COLLECTED, 1).alias("day"))),
        lambda e: (e["order_id"] != "") | (e["day"] != ""))
    opened = "array<struct<at:int,key:string,day:string>>"
    start = F.struct(F.lit("").alias("key"), F.lit("").alias("day"), F.lit(0).alias("made"), F.array().cast(opened).alias("out"))

    def step(state: Column, e: Column) -> Column:
        by_order = e["order_id"] != ""
        other_day = (e["day"] != "") & (state["day"] != "") & (e["day"] != state["day"])
        fresh = ~by_order & ((state["key"] == "") | other_day)
        key = F.when(by_order, F.concat(F.lit("order "), e["order_id"])).when(
            fresh, F.concat(F.lit("section "), (state["made"] + 1).cast("string"))).otherwise(state["key"])
        day = F.when(e["day"] != "", e["day"]).when(by_order & (key != state["key"]), F.lit("")).otherwise(state["day"])
        out = F.array_append(state["out"], F.struct(e["at"].alias("at"), key.alias("key"), e["day"].alias("day")))
        return F.struct(key.alias("key"), day.alias("day"), (state["made"] + fresh.cast("int")).alias("made"), out.alias("out"))

    folded = docs.select("doc_id", F.aggregate(events, start, step, lambda s: s["out"]).alias("opened"))
    rows = folded.select("doc_id", F.inline("opened")).withColumn("d", dates.date_group(F.when(F.col("day") != "", F.col("day"))))
    return rows.groupBy("doc_id", F.col("key").alias("section")).agg(
        F.min("at").alias("first_line"), F.count(F.lit(1)).alias("openers"), F.min("d").alias("day"),
        F.coalesce(F.min("d") != F.max("d"), F.lit(False)).alias("conflicting_dates"))


def headings(docs: DataFrame) -> DataFrame:
    """Each non-heading line with the heading above it, an upper-case line or a "... Report" title; lines under a trend
    title are restatements."""

    def is_heading(line: Column) -> Column:
        return (line == F.upper(line)) & line.rlike("^[A-Z][A-Z ,/&-]+\\z") | F.lower(F.trim(line)).isin(TREND_TITLES) | F.trim(line).rlike(SECTION_TITLE)

    seg = explode_segments(docs, is_heading, ["doc_id"])
    heading = F.when(is_heading(F.col("opener")), F.col("opener"))
    lines = seg.select("doc_id", "start", heading.alias("heading"), F.posexplode("lines").alias("at", "line"))
    return lines.filter(~(F.col("heading").isNotNull() & (F.col("at") == 0))).select(
        "doc_id", (F.col("start") + F.col("at")).alias("line_no"), "line", "heading",
        F.coalesce(F.lower(F.trim("heading")).isin(TREND_TITLES), F.lit(False)).alias("restatement"))


def attach_dates(docs: DataFrame) -> DataFrame:
    """The date of an undated row: the single collection date printed near its source label, else none.

    ``docs`` carries ``label``. A label line shares at least half of the label's own words; dates count from 12
    lines above to 24 below.
    """
    words = F.array_except(F.filter(F.regexp_extract_all(F.lower("label"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) >= 3),
                           F.array(*[F.lit(w) for w in ("report", "panel", "section", "current", "historical", "lab")]))
    marked = docs.withColumn("words", F.array_distinct(words))
    shared = lambda line: F.size(F.array_intersect("words", F.regexp_extract_all(F.lower(line), F.lit("([a-z0-9]+)"), F.lit(1))))
    enough = F.greatest(F.lit(1), F.floor(F.size("words") / 2))
    marked = marked.withColumn("marks", F.filter(F.transform("lines", lambda line, i: F.when(shared(line) >= enough, i)), lambda i: i.isNotNull()))
    marked = marked.withColumn("dated", F.filter(F.transform("lines", lambda line, i: F.struct(
        i.alias("at"), F.regexp_extract(line, _COLLECTION, 1).alias("day"))), lambda d: d["day"] != ""))
    near = F.filter("dated", lambda d: F.exists("marks", lambda m: d["at"].between(m - 12, m + 24)))
    found = F.array_distinct(F.transform(near, lambda d: d["day"]))
    return marked.select("doc_id", "label", F.size("marks").alias("label_lines"), F.when(F.size("words") > 0, F.size(found)).otherwise(0).alias("dates"),
                         F.when((F.size("words") > 0) & (F.size(found) == 1), F.get(found, F.lit(0))).alias("printed"))


def unread_pages(docs: DataFrame, aliases: list[str], limit: int = 8) -> DataFrame:
    """Known names followed by a number on a page without a table header: the first few, and how many there are."""
    import re

    body = "|".join(re.escape(a) for a in sorted(aliases, key=lambda a: (-len(a), a)))
    has_header = F.exists("lines", lambda line: F.lower(line).rlike(r"^test(s| name)?\b.*\b(current|historical|result)\b"))
    found = F.array_distinct(F.filter(F.transform("lines", lambda line: F.regexp_extract(line, rf"(?i)^({body})\s+[<>]?\d[\d.,]*", 1)),
                                      lambda n: n != ""))
    out = docs.filter(~has_header).withColumn("found", found).filter(F.size("found") > 0)
    return out.select("doc_id", F.size("found").alias("names"), F.array_join(F.slice("found", 1, limit), ", ").alias("first_names"))


def phase_ranges(docs: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Printed cycle-phase text per hormone, by name priority; never used to choose a phase."""
    rows = []
    for test, spellings in names.items():
        options = [F.nullif(F.regexp_extract("text", rf"{s}\b.{{0,200}}?(Follicular phase:.*?)\.\s+(?=[A-Z]|\z)", 1), F.lit("")) for s in spellings]
        rows.append(F.struct(F.lit(test).alias("test"), F.coalesce(*options).alias("phases")))
    return docs.select("doc_id", F.inline(F.array(*rows))).filter(F.col("phases").isNotNull())


def leaks(published: DataFrame, phrases: list[str]) -> DataFrame:
    """Published rows that contain an internal phrase; the phrase list is fixed, so it is part of the expression."""
    hits = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.col("text"), p))
    return published.withColumn("hits", hits).filter(F.size("hits") > 0).select("doc_id", F.array_join("hits", "|").alias("phrases"))


def missing_protocol(notes: DataFrame, listed: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Items a note mentions that the subject's list lacks, with the cadence nearest the mention (within 40 characters)."""
    low = F.lower("text")
    items = []
    for canonical, spellings in names.items():
        positions = [F.when(F.instr(low, s) > 0, F.struct(F.instr(low, s).alias("at"), F.lit(len(s)).alias("n"))) for s in spellings]
        items.append(F.struct(F.lit(canonical).alias("item"), F.coalesce(*positions).alias("p")))
    found = notes.select("subject_id", low.alias("low"), F.inline(F.array(*items))).filter(F.col("p").isNotNull())
    begin = F.greatest(F.col("p.at") - 40, F.lit(1))
    window = F.col("low").substr(begin, F.col("p.at") - begin + F.col("p.n") + 40)
    found = found.withColumn("window", window).withColumn("center", F.col("p.at") - begin + F.col("p.n") / 2)

    def spots_of(word: str) -> Column:
        def starts(i: Column) -> Column:
            inside = (i > 1) & F.substr(F.col("window"), i - 1, F.lit(1)).rlike(r"\w")
            return F.substr(F.col("window"), i).rlike(rf"^{word}\b") & ~inside

        def spot(i: Column) -> Column:
            return F.struct(F.abs(i - 1 - F.col("center")).alias("gap"), i.alias("i"), F.lit(word).alias("word"))

        return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length("window"), F.lit(1))), starts), spot)

    spots = F.concat(*[spots_of(word) for word in ("daily", "weekly", "as directed")])
    found = found.withColumn("cadence", F.array_min(spots)["word"])
    return found.join(listed.select("subject_id", "item").distinct(), ["subject_id", "item"], "left_anti").select(
        "subject_id", "item", "cadence")


def parse_notes(notes: DataFrame, tests: list[str]) -> DataFrame:
    """Lines of structured notes: read by their section's grammar, or rejected with a line number and reason.

    A note is cut at its headings inside the row; whether a heading is the first of its name is known from the
    headings before it in the same note.
    """
    base = notes.select("subject_id", F.split("text", "\n").alias("lines")).withColumn(
        "heads", F.filter(F.transform("lines", lambda line, i: F.struct(
            i.alias("at"), F.lower(F.trim(F.substr(F.trim(line), F.lit(4)))).alias("name"), F.trim(line).startswith("## ").alias("ok"))),
            lambda h: h["ok"]))
    cut = explode_segments(base, lambda line: F.trim(line).startswith("## "), ["subject_id", "heads"])
    head = F.trim("opener").startswith("## ")
    name = F.lower(F.trim(F.substr(F.trim("opener"), F.lit(4))))
    repeated = F.exists("heads", lambda h: (h["at"] < F.col("start")) & (h["name"] == F.col("name")))
    cut = cut.withColumn("name", F.when(head, name))
    cut = cut.withColumn("section", F.when(F.col("name").isNull(), F.lit(None)).when(~F.col("name").isin(NOTE_SECTIONS), "unknown")
                         .when(repeated, "duplicate").otherwise(F.col("name")))
    lines = cut.select("subject_id", "section", "start", F.posexplode("lines").alias("at", "raw")).select(
        "subject_id", "section", (F.col("start") + F.col("at") + 1).alias("line_no"), (F.col("at") == 0).alias("first"), F.trim("raw").alias("line"))
    lines = lines.filter(F.col("line") != "")
    item, section = F.trim(F.substr("line", F.lit(3))), F.col("section")
    heading = F.col("first") & F.col("line").startswith("## ")
    systems = [s.lower() for s in PATIENT_SYSTEMS]

    def part(pattern: str, group: int) -> Column:
        found = F.regexp_extract(item, pattern, group)
        return F.trim(F.when(found != "", found))

    concern = r"^([^|\"]+?)\s*\|\s*Systems?:\s*([^|]+)\z"
    named = F.transform(F.split(part(concern, 2), ","), lambda s: F.lower(F.trim(s)))
    protocol = (r"(?i)^([^|]+?)(?:\s*\|\s*Cadence:\s*([^|]+?))?(?:\s*\|\s*Action:\s*(Start|Continue|Adjust|Stop|Considering))?\z")
    target = r"^([^:]+):\s*(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)\z"
    pair = r"^([^:]+):\s*(.+)\z"
    ok = (F.when(section == "patient concerns", part(concern, 1).isNotNull() & F.forall(named, lambda s: s.isin(systems)))
          .when(section == "protocol", part(protocol, 1).isNotNull())
          .when(section == "marker targets", F.upper(part(target, 1)).isin([t.upper() for t in tests]))
          .when(section == "treatment status", F.lower(part(pair, 1)).isin("on trt", "postmenopausal and on bhrt")
                & F.lower(part(pair, 2)).isin("yes", "no", "not stated"))
          .when(section == "vitality index", (part(pair, 1) == "Physical Performance") | (
              part(pair, 1).isin(VITALITY_DOMAINS) & part(pair, 2).isin(list(VITALITY_VALUES)))))
    reason = (F.when(heading & (section == "unknown"), "unknown section").when(heading & (section == "duplicate"), "section appears twice")
              .when(heading, None)
              .when(section.isNull(), F.when(~F.col("line").startswith("# "), "text outside a section"))
              .when(section == "unknown", "under an unknown section").when(section == "duplicate", "under a repeated section")
              .when(section == "consultation note", None)
              .when(~F.col("line").startswith("- "), "expected an item")
              .when(~F.coalesce(ok, F.lit(False)), "does not fit the section"))
    key = (F.when(section == "patient concerns", part(concern, 1)).when(section == "protocol", part(protocol, 1))
           .when(section == "marker targets", part(target, 1)).when(section.isin("treatment status", "vitality index"), part(pair, 1)))
    value = (F.when(section == "patient concerns", part(concern, 2)).when(section == "protocol", part(protocol, 3))
             .when(section == "marker targets", F.concat_ws("-", part(target, 2), part(target, 3)))
             .when(section.isin("treatment status", "vitality index"), part(pair, 2)))
    read = reason.isNull() & ~heading
    return lines.withColumn("reason", reason).select(
        "subject_id", "line_no", "section", "reason", F.when(read, key).alias("key"), F.when(read, value).alias("value"))
