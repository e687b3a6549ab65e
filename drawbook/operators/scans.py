"""Body-composition scans: cleaning, agreement of reads and pages, scores, pairing with draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawbook.constants import AGE_TOLERANCE_YEARS, BONE_MINERAL_MAX, SCAN_WINDOW_DAYS
from drawbook.functions import cells, scoring, text
from drawbook.functions.plan import compute_once

MASSES = ["total", "fat", "lean"]


def clear_sentinels(scans: DataFrame) -> DataFrame:
    """-1 and empty text mean absent; all-zero masses beside a real visceral-fat reading are a partial scan."""
    zero = (F.col("total") == 0) & (F.col("fat") == 0) & (F.col("lean") == 0)
    real_vat = F.coalesce(F.col("vat_mass") != 0, F.lit(False)) | F.coalesce(F.col("vat_area") != 0, F.lit(False))
    partial = F.coalesce(zero & real_vat, F.lit(False))
    return scans.withColumns({
        **{m: F.when(~partial & (F.col(m) != -1), F.col(m)) for m in MASSES},
        "body_fat_text": F.when(~partial & (F.col("body_fat_text") != ""), F.col("body_fat_text"))})


def with_body_fat(scans: DataFrame) -> DataFrame:
    """The printed body-fat percentage, else fat / (fat + lean), listed as computed."""
    printed = F.regexp_replace("body_fat_text", "%+\\z", "").try_cast("double")
    fat, lean = F.col("fat"), F.col("lean")
    usable = (fat >= 0) & (lean >= 0) & (fat + lean != 0)
    computed = F.when(usable, fat / (fat + lean) * 100)
    return scans.withColumn("body_fat_pct", F.coalesce(printed, computed)).withColumn(
        "computed", printed.isNull() & computed.isNotNull())


def has_composition() -> Column:
    return F.col("body_fat_pct").isNotNull() | (
        F.col("total").isNotNull() & F.col("fat").isNotNull() & F.col("lean").isNotNull())


_POINT = ["day", "doc_id", "body_fat_pct", "fat", "lean", "vat_area", "vat_mass"]


def first_and_latest(scans: DataFrame) -> DataFrame:
    """First and latest complete scan per subject."""
    point = F.struct(*_POINT)
    return scans.filter(has_composition()).groupBy("subject_id").agg(
        F.min(point).alias("first"), F.max(point).alias("last"), F.count(F.lit(1)).alias("complete_scans"))


def score_scans(scans: DataFrame, subjects: DataFrame) -> DataFrame:
    """Structure score now and then; *then* only where the first complete scan is another one."""
    from drawbook.operators.markers import canonical_sex

    ends = first_and_latest(scans).join(subjects.select("subject_id", canonical_sex(F.col("sex")).alias("sex")), "subject_id", "left")

    def score(end: str) -> Column:
        return scoring.structure_score(F.col(f"{end}.body_fat_pct"), F.col(f"{end}.vat_area"), F.col("sex"))

    return ends.select(
        "subject_id", "complete_scans", score("last").cast("double").alias("structure_now"),
        F.when(F.col("complete_scans") > 1, score("first")).cast("double").alias("structure_then"))


def scan_changes(scans: DataFrame) -> DataFrame:
    """Deltas between first and latest complete scan, and the visceral-fat trend over scans that measured it."""
    ends = first_and_latest(scans)
    vat = scans.filter(F.col("vat_mass").isNotNull()).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("day", "doc_id", "vat_mass")).alias("a"),
        F.max(F.struct("day", "doc_id", "vat_mass")).alias("z"))
    trend = (F.when(F.col("n").isNull() | (F.col("n") < 2), "none").when(F.col("z.vat_mass") < F.col("a.vat_mass"), "down")
             .when(F.col("z.vat_mass") > F.col("a.vat_mass"), "up").otherwise("steady"))
    j = ends.join(vat, "subject_id", "left")
    both = F.col("complete_scans") > 1
    return j.select(
        "subject_id", "complete_scans",
        F.when(both, F.col("last.body_fat_pct") - F.col("first.body_fat_pct")).alias("body_fat_delta"),
        F.when(both, F.col("last.lean") - F.col("first.lean")).alias("lean_delta"),
        F.coalesce(both & (F.col("last.body_fat_pct") < F.col("first.body_fat_pct")), F.lit(False)).alias("improved"),
        trend.alias("vat_trend"))


def pair_scans(scans: DataFrame, draws: DataFrame, window: int = SCAN_WINDOW_DAYS) -> DataFrame:
    """The latest complete scan within the window of the latest draw is current; later scans are left out.

    The current offset is one aggregate per subject, joined back; a subject without a candidate is unchanged.
    """
    offset = F.datediff("day", "latest_draw")
    dated = scans.join(draws.select("subject_id", "latest_draw"), "subject_id", "left").withColumn("days", offset)
    candidate = has_composition() & (F.abs("days") <= window)
    current = dated.groupBy("subject_id").agg(F.max(F.when(candidate, F.col("days"))).alias("current_days"))
    j = dated.join(current, "subject_id")
    role = (F.when(F.col("current_days").isNull(), "unpaired").when(F.col("days") > F.col("current_days"), "excluded")
            .when((F.col("days") == F.col("current_days")) & has_composition(), "current").otherwise("history"))
    return j.select("subject_id", "doc_id", "day", F.col("days").cast("bigint").alias("days"), role.alias("role"))


def scan_gap(scans: DataFrame, draws: DataFrame, limit: int = SCAN_WINDOW_DAYS) -> DataFrame:
    """Days from the latest complete scan to the latest draw, and whether it is too old."""
    last = first_and_latest(scans).select("subject_id", F.col("last.day").alias("scan_day"))
    j = last.join(draws.select("subject_id", "latest_draw"), "subject_id")
    gap = F.datediff("latest_draw", "scan_day")
    return j.select("subject_id", "scan_day", "latest_draw", gap.cast("bigint").alias("gap_days"), (gap > limit).alias("stale"))


# --- agreement over reads and pages ------------------------------------------------------------------------------

FIELD = ["doc_id", "page", "day", "field"]


def agree_fields(reads: DataFrame, page_numbers: DataFrame, by: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """One row per page, scan day and field with the outcome of its two reads.

    A field printed twice within a read with different values is ambiguous. The page's text layer only breaks a
    tie: when the reads differ and it prints exactly one of the two values, that one stands.

    The reads move once, dealt by ``by`` (document, or document and page): reads, fields, days and the text layer of a
    page then meet in order of the same keys. A print is parsed once.
    """
    placed = F.col("doc_id").isNotNull() & F.col("page").isNotNull()
    rows = reads.filter(placed & F.col("day").isNotNull()).select(*FIELD, "read_no", "text").repartition(*by)
    rows = cells.with_measure(rows, "text", "m").withColumn("bad", F.col("text").isNotNull() & F.col("m").isNull())
    key = F.coalesce(F.col("m.value").cast("string"), F.col("text"))
    shortest = F.min(F.when(F.col("m").isNotNull(), F.struct(
        F.length("m.text").alias("l"), F.col("m.text").alias("text"), F.col("m.value").alias("value"))))
    per_read = rows.groupBy(*FIELD, "read_no").agg(
        shortest.alias("p"), F.bool_or(F.coalesce(F.col("m.estimated"), F.lit(False))).alias("e"), F.bool_or("bad").alias("bad"),
        F.coalesce(F.min(key) != F.max(key), F.lit(False)).alias("ambiguous"))
    sides = [F.max(F.when(F.col("read_no") == n, F.struct("p.value", "p.text", "e"))).alias(side) for n, side in ((0, "a"), (1, "b"))]
    pair = per_read.groupBy(*FIELD).agg(*sides, F.bool_or("bad").alias("bad"), F.bool_or("ambiguous").alias("ambiguous"))
    day = Window.partitionBy("doc_id", "page", "day")
    pair = pair.select("*", *(F.coalesce(F.bool_or(F.col(side).isNotNull()).over(day), F.lit(False)).alias(f"in_{side}") for side in ("a", "b")))
    pair = pair.select("*", F.col("a.value").alias("a_value"), F.col("b.value").alias("b_value"), F.col("a.text").alias("a_text"), F.col("b.text").alias("b_text"))
    numbers = page_numbers.filter(placed).select("doc_id", "page", "number").repartition(*by).groupBy("doc_id", "page").agg(F.collect_set("number").alias("numbers"))
    pair = pair.join(numbers, ["doc_id", "page"], "left")
    pair = pair.withColumns({f"{side}_in": F.array_contains("numbers", F.col(f"{side}_text")) for side in ("a", "b")})
    a_in, b_in = F.coalesce("a_in", F.lit(False)), F.coalesce("b_in", F.lit(False))
    differ = F.col("a_value") != F.col("b_value")
    tie = F.coalesce(differ & (a_in != b_in), F.lit(False))
    av = F.when(tie & b_in, F.col("b_value")).otherwise(F.col("a_value"))
    bv = F.when(tie & a_in, F.col("a_value")).otherwise(F.col("b_value"))
    outcome = (F.when(~(F.col("in_a") & F.col("in_b")), "day_in_one_read").when(F.col("ambiguous"), "ambiguous")
               .when(F.col("bad"), "unreadable").when(av.isNull() & bv.isNull(), "absent").when(av.isNull() | bv.isNull(), "one_read")
               .when(av != bv, "differ").when(tie, "text_layer").otherwise("agreed"))
    text = F.when(tie, F.when(a_in, F.col("a_text")).otherwise(F.col("b_text"))).when(
        F.struct(F.length("a_text"), F.col("a_text")) <= F.struct(F.length("b_text"), F.col("b_text")), F.col("a_text")).otherwise(F.col("b_text"))
    estimated = F.when(tie, F.when(a_in, F.col("a.e")).otherwise(F.col("b.e"))).otherwise(
        F.coalesce(F.col("a.e"), F.lit(False)) | F.coalesce(F.col("b.e"), F.lit(False)))
    kept = outcome.isin("agreed", "text_layer")
    return pair.select(*FIELD, outcome.alias("outcome"), F.when(kept, av).alias("value"), F.when(kept, text).alias("text"),
                       F.when(kept, estimated).alias("estimated"), "a_value", "b_value", "a_text", "b_text")


SCAN = ["doc_id", "day"]
SETTLED = [*MASSES, "body_fat"]


def settle_fields(fields: DataFrame) -> DataFrame:
    """One value per scan and field across the pages that print it, with how it was settled.

    Order: mass balance picks the only fitting candidate; a strict plurality confirmed on two pages; body fat
    confirmed by the kept masses; a value single reads saw on two pages; else withheld. A scan has a few pages and the
    four ``SETTLED`` fields, so its outcomes are gathered in one row and decided there: one exchange, no window.
    """
    single = F.col("outcome").isin("one_read", "differ")
    # The parts of a list are columns before they are listed: inside the aggregate they would be evaluated for each list.
    parts = fields.filter(F.col("field").isin(*SETTLED)).select(
        *SCAN, "field", (~F.col("outcome").isin("absent", "day_in_one_read")).alias("seen"),
        F.when(F.col("value").isNotNull(), F.struct("value", "text", "estimated")).alias("a"),
        *(F.when(single & F.col(f"{side}_value").isNotNull(), F.struct(F.col(f"{side}_value").alias("value"), F.col(f"{side}_text").alias("text"), "page")).alias(part)
          for side, part in (("a", "x"), ("b", "y"))))
    rows = parts.groupBy(*SCAN).agg(*(
        made for n in SETTLED for made in (*(F.collect_list(F.when(F.col("field") == n, F.col(part))).alias(f"{part}_{n}") for part in ("a", "x", "y")),
                                           F.bool_or((F.col("field") == n) & F.col("seen")).alias(f"seen_{n}"))))
    rows = compute_once(rows, **{f"z_{n}": F.concat(f"x_{n}", f"y_{n}") for n in SETTLED})

    def least(texts: Column) -> Column:
        return F.array_min(F.transform(texts, lambda t: F.struct(F.length(t).alias("l"), t.alias("text"))))["text"]

    def candidates(name: str) -> Column:
        """Agreed values of a field: value, pages, text, estimated."""
        own = F.col(f"a_{name}")

        def one(v: Column) -> Column:
            same = F.filter(own, lambda x: x["value"] == v)
            return F.struct(v.alias("value"), F.size(same).alias("pages"), least(F.transform(same, lambda x: x["text"])).alias("text"),
                            F.exists(same, lambda x: x["estimated"]).alias("estimated"))

        return F.transform(F.array_distinct(F.transform(own, lambda x: x["value"])), one)

    def lone(name: str) -> Column:
        """Values that single reads printed: value, pages, text, estimated."""
        seen = F.col(f"z_{name}")

        def one(v: Column) -> Column:
            same = F.filter(seen, lambda o: o["value"] == v)
            return F.struct(v.alias("value"), F.size(F.array_distinct(F.transform(same, lambda o: o["page"]))).alias("pages"),
                            F.array_min(F.transform(same, lambda o: o["text"])).alias("text"), F.lit(False).alias("estimated"))

        return F.transform(F.array_distinct(F.transform(seen, lambda o: o["value"])), one)

    rows = compute_once(rows, **{f"c_{n}": candidates(n) for n in SETTLED}, **{f"l_{n}": lone(n) for n in SETTLED})
    rows = rows.select(*SCAN, *(f"{kind}_{n}" for n in SETTLED for kind in ("c", "l", "seen")))
    only = {m: F.when(F.size(f"c_{m}") == 1, F.get(f"c_{m}", F.lit(0))["value"]) for m in MASSES}
    rows = compute_once(rows, **{f"s_{m}": only[m] for m in MASSES})

    def fitting(name: str) -> Column:
        v = {m: F.col(f"s_{m}") for m in MASSES}

        def fits(c: Column) -> Column:
            v[name] = c["value"]
            bone = v["total"] - v["fat"] - v["lean"]
            return F.coalesce((bone > 0) & (bone <= BONE_MINERAL_MAX), F.lit(False))

        return F.filter(f"c_{name}", fits) if name in MASSES else F.slice(f"c_{name}", 1, 0)

    rows = compute_once(rows, **{f"f_{n}": fitting(n) for n in SETTLED})
    balanced = {n: (F.size(f"c_{n}") > 1) & (F.size(f"f_{n}") == 1) for n in SETTLED}
    rows = compute_once(rows, **{f"o_{n}": F.when(balanced[n], F.col(f"f_{n}")).otherwise(F.col(f"c_{n}")) for n in SETTLED})

    def top(options: str) -> Column:
        """The options printed on most pages."""
        most = F.array_max(F.transform(options, lambda c: c["pages"]))
        return F.filter(options, lambda c: c["pages"] == most)

    def decision(name: str) -> Column:
        options, alone = f"o_{name}", f"l_{name}"
        voted = F.filter(top(options), lambda c: c["pages"] >= 2)
        crossed = F.filter(top(alone), lambda c: c["pages"] >= 2)

        def pick(c: Column, how: str) -> Column:
            return F.struct(c["value"].alias("value"), c["text"].alias("text"), c["estimated"].alias("estimated"), F.lit(how).alias("how"))

        first = F.get(options, F.lit(0))
        return (F.when(balanced[name], pick(first, "mass_balance")).when(F.size(options) == 1, pick(first, "agreed"))
                .when((F.size(options) > 1) & (F.size(voted) == 1), pick(F.get(voted, F.lit(0)), "page_vote"))
                .when((F.size(options) == 0) & (F.size(crossed) == 1), pick(F.get(crossed, F.lit(0)), "cross_page")))

    rows = compute_once(rows, **{f"d_{n}": decision(n) for n in SETTLED})
    # Body fat: the one printed candidate equal to the scan's own kept fat / (fat + lean), to one decimal.
    ratio = F.bround(F.col("d_fat.value") / (F.col("d_fat.value") + F.col("d_lean.value")) * 100, 1)
    open_options = F.when(F.size("o_body_fat") > 0, F.col("o_body_fat")).otherwise(F.col("l_body_fat"))
    rows = compute_once(rows, confirmed=F.filter(open_options, lambda c: F.coalesce(F.bround(c["value"], 1) == ratio, F.lit(False))))
    values = F.transform("confirmed", lambda c: c["value"])
    fat = F.when(F.array_min(values) == F.array_max(values), F.struct(
        F.array_min(values).alias("value"), least(F.transform("confirmed", lambda c: c["text"])).alias("text"),
        F.exists("confirmed", lambda c: c["estimated"]).alias("estimated"), F.lit("masses_confirm").alias("how")))
    rows = rows.withColumn("d_body_fat", F.coalesce("d_body_fat", fat))

    def outcome(name: str) -> Column:
        d = F.col(f"d_{name}")
        how = F.coalesce(d["how"], F.when(F.col(f"seen_{name}"), "withheld"))
        return F.when(how.isNotNull(), F.struct(F.lit(name).alias("field"), d["value"].alias("value"), d["text"].alias("text"),
                                                d["estimated"].alias("estimated"), how.alias("how")))

    return rows.select(*SCAN, F.inline(F.array_compact(F.array(*[outcome(n) for n in SETTLED]))))


PRINTED_AGE = r"(?i)^\s*(?:age\s*:?\s*)?(\d{1,3}(?:\.\d+)?)\s*(?:y|yr|yrs|years?|years old)?\.?\s*\z"


def printed_ages(texts: Column) -> Column:
    """The ages one read prints on a page, in order, as (value, number text); null where a printed age is no number."""
    said = F.filter(F.transform(texts, lambda t: text.squash(F.coalesce(t, F.lit("")))), lambda t: t != "")
    number = F.transform(said, lambda t: F.nullif(F.regexp_extract(t, PRINTED_AGE, 1), F.lit("")))
    return F.when(~F.exists(number, lambda n: n.isNull()), F.array_sort(F.transform(number, lambda n: F.struct(n.cast("double").alias("value"), n.alias("text")))))


def attribute_pages(page_reads: DataFrame, expected: DataFrame, tolerance: int = AGE_TOLERANCE_YEARS) -> DataFrame:
    """Which pages of a document are the subject's: by printed name, by age within a clear cluster, or by dates.

    ``page_reads`` has one row per read of a page: ``patient_name``, ``age_texts`` (header and scan rows, as printed),
    ``days`` (its readable scan dates) and ``has_scans``. ``expected`` has the entered name key and age per document. A page
    has an age where all its reads print the same ages; it is the latest of them. An unnamed page with an age is accepted
    near the median of the document's ages, if more than half of these lie there, and near the entered age; one without
    only if accepted pages show all its dates. A page needs one aggregate over its reads and a document one pass over its
    pages: no page is joined to another.
    """
    key = text.person_key(F.col("patient_name"))
    each = page_reads.withColumn("ages", printed_ages(F.col("age_texts"))).withColumn("key", key).join(expected, "doc_id")
    pages = each.groupBy("doc_id", "page").agg(
        F.count_if(F.col("key") == F.col("expected_key")).alias("named"), F.count_if((F.col("key") != "") & (F.col("key") != F.col("expected_key"))).alias("other"),
        F.count(F.lit(1)).alias("reads"), F.count("ages").alias("aged_reads"), F.min("ages").alias("ages_lo"), F.max("ages").alias("ages_hi"),
        F.bool_or("has_scans").alias("has_scans"), F.max("entered_age").alias("entered_age"),
        F.array_distinct(F.flatten(F.collect_list("days"))).alias("days"))
    agreed = (F.col("aged_reads") == F.col("reads")) & (F.col("ages_lo") == F.col("ages_hi"))
    age = F.when(agreed, F.get("ages_lo", F.size("ages_lo") - 1)["value"])
    kind = (F.when(F.col("other") > 0, "other").when(F.col("named") == F.col("reads"), "named").when(F.col("age").isNotNull(), "aged")
            .when(~F.col("has_scans"), "blank").otherwise("ageless"))
    pages = pages.withColumn("age", age).withColumn("kind", kind)
    document = Window.partitionBy("doc_id")
    counted = F.when(F.col("kind").isin("named", "aged"), F.col("age"))
    pages = pages.withColumns({"center": F.median(counted).over(document), "aged_pages": F.count(counted).over(document)})
    pages = pages.withColumn("in_band", F.count_if(F.abs(counted - F.col("center")) <= tolerance).over(document))
    aged = (F.when(F.col("in_band") * 2 <= F.col("aged_pages"), "no_clear_cluster").when(F.abs(F.col("age") - F.col("center")) > tolerance, "age_off_center")
            .when(F.abs(F.col("age") - F.col("entered_age")) > tolerance, "age_off_entered").otherwise("accepted_by_age"))
    first = pages.withColumn("verdict", F.when(F.col("kind") == "other", "other_name").when(F.col("kind") == "named", "accepted_by_name").when(
        F.col("kind") == "blank", "blank").when(F.col("kind") == "aged", aged))
    valid = F.when(F.col("verdict").isin("accepted_by_name", "accepted_by_age"), F.col("days"))
    out = first.withColumn("valid_days", F.array_distinct(F.flatten(F.collect_list(valid).over(document))))
    shown = (F.size("days") > 0) & (F.size(F.array_except("days", "valid_days")) == 0)
    return out.select("doc_id", "page", "kind", "age", F.coalesce("verdict", F.when(shown, "accepted_by_dates").otherwise("unconfirmed")).alias("verdict"))
