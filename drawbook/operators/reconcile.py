"""Source-priority de-duplication and reconciliation to first, latest and history.

Every step is an aggregate with map-side combine over (subject, test[, day]); the one window holds a row per known test of
a subject, so one subject with a third of the rows costs no more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["subject_id", "test", "day"]


def _pick(condition: Column, *columns: str) -> Column:
    """The first row, in document order, that meets ``condition``."""
    return F.min(F.when(condition, F.struct("ord", "row_no", *columns)))


def signature(prefix: str = "") -> Column:
    value, disp, status = F.col(f"{prefix}value"), F.col(f"{prefix}disp"), F.col(f"{prefix}status")
    return F.struct(status.alias("status"), value.alias("value"), F.when(value.isNull(), disp).alias("text"))


def dedupe_sources(obs: DataFrame) -> DataFrame:
    """One row per subject, test and day with a verdict.

    A day's own current rows beat historical copies; a blank copy never contradicts a printed one. Verdicts:
    ``kept``, ``historical_differs`` (kept, with a warning), ``conflict`` (current rows differ) and ``excluded``
    (only historical copies, and they differ). Flag, range and unit come from the first chosen copy printing one.
    Copies are dealt by subject and test as they are: what a day holds of them is several times as wide as the few copies
    it has, and the days of a test then meet without another exchange. A stream deals them by its state instead.
    """
    current, printed = F.col("column_kind") == "current", F.col("status") != "not_performed"
    row = ("page", "doc_id", "status", "value", "disp")
    sig = signature()
    dealt = obs if obs.isStreaming else obs.repartition("subject_id", "test")
    grouped = dealt.groupBy(*KEYS).agg(
        _pick(current & printed, *row).alias("cur"),
        _pick(current & ~printed, *row).alias("cur_blank"),
        _pick(~current & printed, *row).alias("his"),
        _pick(~current & ~printed, *row).alias("his_blank"),
        F.min(F.when(current & printed, sig)).alias("cur_lo"), F.max(F.when(current & printed, sig)).alias("cur_hi"),
        F.min(F.when(~current & printed, sig)).alias("his_lo"), F.max(F.when(~current & printed, sig)).alias("his_hi"),
        *[_pick(side & printed & F.col(column).isNotNull() & (F.col(column).cast("string") != ""), *taken)
          .alias(f"{name}_{column}")
          for name, side in (("cur", current), ("his", ~current))
          for column, taken in (("flag", ("flag",)), ("range_display", ("range_lo", "range_hi", "range_display")),
                                ("unit", ("unit",)))],
        F.count(F.lit(1)).alias("copies"),
    )
    own = F.col("cur").isNotNull() | F.col("cur_blank").isNotNull()
    first = F.coalesce("cur", "cur_blank", "his", "his_blank")
    chosen_sig = F.struct(
        F.col("first.status").alias("status"), F.col("first.value").alias("value"),
        F.when(F.col("first.value").isNull(), F.col("first.disp")).alias("text"))

    def filled(column: str, field: str) -> Column:
        return F.when(F.col("own"), F.col(f"cur_{column}")[field]).otherwise(F.col(f"his_{column}")[field])

    verdict = (
        F.when(F.col("cur_lo") != F.col("cur_hi"), "conflict")
        .when(~F.col("own") & (F.col("his_lo") != F.col("his_hi")), "excluded")
        .when(F.col("own") & F.col("his").isNotNull()
              & ((F.col("his_lo") != chosen_sig) | (F.col("his_hi") != chosen_sig)), "historical_differs")
        .otherwise("kept"))
    return (
        grouped.withColumn("own", own).withColumn("first", first)
        .select(
            *KEYS, F.col("first.ord").alias("ord"), F.col("first.row_no").alias("row_no"),
            F.col("first.doc_id").alias("doc_id"), F.col("first.page").alias("page"),
            F.when(F.col("own"), "current").otherwise("historical").alias("column_kind"),
            F.col("first.status").alias("status"), F.col("first.value").alias("value"),
            F.col("first.disp").alias("disp"),
            filled("flag", "flag").alias("flag"),
            filled("range_display", "range_lo").alias("range_lo"),
            filled("range_display", "range_hi").alias("range_hi"),
            filled("range_display", "range_display").alias("range_display"),
            filled("unit", "unit").alias("unit"),
            "copies", verdict.alias("verdict"))
    )


def accepted(deduped: DataFrame) -> DataFrame:
    return deduped.filter(F.col("verdict").isin("kept", "historical_differs"))


def blocked_subjects(deduped: DataFrame) -> DataFrame:
    """Subjects with two differing current results on one day; nothing of theirs is scored."""
    return deduped.filter(F.col("verdict") == "conflict").select("subject_id").distinct()


POINT = ["day", "ord", "row_no", "value", "disp", "flag", "range_lo", "range_hi", "range_display", "unit"]


def has_result() -> Column:
    return F.col("day").isNotNull() & (F.col("value").isNotNull() | (F.coalesce(F.col("disp"), F.lit("")) != ""))


def distinct_results(rows: DataFrame) -> DataFrame:
    """One row per subject, test, day and value (text where there is no value): the first in document order."""
    text = F.when(F.col("value").isNull(), F.col("disp"))
    return (rows.filter(has_result())
            .groupBy("subject_id", "test", "day", "value", text.alias("text"))
            .agg(F.min(F.struct("ord", "row_no", "disp", "flag", "range_lo", "range_hi", "range_display", "unit"))
                 .alias("p"))
            .select("subject_id", "test", "day", "value", "p.*"))


def _points(ends: DataFrame, *more: str) -> DataFrame:
    stale = (F.col("results") == 1) & (F.col("first.day") != F.col("latest_day"))
    then = F.when((F.col("results") > 1) | stale, F.col("first"))
    now = F.when(~stale, F.col("last"))
    return ends.select(
        "subject_id", "test", "latest_day", "results",
        *[then[name].alias(f"then_{name}") for name in POINT],
        *[now[name].alias(f"now_{name}") for name in POINT], *more)


DAY_COUNTS = ["rows_in", "kept", "conflicts", "excluded"]


def reconcile_counted(deduped: DataFrame) -> DataFrame:
    """:func:`reconcile` of the accepted days with what became of all of them: rows in, and days by verdict.

    Tests without an accepted result stay, with 0 ``results``, so that their counts do.
    """
    verdict = F.col("verdict")
    fine = verdict.isin("kept", "historical_differs")
    point = F.when(fine & has_result(), F.struct(*POINT))
    ends = deduped.groupBy("subject_id", "test").agg(
        F.count(point).alias("results"), F.min(point).alias("first"), F.max(point).alias("last"), F.max(F.when(fine, F.col("day"))).alias("top"),
        F.sum("copies").alias("rows_in"), F.count_if(fine).alias("kept"),
        F.count_if(verdict == "conflict").alias("conflicts"), F.count_if(verdict == "excluded").alias("excluded"))
    return _points(ends.withColumn("latest_day", F.max("top").over(Window.partitionBy("subject_id"))), *DAY_COUNTS)


def reconcile(rows: DataFrame, latest: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """First (then) and latest (now) result per subject and test.

    A single result that is older than the subject's latest dated row is *then* only. ``latest`` may carry
    (subject_id, latest_day) when the rows passed in are already reduced. ``unique`` says that a subject, test and day
    has one row at most, as after de-duplication: the rows are then read once, and the subject's latest day is taken over
    its tests' latest days.
    """
    keys = ["subject_id", "test"]
    if unique and latest is None:
        point = F.when(has_result(), F.struct(*POINT))
        ends = rows.groupBy(*keys).agg(
            F.count(point).alias("results"), F.min(point).alias("first"), F.max(point).alias("last"), F.max("day").alias("top"))
        ends = ends.withColumn("latest_day", F.max("top").over(Window.partitionBy("subject_id"))).filter("results > 0").drop("top")
    else:
        results = distinct_results(rows)
        ends = results.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("results"), F.min(F.struct(*POINT)).alias("first"), F.max(F.struct(*POINT)).alias("last"))
        if latest is None:
            latest = rows.groupBy("subject_id").agg(F.max("day").alias("latest_day"))
        ends = ends.join(latest, "subject_id")
    return _points(ends)


def history(rows: DataFrame) -> DataFrame:
    """Every result strictly between first and latest, one row each with its position."""
    results = distinct_results(rows)
    ends = results.groupBy("subject_id", "test").agg(
        F.min(F.struct("day", "ord", "row_no", "value", "disp")).alias("lo"),
        F.max(F.struct("day", "ord", "row_no", "value", "disp")).alias("hi"))
    at = F.struct("day", "ord", "row_no", "value", "disp")
    return (results.join(ends, ["subject_id", "test"])
            .filter((at > F.col("lo")) & (at < F.col("hi")))
            .select("subject_id", "test", "day", "ord", "row_no", "value", "disp", "flag"))


def coalesce_mentions(rows: DataFrame) -> DataFrame:
    """Mentions of one test per document: NULLs are filled from later mentions, the range trio as one unit.

    Differing values are a conflict: the first mention stands and ``conflict`` is set.
    """
    grouped = rows.groupBy("subject_id", "doc_id", "test").agg(
        F.count(F.lit(1)).alias("mentions"), F.min("value").alias("lowest"), F.max("value").alias("highest"),
        F.min(F.struct("ord", "row_no", "value", "disp", "flag", "unit", "range_lo", "range_hi", "range_display")).alias("m"),
        _pick(F.col("value").isNotNull(), "value", "disp").alias("v"),
        _pick(F.col("flag").isNotNull(), "flag").alias("f"),
        _pick(F.coalesce("unit", F.lit("")) != "", "unit").alias("u"),
        _pick(F.col("range_display").isNotNull(), "range_lo", "range_hi", "range_display").alias("r"))
    conflict = F.coalesce(F.col("lowest") != F.col("highest"), F.lit(False))

    def merged(part: str, field: str) -> Column:
        return F.when(conflict, F.col(f"m.{field}")).otherwise(F.coalesce(F.col(f"m.{field}"), F.col(f"{part}.{field}")))

    unit = F.when(conflict | (F.coalesce("m.unit", F.lit("")) != ""), F.col("m.unit")).otherwise(
        F.coalesce(F.col("u.unit"), F.col("m.unit")))
    own_range = conflict | F.col("m.range_display").isNotNull()
    return grouped.select(
        "subject_id", "doc_id", "test", "mentions", merged("v", "value").alias("value"),
        merged("f", "flag").alias("flag"), unit.alias("unit"),
        *[F.when(own_range, F.col(f"m.{x}")).otherwise(F.col(f"r.{x}")).alias(x)
          for x in ("range_lo", "range_hi", "range_display")],
        conflict.alias("conflict"))


def latest_per_subject(rows: DataFrame) -> DataFrame:
    return rows.groupBy("subject_id").agg(F.max("day").alias("latest_day"))


def contributing_pages(obs: DataFrame) -> DataFrame:
    """Label of the copies behind one result in one document, with the section ``heading`` of its first copy where the
    rows carry one; the page list is bounded by that document."""
    heading = F.col("heading") if "heading" in obs.columns else F.lit(None).cast("string")
    grouped = obs.withColumn("heading", heading).groupBy("subject_id", "doc_id", "test", "day").agg(
        F.array_join(F.array_sort(F.collect_set("page")), ", ").alias("pages"),
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("ord", "row_no", "heading"))["heading"].alias("heading"))
    return grouped.withColumn("label", F.concat(
        F.lit("Order "), F.col("doc_id").cast("string"), F.lit(" (collected "), F.date_format("day", "MM/dd/yyyy"), F.lit(")"),
        F.coalesce(F.concat(F.lit("; "), F.nullif("heading", F.lit(""))), F.lit("")), F.lit("; pages "), F.col("pages"))).drop("heading")


def draw_bounds(obs: DataFrame) -> DataFrame:
    """First and latest draw, days between them, and the earliest and latest reading of each subject."""
    point = F.struct("day", "ord", "row_no", "test", "disp")
    per = obs.filter(has_result()).groupBy("subject_id").agg(F.min(point).alias("lo"), F.max(point).alias("hi"))
    days = F.datediff(F.col("hi.day"), F.col("lo.day"))
    return per.select(
        "subject_id", F.col("lo.day").alias("first_draw"), F.col("hi.day").alias("latest_draw"),
        days.cast("bigint").alias("days_between"), (days == 0).alias("single_draw"),
        F.col("lo.test").alias("baseline_test"), F.col("lo.disp").alias("baseline_disp"),
        F.col("hi.test").alias("latest_test"), F.col("hi.disp").alias("latest_disp"))
