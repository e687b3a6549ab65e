"""Moving results from scored to shown-as-reported, and building the reported list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawbook.constants import RANGE_BASIS_RATIO, REPORTED_GROUPS
from drawbook.functions import cells, text
from drawbook.functions.plan import compute_once
from drawbook.operators.names import is_urinalysis
from drawbook.operators.reconcile import has_result


def fasting_status(col: Column) -> Column:
    word = F.upper(F.trim(col))
    return (F.when(word.isin("Y", "YES", "FASTING"), "Y").when(word.isin("N", "NO", "NON-FASTING", "NONFASTING"), "N")
            .when(word == "", "BLANK").otherwise(word))


def draw_status(headers: DataFrame) -> DataFrame:
    """Fasting status per draw; headers that differ give CONFLICT."""
    status = fasting_status(F.col("fasting"))
    return (headers.filter(F.col("fasting").isNotNull()).groupBy("subject_id", "day")
            .agg(F.min(status).alias("lo"), F.max(status).alias("hi"))
            .select("subject_id", "day", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("CONFLICT").alias("status")))


def apply_fasting(obs: DataFrame, status: DataFrame, fasting_only: DataFrame) -> DataFrame:
    """Fasting-only tests of a draw not confirmed fasting are shown, not scored.

    Subjects whose documents print no status at all are unchanged.
    """
    known = status.select("subject_id").distinct().withColumn("prints_status", F.lit(True))
    draws = status.select("subject_id", "day", F.col("status").alias("status_"))
    joined = (obs.join(fasting_only, "test", "left")
              .join(draws, ["subject_id", "day"], "left").join(known, "subject_id", "left"))
    moved = (F.col("shown_name").isNotNull() & F.coalesce("prints_status", F.lit(False))
             & ~F.col("status_").eqNullSafe("Y") & has_result())
    note = (F.when(F.col("status_") == "N",
                   "This sample was taken without fasting; the result is listed and gets no score.")
            .otherwise("No record says that this sample was fasting; the result is listed and gets no score."))
    return joined.select(
        *obs.columns, moved.alias("moved"), F.when(moved, F.col("shown_name")).alias("shown_name"),
        F.when(moved, F.col("shown_group")).alias("shown_group"), F.when(moved, note).alias("note"))


def basis_ratio_differs(printed_range: Column, basis: Column, ratio: float = RANGE_BASIS_RATIO) -> Column:
    """The printed range is more than the allowed factor away from the library basis."""
    printed = cells.range_reference(printed_range)
    far = (F.try_divide(printed, basis) > ratio) | (F.try_divide(basis, printed) > ratio)
    return F.coalesce(far, F.lit(False))


def assay_differs(rows: DataFrame, listed: DataFrame, ratio: float = RANGE_BASIS_RATIO) -> DataFrame:
    """Reason a printed result must not be scored: a listed assay, a far-off range, or another unit."""
    joined = rows.join(listed.select("test").withColumn("listed", F.lit(True)), "test", "left")
    basis = F.coalesce("hi", "optimal")
    unit_differs = ((F.coalesce("unit", F.lit("")) != "") & (F.coalesce("library_unit", F.lit("")) != "")
                    & (text.unit_key(F.col("unit")) != text.unit_key(F.col("library_unit"))))
    reason = (F.when(F.coalesce("listed", F.lit(False)), "listed_assay")
              .when(basis_ratio_differs(F.col("range_display"), basis, ratio), "range_basis")
              .when(unit_differs, "unit"))
    return joined.select(*rows.columns, reason.alias("reason"))


def apply_assay_changes(obs: DataFrame, rules: DataFrame, basis: DataFrame,
                        ratio: float = RANGE_BASIS_RATIO) -> DataFrame:
    """Rows of a test whose printed range changes between draws, or is not its range basis, with the reason to move.

    The per-test facts are two map-side-combined extremes, joined back on (subject, test).
    """
    own = F.when(F.col("range_display").isNotNull(), cells.range_numbers(F.col("range_display")))
    rows = obs.filter(has_result()).withColumn("own", own)
    facts = rows.groupBy("subject_id", "test").agg(F.min("own").alias("own_lo"), F.max("own").alias("own_hi"))
    dims = rules.select("test", F.coalesce("hi", "optimal").alias("library_basis")).join(
        basis.select("test", cells.range_numbers(F.col("basis")).alias("basis_key")), "test", "left")
    joined = rows.join(facts, ["subject_id", "test"]).join(dims, "test", "left")
    across = F.coalesce(F.col("own_lo") != F.col("own_hi"), F.lit(False))
    off_basis = F.coalesce(
        (F.col("own_lo") != F.col("basis_key")) | (F.col("own_hi") != F.col("basis_key")), F.lit(False))
    why = (F.when(F.col("own").isNull(), F.when(across, "no_own_range"))
           .when(F.col("basis_key").isNotNull(), F.when(F.col("own") != F.col("basis_key"), "not_basis"))
           .when(basis_ratio_differs(F.col("range_display"), F.col("library_basis"), ratio), "range_basis"))
    return joined.select(*obs.columns, across.alias("range_changed"),
                         F.when(across | off_basis, why).alias("reason"))


def apply_unconfirmed(rows: DataFrame, phase_tests: list[str]) -> DataFrame:
    """Tests without a confirmed threshold for a female subject are shown, not scored.

    Cycle-phase tests lose range and flag too, unless the treatment is explicit.
    """
    from drawbook.operators.markers import missing_threshold

    phase = F.col("test").isin(phase_tests) & ~F.coalesce("bhrt", F.lit(False))
    female = F.coalesce(F.col("sex") == "female", F.lit(False))
    reason = F.when(female & phase, "cycle_phase").when(female & missing_threshold(), "no_threshold")
    return (rows.withColumn("reason", reason)
            .withColumn("flag", F.when(~F.coalesce(F.col("reason") == "cycle_phase", F.lit(False)), F.col("flag")))
            .withColumn("range_display",
                        F.when(~F.coalesce(F.col("reason") == "cycle_phase", F.lit(False)), F.col("range_display"))))


def split_no_result(rows: DataFrame) -> DataFrame:
    """``is_result`` is FALSE for headings, comment labels and cells that print no result."""
    name = F.lower(F.regexp_replace(text.squash(F.col("raw_name")), r":+\z", ""))
    raw = F.lower(text.squash(F.coalesce(F.col("raw_value"), F.lit(""))))
    label = F.trim(name).isin("comment", "comments", "note", "notes")
    printed = (raw != "") & ~raw.isin("tnp", "test not performed", "not performed")
    return rows.withColumn("is_result", printed & ~label)


def group_rank(col: Column) -> Column:
    """Library groups in their fixed order; other section headings between urinalysis and the flagged list."""
    order = F.create_map(*[F.lit(x) for i, g in enumerate(REPORTED_GROUPS) for x in (g, i * 2)])
    return F.coalesce(F.try_element_at(order, col), F.lit((len(REPORTED_GROUPS) - 1) * 2 - 1))


def match_reported(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Shown name and group of each unrecognised row, or NULL where it stays on the staff list only.

    Whether a test without a library name is flagged or readable is decided by its printed row: any of the row's cells may
    carry the flag, the unit or the range.

    ``dim`` (alias, canonical, grp) is a fixed library of a few hundred rows. Names meet it after the printed rows are
    read, so that only their own columns are sorted.
    """
    printed_row = Window.partitionBy(*[c for c in ("subject_id", "doc_id", "page", "section", "raw_name") if c in rows.columns])
    judged = rows.withColumns({
        "row_flagged": F.max(F.col("flag").isNotNull()).over(printed_row),
        "row_readable": F.max((F.coalesce("unit", F.lit("")) != "") | (F.coalesce("range_display", F.lit("")) != "")).over(printed_row)})
    keyed = judged.withColumn("k", text.name_key(F.col("raw_name"))).withColumn("urine", is_urinalysis(F.col("section")))
    lib = dim.groupBy(F.col("alias").alias("k"), (F.col("grp") == "Urinalysis").alias("urine")).agg(
        F.min("canonical").alias("lo"), F.max("canonical").alias("hi"), F.min("grp").alias("grp"))
    lib = lib.filter(F.col("lo") == F.col("hi")).select("k", "urine", F.col("lo").alias("lib_name"), F.col("grp").alias("lib_group"))
    joined = compute_once(keyed.join(lib, ["k", "urine"], "left"), bare=text.squash(F.col("raw_name")))
    flagged, readable = F.col("row_flagged"), F.col("row_readable")
    matched = F.col("lib_name").isNotNull()
    bare = F.col("bare")
    name = F.when(matched, F.col("lib_name")).when(
        flagged | readable, F.when(F.col("urine"), F.concat(F.lit("Urinalysis — "), bare)).otherwise(bare))
    group = (F.when(matched, F.col("lib_group"))
             .when(flagged, "Other Lab-Flagged Results")
             .when(readable, F.when(F.col("urine"), "Urinalysis").otherwise(
                 F.coalesce(text.squash(F.col("section")), F.lit("Other Lab Results")))))
    return joined.select(*rows.columns, name.alias("shown_name"), group.alias("shown_group"),
                         (~matched).alias("staff_listed"))


def build_reported(matched: DataFrame) -> DataFrame:
    """One row per subject, shown test and day; days with differing results carry ``verdict = conflict``.

    A current column beats historical copies. Range and unit are shown only where the copies agree on one. The copies are
    dealt by subject and shown test as they are, since what a day holds of them is wider than the few copies it has.
    """
    current = F.col("column_kind") == "current"
    rows = matched.filter(F.col("shown_name").isNotNull() & has_result()).withColumn("item", F.lower(text.squash(F.col("shown_name"))))
    sig = F.struct("disp", "flag")

    def unique(column: str, side: Column) -> Column:
        value = F.when(side & (F.coalesce(F.col(column), F.lit("")) != ""), F.col(column))
        return F.when(F.min(value) == F.max(value), F.min(value))

    days = rows.repartition("subject_id", "item").groupBy("subject_id", "item", "day").agg(
        F.min(F.struct("ord", "row_no", "shown_name", "shown_group")).alias("own"),
        F.min(F.when(current, sig)).alias("c_lo"), F.max(F.when(current, sig)).alias("c_hi"),
        F.min(F.when(~current, sig)).alias("h_lo"), F.max(F.when(~current, sig)).alias("h_hi"),
        unique("range_display", current).alias("range_display"), unique("unit", current).alias("unit"),
        F.count(F.lit(1)).alias("copies"))
    # Days per subject and test are few; the name and group of the first printed copy apply to all of them.
    first = F.min("own").over(Window.partitionBy("subject_id", "item"))
    lo, hi = F.coalesce("c_lo", "h_lo"), F.when(F.col("c_lo").isNotNull(), F.col("c_hi")).otherwise(F.col("h_hi"))
    differs = F.col("c_lo").isNotNull() & ((F.col("h_lo") != F.col("c_lo")) | (F.col("h_hi") != F.col("c_lo")))
    verdict = F.when(lo != hi, "conflict").when(F.coalesce(differs, F.lit(False)), "historical_differs").otherwise("kept")
    return days.withColumn("f", first).select(
        "subject_id", "item", F.col("f.shown_name").alias("shown_name"), F.col("f.shown_group").alias("shown_group"), "day",
        lo["disp"].alias("disp"), lo["flag"].alias("flag"), "range_display", "unit", "copies", verdict.alias("verdict"))


def also_on_file(reported: DataFrame) -> DataFrame:
    """Position of each shown day within its test, and whether ranges differ between days."""
    w = Window.partitionBy("subject_id", "item")
    kept = reported.filter(F.col("verdict") != "conflict")
    in_turn = w.orderBy("day")  # the days are there in this order already; a second one would be another sort
    place = (F.when(F.lead(F.lit(True)).over(in_turn).isNull(), "latest").when(F.row_number().over(in_turn) == 1, "earliest")
             .otherwise("also_on_file"))
    own_range = F.min("range_display").over(w) != F.max("range_display").over(w)
    return kept.select("subject_id", "item", "day", "disp", "flag", "range_display", place.alias("place"),
                       F.coalesce(own_range, F.lit(False)).alias("own_range"))


def drop_duplicates_shown(reported: DataFrame, scored: DataFrame, own_entry: DataFrame) -> DataFrame:
    """A shown row that repeats a scored (test, day) is left out; tests with their own entry are exempt.

    ``scored`` has (subject_id, test, day); ``reported`` carries the canonical ``test`` its printed name means.
    """
    exempt = own_entry.select("item").distinct().withColumn("exempt", F.lit(True))
    seen = scored.select("subject_id", "test", "day").distinct().withColumn("seen", F.lit(True))
    j = reported.join(exempt, "item", "left").join(seen, ["subject_id", "test", "day"], "left")
    duplicate = F.coalesce("seen", F.lit(False)) & ~F.coalesce("exempt", F.lit(False))
    return j.select(*reported.columns, duplicate.alias("duplicate"))


def dated_value_text() -> Column:
    flag = F.when(F.col("flag").isNotNull(), F.concat(F.lit(" "), F.col("flag"))).otherwise("")
    unit = F.when(F.coalesce("unit", F.lit("")) != "", F.concat(F.lit(" "), F.col("unit"))).otherwise("")
    return F.concat(F.col("disp"), flag, unit)


def unrecognized_values(rows: DataFrame) -> DataFrame:
    """Distinct dated values per subject, printed name and shown state, one row each."""
    shown = F.col("shown_name").isNotNull()
    return (rows.filter(has_result())
            .groupBy("subject_id", "raw_name", shown.alias("shown"), "day", dated_value_text().alias("value"))
            .agg(F.count(F.lit(1)).alias("rows"), F.min("range_display").alias("range_lo"),
                 F.max("range_display").alias("range_hi")))


def unrecognized_summary(rows: DataFrame) -> DataFrame:
    """Oldest and newest dated value, how many there are, and whether the printed ranges differ."""
    at = F.struct("day", "value")
    return (unrecognized_values(rows).groupBy("subject_id", "raw_name", "shown")
            .agg(F.count(F.lit(1)).alias("values"), F.sum("rows").alias("rows"), F.min(at).alias("a"), F.max(at).alias("z"),
                 F.coalesce(F.min("range_lo") != F.max("range_hi"), F.lit(False)).alias("ranges_differ"))
            .select("subject_id", "raw_name", "shown", "values", "rows", F.col("a.day").alias("first_day"),
                    F.col("a.value").alias("first_value"), F.col("z.day").alias("last_day"),
                    F.col("z.value").alias("last_value"), "ranges_differ"))


def review_items(rows: DataFrame) -> DataFrame:
    """Printed names the library does not know, left out or shown, with their row counts."""
    shown = F.when(F.col("shown_name").isNotNull(), "shown").otherwise("left_out")
    return (rows.filter(F.col("staff_listed")).groupBy(shown.alias("handling"), F.lower(text.squash(F.col("raw_name"))).alias("name"))
            .agg(F.count(F.lit(1)).alias("rows")))


def coverage_gaps(rows: DataFrame, scored: DataFrame, shown: DataFrame, staff: DataFrame) -> DataFrame:
    """Printed rows that reached neither the scores, the shown list nor the staff list."""
    folded = F.lower(text.squash(F.col("name")))  # names differ in case and spaces only
    names = (scored.select("subject_id", "name").unionByName(shown.select("subject_id", "name"))
             .unionByName(staff.select("subject_id", "name")).select("subject_id", folded.alias("_name")).distinct())
    return rows.withColumn("_name", folded).join(names, ["subject_id", "_name"], "left_anti").drop("_name")
