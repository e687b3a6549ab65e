"""Resolving printed names against alias dimensions, and name-based checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawbook.functions import text


def is_urinalysis(section: Column) -> Column:
    """A section heading that names urinalysis as a word."""
    return F.coalesce(F.lower(section).rlike(r"(?<![a-z])urinalysis(?![a-z])"), F.lit(False))


def _unique(dim: DataFrame, key: Column, name: str) -> DataFrame:
    """One row per key and namespace: how many tests claim it, and the test when exactly one does."""
    return (dim.groupBy(key.alias("k"), "is_urine")
            .agg(F.min("canonical").alias("lo"), F.max("canonical").alias("hi"))
            .select(F.col("k").alias(f"{name}_key"), F.col("is_urine").alias(f"{name}_urine"),
                    F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias(f"{name}_match"),
                    (F.col("lo") != F.col("hi")).alias(f"{name}_ambiguous")))


def resolve_names(rows: DataFrame, dim_alias: DataFrame) -> DataFrame:
    """Exact, section-scoped name resolution with a look-alike fallback.

    The alias dimension is reduced to one row per key first, so the joins add no rows and need no aggregation of
    the (large) row side. No size is assumed for it: the optimizer broadcasts it when its statistics allow.
    """
    exact = _unique(dim_alias, text.name_key(F.col("alias")), "exact")
    folded = _unique(dim_alias, text.folded_key(F.col("alias")), "folded")
    keyed = (rows.withColumn("name_key", text.name_key(F.col("raw_name")))
             .withColumn("folded_key", F.translate("name_key", "i1|0", "lllo"))
             .withColumn("is_urine", is_urinalysis(F.col("section"))))
    joined = (
        keyed.join(exact, (F.col("name_key") == F.col("exact_key"))
                   & (F.col("is_urine") == F.col("exact_urine")), "left")
        .join(folded.withColumnRenamed("folded_key", "fold_dim_key"),
              (F.col("folded_key") == F.col("fold_dim_key")) & (F.col("is_urine") == F.col("folded_urine")), "left"))
    ambiguous = F.coalesce(F.col("exact_ambiguous"), F.lit(False))
    kind = (F.when(ambiguous, "ambiguous").when(F.col("exact_match").isNotNull(), "exact")
            .when(F.col("folded_match").isNotNull(), "look_alike").otherwise("none"))
    return joined.select(
        *rows.columns, "name_key", "is_urine", kind.alias("match_kind"),
        F.when(~ambiguous, F.coalesce("exact_match", "folded_match")).alias("canonical"))


def resolve_panel(rows: DataFrame, dim_panel: DataFrame) -> DataFrame:
    """A row printed under a panel's own lab code is a separate test of its own."""
    dim = dim_panel.select(F.col("panel_name"), F.upper("panel_code").alias("panel_code"), "shown_name", "shown_group")
    keyed = rows.withColumn("panel_key", F.lower(text.squash(F.col("raw_name"))))
    return (keyed.join(dim, (F.col("panel_key") == F.col("panel_name"))
                       & (F.upper(F.trim("lab_code")) == F.col("panel_code")), "left")
            .select(*rows.columns, "shown_name", "shown_group"))


def check_unsectioned(rows: DataFrame, scoped_names: DataFrame) -> DataFrame:
    """Rows printed under no section, and names whose meaning depends on the section.

    An unsectioned row that repeats a sectioned row of its document exactly is ignored; any other is excluded. A
    scoped name under a section that is none of its own is excluded.
    """
    key = text.name_key(F.col("raw_name"))
    rows = rows.withColumn("key", key)
    repeated = rows.filter(F.col("section").isNotNull()).select(
        F.col("doc_id").alias("r_doc"), F.col("key").alias("r_key"), F.col("value").alias("r_value"),
        F.col("flag").alias("r_flag")).distinct().withColumn("repeats", F.lit(True))
    scope = scoped_names.groupBy(F.col("scoped_name").alias("key")).agg(F.collect_set("allowed").alias("allowed"))
    # Keyed by document, name, value and flag, so one long document spreads over its rows.
    same = ((F.col("doc_id") == F.col("r_doc")) & (F.col("key") == F.col("r_key"))
            & F.col("value").eqNullSafe(F.col("r_value")) & F.col("flag").eqNullSafe(F.col("r_flag")))
    marked = rows.join(repeated, same, "left").join(scope, "key", "left")
    out_of_scope = F.col("allowed").isNotNull() & ~F.exists(
        "allowed", lambda word: F.contains(F.upper(F.col("section")), word))
    verdict = (F.when(F.col("section").isNull() & F.col("repeats"), "repeat_ignored")
               .when(F.col("section").isNull(), "no_section")
               .when(F.coalesce(out_of_scope, F.lit(False)), "scope_unclear")
               .otherwise("kept"))
    return marked.select(*[c for c in rows.columns if c != "key"], verdict.alias("verdict"))


def match_people(pairs: DataFrame, entered: str = "entered", printed: str = "printed") -> DataFrame:
    """Same words in any order and case, or a first name with the last initial; nothing fuzzier."""
    e, p = F.col(entered), F.col(printed)
    words_equal = (text.person_key(e) == text.person_key(p)) & (text.person_key(p) != "")
    initial = F.array_contains(text.person_initial_keys(e), text.person_printed_key(p))
    how = (F.when(F.coalesce(words_equal, F.lit(False)), "words")
           .when(F.coalesce(initial, F.lit(False)), "initial").otherwise("none"))
    return pairs.withColumn("match", how)


def apply_allowlist(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items whose handling the allow-list already decides; all others need review.

    ``known`` has name, handling and an optional array of results that must cover every printed result.
    """
    key = F.lower(text.squash(F.col("raw_name")))
    dim = known.select(F.col("name").alias("known_name"), "handling", F.col("results").alias("allowed"))
    joined = items.join(dim, (key == F.col("known_name")) & (F.col("handled_as") == F.col("handling")), "left")
    results = F.transform("results", lambda r: F.regexp_replace(F.lower(text.squash(r)), r"\s*:\z", ""))
    allowed = F.col("allowed").isNull() | ((F.size(results) > 0) & (F.size(F.array_except(results, "allowed")) == 0))
    known_here = F.col("handling").isNotNull() & allowed
    return joined.select(*items.columns, F.when(known_here, "known").otherwise("review").alias("decision"))


def missing_units(rows: DataFrame) -> DataFrame:
    """Numeric results printed without a unit; ratios, pH and specific gravity have none."""
    exempt = F.lower(text.squash(F.col("raw_name"))).rlike(r"\bratio\b|^ph\z|^specific gravity\z")
    numeric = F.col("value").isNotNull() | F.col("disp").rlike("^[<>]")
    return (rows.filter((F.coalesce("unit", F.lit("")) == "") & numeric & ~exempt)
            .groupBy("doc_id", "raw_name").agg(F.count(F.lit(1)).alias("rows")))


def header_checks(subjects: DataFrame, headers: DataFrame, scans: DataFrame, tolerance: int) -> DataFrame:
    """Entered against printed date, age and sex, and printed age against the ages on scans; one row per issue."""
    scan_ages = scans.groupBy("subject_id").agg(F.min("scan_age").alias("lo_age"), F.max("scan_age").alias("hi_age"))
    j = subjects.join(headers, "subject_id").join(scan_ages, "subject_id", "left")
    issues = F.array_compact(F.array(
        F.when(F.col("printed_day") != F.col("entered_day"), "date"),
        F.when(F.col("printed_age") != F.col("entered_age"), "age"),
        F.when((F.abs(F.col("lo_age") - F.col("printed_age")) > tolerance)
               | (F.abs(F.col("hi_age") - F.col("printed_age")) > tolerance), "scan_age"),
        F.when(F.col("printed_sex") != F.col("entered_sex"), "sex")))
    return j.select("subject_id", "doc_id", F.explode(issues).alias("rule"))
