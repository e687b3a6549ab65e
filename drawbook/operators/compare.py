"""Fact rows and comparison of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawbook.operators.markers import overall_of_boxes, system_boxes

def _line(*parts: Column) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _us(day: str) -> Column:
    return F.date_format(day, "MM/dd/yyyy")


def fact_rows(scored: DataFrame, reported: DataFrame, scans: DataFrame, symptom: DataFrame) -> DataFrame:
    """Canonical M/L/D/S/O rows of everything that must not change by accident; one row per fact.

    The scores are read once: the lines of a subject's known tests stand beside its system scores in one aggregate.
    """

    def state(tier: str) -> Column:
        return F.when(F.col(tier).isin("optimal", "moderate", "flag"), F.col(tier)).otherwise("not scored")

    def point(side: str) -> Column:
        return F.when(F.col(f"{side}_day").isNotNull() & (F.coalesce(f"{side}_disp", F.lit("")) != ""), _line(
            F.lit("M"), F.col("test"), _us(f"{side}_day"), F.col(f"{side}_disp"), F.col(f"{side}_flag"), state(f"{side}_tier")))

    shown = reported.filter(F.col("verdict") != "conflict").select("subject_id", F.lit("L").alias("kind"), _line(
        F.lit("L"), F.col("shown_group"), F.col("shown_name"), _us("day"), F.col("disp"), F.col("flag"), F.col("range_display")).alias("row"))
    bodies = scans.select("subject_id", F.lit("D").alias("kind"), _line(
        F.lit("D"), _us("day"), F.concat(F.lit("total "), F.coalesce(F.col("total").cast("int").cast("string"), F.lit("—"))),
        F.concat(F.lit("body fat "), F.coalesce("body_fat_text", F.lit("—")), F.when(F.col("computed"), " (computed)").otherwise(""))).alias("row"))
    def fact(kind: str, row: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), row.alias("row"))

    def box_line(b: Column) -> Column:
        return _line(F.lit("S"), b["system"], *(F.concat(F.lit(f"{said} "), b[field]) for said, field in (
            ("optimal", "optimal"), ("moderate", "moderate"), ("flag", "flagged"), ("not scored", "not_scored"), ("score", "now_score"))), b["zone"])

    lines = F.flatten(F.collect_list(F.array_compact(F.array(point("then"), point("now")))))
    per = overall_of_boxes(system_boxes(scored, lines=lines), symptom)
    whole = _line(F.lit("O"), F.concat(F.lit("overall now "), F.col("overall_now")),
                  F.concat(F.lit("first visit "), F.coalesce(F.col("overall_then").cast("string"), F.lit("—"))))
    of_scores = per.select("subject_id", F.inline(F.concat(
        F.transform("lines", lambda x: fact("M", x)),
        F.transform(F.filter("boxes", lambda b: b["markers"] > 0), lambda b: fact("S", box_line(b))), F.array(fact("O", whole)))))
    return of_scores.unionByName(shown).unionByName(bodies)


def compare_exact(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows missing from, or extra in, ``actual``, as often as they are: one signed count per row."""
    both = expected.withColumn("_n", F.lit(1)).unionByName(actual.withColumn("_n", F.lit(-1)))
    off = both.groupBy(*expected.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    side = F.when(F.col("_n") > 0, "missing").otherwise("extra")
    return off.withColumn("side", side).withColumn("_k", F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int")))).drop("_n", "_k")


def compare_subset(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected rows (fields ``*`` or ``prefix *`` open) that no actual row matches.

    Each actual row is keyed once per distinct pattern of open fields, so matching is an equi join on the literal
    fields; only prefix fields are tested on the joined rows, and a wanted row ends at its first match. There are at most
    a few patterns: they travel to the rows, which would all meet in one task if they were dealt by their number of fields.
    """

    def fields(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.transform(F.split("row", r"\|"), lambda x: F.trim(x)))

    def open_field(x: Column) -> Column:
        return (x == "*") | x.endswith(" *")

    want = fields(expected.distinct(), "want")
    want = want.withColumn("mask", F.array_join(F.transform("want", lambda x: F.when(open_field(x), "0").otherwise("1")), ""))
    want = want.withColumn("key", F.array_join(F.transform("want", lambda x: F.when(open_field(x), "*").otherwise(x)), "|"))
    masks = want.select("mask", F.length("mask").alias("n")).distinct()
    have = fields(actual.distinct(), "have").withColumn("n", F.size("have")).join(F.broadcast(masks), "n")
    have = have.withColumn("key", F.array_join(F.transform("have", lambda x, i: F.when(F.substr("mask", i + 1, F.lit(1)) == "0", "*").otherwise(x)), "|"))
    have = have.select("subject_id", "mask", "key", "have")
    fits = F.forall(F.arrays_zip("want", "have"), lambda z: ~z["want"].endswith(" *") | z["have"].startswith(F.substr(
        z["want"], F.lit(1), F.length(z["want"]) - 1)))
    same = [want[k] == have[k] for k in ("subject_id", "mask", "key")]
    return want.join(have, [*same, fits], "left_anti").select("subject_id", "row")


def diff_snapshots(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows on one side only, per case."""
    a = before.distinct().withColumn("a", F.lit(True))
    b = after.distinct().withColumn("b", F.lit(True))
    j = a.join(b, keys, "full_outer")
    return j.filter(F.col("a").isNull() | F.col("b").isNull()).select(
        *keys, F.when(F.col("b").isNull(), "removed").otherwise("added").alias("change"))


def flatten_record(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, path, value) rows of the named columns."""
    entries = F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(key, F.inline(entries))


def diff_records(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Paths added, removed or changed between two flattened records."""
    a = before.select(key, "path", F.struct("value").alias("a"))
    b = after.select(key, "path", F.struct("value").alias("b"))
    j = a.join(b, [key, "path"], "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(
        ~F.col("a.value").eqNullSafe(F.col("b.value")), "changed")
    return j.withColumn("change", change).filter(F.col("change").isNotNull()).select(
        key, "path", "change", F.col("a.value").alias("before"), F.col("b.value").alias("after"))
