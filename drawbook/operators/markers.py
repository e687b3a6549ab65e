"""Thresholds, scores and roll-ups of reconciled results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawbook.constants import CATEGORY_SYSTEM, EMPTY_SYSTEM_SCORE, GOAL_SCORE, SYSTEMS
from drawbook.functions import scoring


def canonical_sex(col: Column) -> Column:
    low = F.lower(F.trim(col))
    return F.when(low.isin("m", "male"), "male").when(low.isin("f", "female"), "female")


def system_of(category: Column) -> Column:
    table = F.create_map(*[F.lit(part) for pair in CATEGORY_SYSTEM.items() for part in pair])
    return F.try_element_at(table, category)


def resolve_thresholds(rows: DataFrame, subjects: DataFrame, rules: DataFrame, ranges: DataFrame,
                       overlays: DataFrame) -> DataFrame:
    """Library thresholds by sex (unknown: the rule's default sex) with the treatment overlay.

    A test without a rule stays, without limits. The three rule tables hold a few rows per known test.
    """
    people = subjects.select("subject_id", canonical_sex(F.col("sex")).alias("sex"), "on_trt", "bhrt")
    base = rows.join(people, "subject_id", "left").join(rules, "test", "left")
    base = base.withColumn("range_sex", F.coalesce("sex", "default_sex"))
    limits = ranges.select(F.col("test"), F.col("sex").alias("range_sex"), F.col("lo").alias("s_lo"),
                                       F.col("hi").alias("s_hi"))
    joined = base.join(limits, ["test", "range_sex"], "left").join(overlays, "test", "left")
    overlaid = F.coalesce(F.col("sex") == "female", F.lit(False)) & F.coalesce(
        F.col("bhrt"), F.lit(False)) & F.col("o_lo").isNotNull()
    return joined.select(
        *rows.columns, "sex", "on_trt", "bhrt", "category", "kind", "direction", "optimal", "moderate", "inclusive",
        "moderate_inclusive", "low_ok_on_trt",
        F.when(overlaid, F.col("o_lo")).otherwise(F.col("s_lo")).alias("lo"),
        F.when(overlaid, F.col("o_hi")).otherwise(F.col("s_hi")).alias("hi"),
        overlaid.alias("overlay"))


def missing_threshold() -> Column:
    return (F.when(F.col("kind") == "bounded",
                   F.col("optimal").isNull() | F.col("moderate").isNull() | F.col("direction").isNull())
            .when(F.col("kind") == "range", F.col("lo").isNull() | F.col("hi").isNull())
            .otherwise(F.col("kind").isNull()))  # a test without a rule


def apply_fallbacks(markers: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Override, else library, else the printed range (now, else then), else unscored with a reason.

    A printed *then* range also replaces the limits of the *then* score of a range-kind test.
    """
    if overrides is not None:
        markers = markers.join(overrides.select("subject_id", "test", "over_lo", "over_hi"), ["subject_id", "test"], "left")
    else:
        markers = markers.withColumn("over_lo", F.lit(None).cast("double")).withColumn(
            "over_hi", F.lit(None).cast("double"))
    forced = F.col("over_lo").isNotNull() & F.col("over_hi").isNotNull()
    usable_now = F.col("now_range_lo") <= F.col("now_range_hi")
    usable_then = F.col("then_range_lo") <= F.col("then_range_hi")
    printed_lo = F.when(usable_now, F.col("now_range_lo")).when(usable_then, F.col("then_range_lo"))
    printed_hi = F.when(usable_now, F.col("now_range_hi")).when(usable_then, F.col("then_range_hi"))
    absent = missing_threshold()
    source = (F.when(forced, "override").when(absent & printed_lo.isNotNull(), "lab")
              .when(absent, None).when(F.col("kind") == "range", "library"))
    shaped = markers.withColumn("range_source", source).withColumn(
        "unscored_reason", F.when(~forced & absent & printed_lo.isNull(), "missing_threshold"))
    lab = F.col("range_source") == "lab"
    lo = F.when(forced, F.col("over_lo")).when(lab, printed_lo).otherwise(F.col("lo"))
    hi = F.when(forced, F.col("over_hi")).when(lab, printed_hi).otherwise(F.col("hi"))
    return (shaped.withColumn("kind", F.when(forced | lab, "range").otherwise(F.col("kind")))
            .withColumn("lo", lo).withColumn("hi", hi)
            .withColumn("low_ok_on_trt", F.col("low_ok_on_trt") & ~forced)
            .withColumn("then_lo", F.when(~forced & usable_then, F.col("then_range_lo")).otherwise(F.col("lo")))
            .withColumn("then_hi", F.when(~forced & usable_then, F.col("then_range_hi")).otherwise(F.col("hi")))
            .drop("over_lo", "over_hi"))


def score_markers(markers: DataFrame) -> DataFrame:
    """Scores of now and then, with the treatment rule for low values; no *then* value, no *then* score."""
    scored = scoring.with_score(markers, "now", "now_value", F.col("lo"), F.col("hi"))
    scored = scoring.with_score(scored, "then", "then_value", F.col("then_lo"), F.col("then_hi"))
    scored = scored.withColumn("then_tier", F.when(F.col("then_value").isNotNull() | (F.col("kind") == "categorical"), F.col("then_tier")))
    return scored.withColumn("system", system_of(F.col("category")))


def system_boxes(scored: DataFrame, **carried: Column) -> DataFrame:
    """(``subject_id``, ``boxes``): the six system scores of each subject, in one aggregate; a system without scores counts as empty.

    ``carried`` names more aggregates over the subject's scores, so that they are read once.
    """

    def within(system: str, column: Column) -> Column:
        return F.when(F.col("system") == system, column)

    aggregates = []
    for system in SYSTEMS:
        aggregates += [
            F.avg(within(system, F.col("now_pct"))).alias(f"{system}_now"),
            F.avg(within(system, F.col("then_pct"))).alias(f"{system}_then"),
            F.count_if((F.col("system") == system)).alias(f"{system}_n"),
            F.count_if((F.col("system") == system) & (F.col("now_tier") == "flag")).alias(f"{system}_flag"),
            F.count_if((F.col("system") == system) & (F.col("now_tier") == "moderate")).alias(f"{system}_moderate"),
            F.count_if((F.col("system") == system) & (F.col("now_tier") == "optimal")).alias(f"{system}_optimal"),
        ]
    wide = scored.groupBy("subject_id").agg(*aggregates, *(c.alias(name) for name, c in carried.items()))
    boxes = F.array(*[
        F.struct(
            F.lit(system).alias("system"),
            F.coalesce(F.bround(F.col(f"{system}_now")), F.lit(float(EMPTY_SYSTEM_SCORE))).cast("bigint").alias("now_score"),
            F.bround(F.col(f"{system}_then")).cast("bigint").alias("then_score"),
            *[F.col(f"{system}_{part}").alias(f"{part}_count") for part in ("n", "flag", "moderate", "optimal")])
        for system in SYSTEMS])

    def judged(box: Column) -> Column:
        then_zone, mean_zone = scoring.zone(box["then_score"]), scoring.zone(box["now_score"])
        worst = F.when(box["flag_count"] > 0, "flag").when(box["moderate_count"] > 0, "moderate").otherwise(mean_zone)
        return F.struct(
            box["system"].alias("system"), box["now_score"].alias("now_score"), box["then_score"].alias("then_score"),
            worst.alias("zone"), then_zone.alias("then_zone"),
            F.coalesce(scoring.zone_rank(mean_zone) > scoring.zone_rank(then_zone), F.lit(False)).alias("improved"),
            box["n_count"].alias("markers"), box["optimal_count"].alias("optimal"),
            box["moderate_count"].alias("moderate"), box["flag_count"].alias("flagged"),
            (box["n_count"] - box["optimal_count"] - box["moderate_count"] - box["flag_count"]).alias("not_scored"))

    return wide.select("subject_id", F.transform(boxes, judged).alias("boxes"), *carried)


def rollup_systems(scored: DataFrame) -> DataFrame:
    """All six system scores of each subject, one row each."""
    return system_boxes(scored).select("subject_id", F.inline("boxes"))


def overall_of_boxes(boxes: DataFrame, symptom: DataFrame) -> DataFrame:
    """``boxes`` with the overall figures now and then of their subject, as :func:`rollup_overall` has them."""

    def blood(field: str) -> Column:
        given = F.array_compact(F.transform("boxes", lambda b: b[field]))
        return F.bround(F.try_divide(F.aggregate(given, F.lit(0.0), lambda a, x: a + x), F.size(given)))

    none = F.lit(None).cast("double")
    joined = boxes.join(symptom.select("subject_id", "symptom_pct"), "subject_id", "left")
    return joined.select(
        *boxes.columns, F.bround(scoring.overall(blood("now_score"), F.col("symptom_pct"), none)).cast("bigint").alias("overall_now"),
        F.bround(scoring.overall(blood("then_score"), none, none)).cast("bigint").alias("overall_then"))


def rollup_overall(systems: DataFrame, symptom: DataFrame | None = None, structure: DataFrame | None = None) -> DataFrame:
    """Overall figure now and then: mean of rounded system scores, then the 60/30/10 weighting."""
    blood = systems.groupBy("subject_id").agg(
        F.bround(F.avg("now_score")).alias("blood_now"), F.bround(F.avg("then_score")).alias("blood_then"),
        F.count_if(F.col("improved")).alias("improved_systems"))
    blood = (blood.join(symptom.select("subject_id", "symptom_pct"), "subject_id", "left") if symptom is not None
             else blood.withColumn("symptom_pct", F.lit(None).cast("double")))
    blood = (blood.join(structure.select("subject_id", "structure_now", "structure_then"), "subject_id", "left")
             if structure is not None
             else blood.withColumn("structure_now", F.lit(None).cast("double"))
             .withColumn("structure_then", F.lit(None).cast("double")))
    now = scoring.overall(F.col("blood_now"), F.col("symptom_pct"), F.col("structure_now"))
    then = scoring.overall(F.col("blood_then"), F.lit(None).cast("double"), F.col("structure_then"))
    return blood.select(
        "subject_id", F.col("blood_now").cast("bigint").alias("blood_now"),
        F.bround(now).cast("bigint").alias("overall_now"), F.bround(then).cast("bigint").alias("overall_then"),
        "improved_systems")


def goal_ceiling(scored: DataFrame, female_confirmed: bool = False) -> DataFrame:
    """Scores with every countable non-optimal result lifted to the lowest optimal score."""
    countable = F.coalesce(F.col("now_tier").isin("moderate", "flag"), F.lit(False)) & F.col("now_pct").isNotNull() & (
        F.coalesce(F.col("range_source"), F.lit("")) != "lab")
    if not female_confirmed:
        countable = countable & (F.coalesce(F.col("sex"), F.lit("")) != "female")
    return (scored.withColumn("now_pct", F.when(countable, F.greatest(F.col("now_pct"), F.lit(GOAL_SCORE)))
                              .otherwise(F.col("now_pct")))
            .withColumn("now_tier", F.when(countable, F.lit("optimal")).otherwise(F.col("now_tier"))))


def symptom_score(answers: DataFrame) -> DataFrame:
    """Share of assessed domains without concern; NULL when no domain was assessed."""
    given = F.count("answer")
    return answers.groupBy("subject_id").agg(
        given.alias("assessed"),
        (F.try_divide((given * 2 - F.sum("answer")).cast("double"), given * 2) * 100).alias("symptom_pct"))
