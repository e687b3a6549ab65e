"""Scores as Column expressions. Every rounding is half-even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawbook.constants import BODY_FAT_BANDS, GOAL_SCORE, TIER_SCORES, VAT_BANDS
from drawbook.functions import cells
from drawbook.functions.plan import compute_once


def bounded_tier(value, direction, optimal, moderate, inclusive, moderate_inclusive) -> Column:
    """Tier against a one-sided threshold. Equality at either cutoff follows its own inclusive switch."""
    lower = direction == "lower"

    def within(cutoff: Column, closed: Column) -> Column:
        return F.when(value == cutoff, closed).otherwise((value < cutoff) == lower)

    return (F.when(optimal.isNull() | moderate.isNull(), "unscored").when(value.isNull(), F.lit(None))
            .when(within(optimal, inclusive), "optimal").when(within(moderate, moderate_inclusive), "moderate")
            .otherwise("flag"))


def bounded_pct(tier, value, direction, optimal, moderate) -> Column:
    """Percentage of a value whose bounded tier is known."""
    lower = direction == "lower"
    width = F.when(moderate == optimal, 1.0).otherwise(F.abs(moderate - optimal))
    beyond = F.coalesce(F.try_divide(F.abs(value - moderate), moderate), F.lit(1.0))
    best = F.when(lower, F.greatest(F.lit(88.0), 100 - F.coalesce(F.try_divide(value, optimal), F.lit(0.0)) * 12)).otherwise(
        88 + F.least(F.lit(12.0), (value - optimal) / F.greatest(optimal, F.lit(1.0)) * 12))
    middle = F.when(lower, 88 - (value - optimal) / width * 38).otherwise(50 + (value - moderate) / width * 38)
    return (F.when(tier == "optimal", best).when(tier == "moderate", F.greatest(F.lit(50.0), middle))
            .when(tier == "flag", F.greatest(F.lit(8.0), 50 - beyond * 90)))


def widths_outside(value, lo, hi) -> Column:
    """How many range widths a value lies outside its range; 0 inside, NULL when the range has no width."""
    return F.when(value.between(lo, hi), 0.0).otherwise(
        F.when(hi > lo, F.when(value < lo, lo - value).otherwise(value - hi) / (hi - lo)))


def range_tier(value, lo, hi, away, lab) -> Column:
    """Tier against a two-sided range; a range the source printed (``lab``) is in or out, nothing between."""
    return (F.when(lo.isNull() | hi.isNull(), "unscored").when(value.isNull(), F.lit(None))
            .when(away == 0, "optimal").when(~lab & (away <= 1), "moderate").otherwise("flag"))


def range_pct(tier, away, lab) -> Column:
    return (F.when(tier == "optimal", 96.0).when(tier == "moderate", 88 - away * 38)
            .when(tier == "flag", F.when(lab, 20.0).otherwise(
                F.greatest(F.lit(8.0), F.coalesce(50 - (away - 1) * 90, F.lit(8.0))))))


def with_score(df: DataFrame, prefix: str, value: str, lo: Column, hi: Column) -> DataFrame:
    """Add ``<prefix>_pct`` and ``<prefix>_tier``.

    A categorical result is the printed word of ``<prefix>_disp``: expected words are good, others moderate, and a test
    without a word has no score. Distance, tier and percentage are separate projections, so each is evaluated once per row and the generated
    code stays small enough to be compiled.
    """
    c = F.col
    v, away, tier = c(value), c("_away"), c("_tier")
    bounded, lab = c("kind") == "bounded", F.coalesce(c("range_source") == "lab", F.lit(False))
    low = F.coalesce(c("low_ok_on_trt") & (v < c("lo")), F.lit(False))
    treated = F.coalesce(c("on_trt"), F.lit(False))
    df = df.withColumns({"_lo": lo, "_hi": hi})
    df = df.withColumn("_away", widths_outside(v, c("_lo"), c("_hi")))
    worded = c("kind") == "categorical"
    printed = F.coalesce(c(f"{prefix}_disp"), F.lit("")) if f"{prefix}_disp" in df.columns else F.lit("")
    good = F.when(v.isNull() & (printed != ""), cells.is_good(printed))
    df = df.withColumn("_tier", F.when(bounded, bounded_tier(
        v, c("direction"), c("optimal"), c("moderate"), c("inclusive"), c("moderate_inclusive"))).when(worded, categorical_tier(good)).otherwise(
        range_tier(v, c("_lo"), c("_hi"), away, lab)))
    df = df.withColumn("_pct", F.when(bounded, bounded_pct(tier, v, c("direction"), c("optimal"), c("moderate"))).when(worded, categorical_pct(good)).otherwise(
        range_pct(tier, away, lab)))
    return compute_once(df, **{
        f"{prefix}_pct": F.when(low, F.when(treated, 96).otherwise(20)).otherwise(F.bround(c("_pct")).cast("int")),
        f"{prefix}_tier": F.when(low, F.when(treated, "optimal").otherwise("flag")).otherwise(tier),
    }).drop("_lo", "_hi", "_away", "_tier", "_pct")


def categorical_tier(good: Column) -> Column:
    return F.when(good, "optimal").when(~good, "moderate")


def categorical_pct(good: Column) -> Column:
    return F.when(good, 96).when(~good, 55)


def zone(score: Column) -> Column:
    return (F.when(score >= GOAL_SCORE, F.lit("optimal")).when(score >= 50, F.lit("moderate"))
            .when(score.isNotNull(), F.lit("flag")))


def zone_rank(tier: Column) -> Column:
    return F.when(tier == "flag", 0).when(tier == "moderate", 1).when(tier == "optimal", 2)


def overall(blood: Column, symptom: Column, structure: Column) -> Column:
    """60/30/10 weighted mean; an absent part gives its weight to the parts that are present."""
    parts = [(blood, 60.0), (symptom, 30.0), (structure, 10.0)]
    total = sum((F.when(col.isNotNull(), col * weight).otherwise(0.0) for col, weight in parts), F.lit(0.0))
    weights = sum((F.when(col.isNotNull(), F.lit(weight)).otherwise(0.0) for col, weight in parts), F.lit(0.0))
    return F.when(blood.isNotNull(), total / weights)


def _banded(value: Column, bands: list[tuple[float, float | None, str]]) -> Column:
    out = F.lit(None).cast("int")
    for lo, hi, tier in bands:
        hit = value >= lo if hi is None else (value >= lo) & (value < hi)
        out = F.when(hit, F.lit(TIER_SCORES[tier])).otherwise(out)
    return out


def body_fat_score(pct: Column, sex: Column) -> Column:
    by_sex = {name: [(lo, hi, tier) for s, lo, hi, tier in BODY_FAT_BANDS if s == name] for name in ("female", "male")}
    return (F.when(F.lower(sex) == "female", _banded(pct, by_sex["female"]))
            .when(F.lower(sex) == "male", _banded(pct, by_sex["male"])))


def vat_score(area: Column) -> Column:
    return _banded(area, VAT_BANDS)


def structure_score(body_fat: Column, vat_area: Column, sex: Column) -> Column:
    """Mean of the body-composition scores that are present."""
    fat, vat = body_fat_score(body_fat, sex), vat_score(vat_area)
    count = fat.isNotNull().cast("int") + vat.isNotNull().cast("int")
    return F.when(count > 0, (F.coalesce(fat, F.lit(0)) + F.coalesce(vat, F.lit(0))) / count)


def optimized_side(m) -> Column:
    """Which side of the optimal band a non-optimal numeric result is on; ``m`` maps names to Columns."""
    bounded = (m("kind") == "bounded") & m("optimal").isNotNull()
    ranged = (m("kind") == "range") & m("lo").isNotNull() & m("hi").isNotNull()
    side = (F.when(bounded & (m("direction") == "lower") & (m("now_value") >= m("optimal")), F.lit("above"))
            .when(bounded & (m("direction") == "higher") & (m("now_value") <= m("optimal")), F.lit("below"))
            .when(ranged & (m("now_value") < m("lo")), F.lit("below"))
            .when(ranged & (m("now_value") > m("hi")), F.lit("above")))
    eligible = m("now_tier").isin("moderate", "flag") & m("now_value").isNotNull() & ~F.coalesce(
        m("range_source") == "lab", F.lit(False))
    return F.when(F.coalesce(eligible, F.lit(False)), side)
