"""Explicit statements in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The only wordings that state, or deny, a treatment.
_POST = r"\bpost[- ]?menopausal\b"
_NOT_POST = r"\b(?:not|never|pre)[- ]?post[- ]?menopausal\b"
_BHRT = r"\b(?:bhrt|bioidentical hormone replacement|hormone replacement therapy|hormone replacement)\b"
_NOT_BHRT = r"\b(?:not|never)\s+(?:on\s+)?(?:bhrt|hormone replacement(?: therapy)?)\b"
_TRT = (
    r"\b(?:on|start(?:ing|ed)?|begin(?:ning)?|active(?:ly on)?)\s+(?:testosterone\s+)?(?:trt|replacement therapy)\b"
    r"|\btestosterone\s+(?:replacement therapy|injections?|therapy)\s+(?:is\s+)?(?:active|current|started|ongoing)\b"
    r"|\bon\s+testosterone\s+injections?\b"
    r"|\bactive\s+testosterone\s+(?:replacement\s+)?therapy\b"
)
_NOT_TRT = r"\b(?:not|never|no longer)\s+(?:on\s+)?(?:trt|testosterone(?: replacement therapy| injections?| therapy))\b"


def stated_status(text: Column) -> Column:
    """STRUCT<bhrt, on_trt>: TRUE only where stated and not denied, else NULL."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bhrt = low.rlike(_POST) & low.rlike(_BHRT) & ~low.rlike(_NOT_POST) & ~low.rlike(_NOT_BHRT)
    trt = low.rlike(_TRT) & ~low.rlike(_NOT_TRT)
    return F.struct(F.when(bhrt, F.lit(True)).alias("bhrt"), F.when(trt, F.lit(True)).alias("on_trt"))


def resolve_status(section_present: Column, section_value: Column, stated: Column) -> Column:
    """A treatment section, when the note has one, decides; otherwise the explicit statement does."""
    return F.when(section_present, section_value).otherwise(stated)


def status_mismatch(section_present: Column, section_value: Column, stated: Column) -> Column:
    return section_present & F.coalesce(stated, F.lit(False)) & ~F.coalesce(section_value, F.lit(False))
