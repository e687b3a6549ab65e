"""Keeping expensive expressions from being repeated by the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions are evaluated exactly once per row.

    They pass through a one-element generator. Predicates on them, including the size checks inferred for a later
    ``explode``, then test the value; pushed below a plain projection they would repeat the whole expression, and
    inside an array lambda they would repeat it once per element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
