"""Rows with columns of any name: input columns that bear the name of a result are kept under a free name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept_names(df: DataFrame, results: Sequence[str]) -> list[str]:
    """The columns' names; one named like a result becomes ``<name>_in`` (``<name>_in_in`` if that is taken too)."""
    taken = {c.lower() for c in [*df.columns, *results]}
    made = {r.lower() for r in results}
    out = []
    for name in df.columns:
        free = name
        while free.lower() in made or (free != name and free.lower() in taken):
            free += "_in"
        taken.add(free.lower())
        out.append(free)
    return out


def kept_columns(df: DataFrame, results: Sequence[str]) -> list[Column]:
    """The columns of ``df`` under their kept names."""
    return [F.col(f"`{name}`").alias(kept) for name, kept in zip(df.columns, kept_names(df, results), strict=True)]


class Numbered:
    """A frame whose columns are called ``c0``, ``c1``, ..., so that an operator's inner names can't meet them.

    Unlike a packed row, columns that nobody reads later can still be pruned.
    """

    def __init__(self, df: DataFrame, results: Sequence[str]):
        self.kept, self.names = kept_names(df, results), [c.lower() for c in df.columns]
        self.rows = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def column(self, name: str) -> Column:
        return F.col(f"c{self.names.index(name.lower())}")

    def restored(self, replaced: Sequence[str] = ()) -> list[Column]:
        """The columns under their kept names, without those that results replace."""
        return [F.col(f"c{i}").alias(kept) for i, (name, kept) in enumerate(zip(self.names, self.kept, strict=True)) if name not in replaced]
