"""A filter of fixed size for joins with few partners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIEVE_BITS = 22


def sieved(rows: DataFrame, column: str, wanted: DataFrame, wanted_column: str) -> DataFrame:
    """``rows`` that may have a partner in ``wanted``: all that do, and of the others about the share of marks set.

    The wanted values are marked in a table of ``2 ** SIEVE_BITS`` bits, whatever their number, which is sent to all tasks.
    Rows that can't match thus stay out of the shuffle of the join that follows.
    """
    mark = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << SIEVE_BITS))
    bits = wanted.select(mark(wanted_column).alias("__mark")).groupBy(F.shiftright("__mark", 6).alias("__word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(__mark % 64 as int))")).alias("__bits"))
    marked = rows.withColumn("__mark", mark(column)).withColumn("__at", F.shiftright("__mark", 6))
    return marked.join(F.broadcast(bits), F.col("__at") == F.col("__word")).where(F.getbit("__bits", F.col("__mark") % 64) == 1).select(*rows.columns)
