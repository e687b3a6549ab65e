"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected the same number of times, ``target / source size``. The documents of a source
stand in one order; the prefix sums of the expected copies, shifted by one offset of the source, cross whole numbers,
and a document is taken once for every whole number that its own interval crosses. Documents of like size stand
together, so the words taken follow the target closely even where sizes differ by orders of magnitude.

The position of a document is the sum of three counts, none of which needs a source in one task: documents in smaller
size classes of the source, documents in earlier hash bins of its class, and its rank within the bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawbook.llm.rows import Numbered, free_name
from drawbook.session import write_table

WORD = r"[^\x20\x09-\x0D]+"
RESULTS = ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def size_class(size: Column) -> Column:
    """Sortable class of a size: number of binary digits, then the leading four of them."""
    digits = F.bin(size)
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 4))


def targets(sources: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Targets of a table with one row per source (``__known``, ``__source``, ``__words``).

    The words of all sources are shared by weight; no source gets more than ``cap`` times its own words, and what a
    capped source leaves is shared among the others by weight. With caps in order of cap over weight, the capped sources
    are the first ones, so one running sum finds the level at which the rest stop.
    """
    everywhere = Window.partitionBy()
    by_name = Window.orderBy(F.desc("__known"), "__source")
    by_ratio = Window.orderBy("__ratio", F.desc("__known"), "__source")
    weight = F.array([F.lit(float(w)) for w in weights])[((F.row_number().over(by_name) - 1) % len(weights)).cast("int")]
    ranked = (
        sources.withColumn("__weight", weight)
        .withColumn("__cap", F.lit(cap) * F.col("__words"))
        .withColumn("__ratio", F.col("__cap").cast("double") / F.col("__weight"))
    )
    before = F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("__weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("__level", (F.sum("__words").over(everywhere) - before).cast("double") / left)
    level = F.min(F.when(F.col("__ratio") >= F.col("__level"), F.struct("__ratio", "__level"))).over(everywhere)["__level"]
    return levels.withColumn("__target", F.least(F.col("__cap").cast("double"), level * F.col("__weight"))).select(
        "__known", "__source", "__words", "__target")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix", id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_copies`` and ``mix_taken``.

    * Sources stand in code-point order, the null source last, and take ``weights`` in turn.
    * ``mix_copies`` is 0 to ``cap``. A null or empty text has size 0; it may be copied, but takes no words. In a source
      without any words the target is 0 and nothing is copied.
    * Every row counts by itself: repeated rows and null ids are placed like any other (rows equal in id and size share
      their places in any order). Input columns with the names above are kept under a free
      name (``rows.kept_names``). An empty table gives an empty one.
    * The result depends on ids, sizes and ``seed`` only, not on partitions, so a rerun agrees.
    """
    table = Numbered(docs, RESULTS)
    source, ident = table.column(source_col), F.coalesce(table.column(id_col).cast("string"), F.lit(""))
    place = {
        "mix_size": word_count(table.column(text_col)),
        "__known": source.isNotNull(),
        "__source": F.coalesce(source.cast("string"), F.lit("")),
        "__bin": F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident)), 1, 3),
    }
    placed = table.rows.withColumns(place).withColumn("__class", size_class(F.col("mix_size")))
    keys = ["__known", "__source", "__class", "__bin"]
    bins, _ = write_table(placed.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum("mix_size").alias("__sum")), "mix-bins")

    classes = bins.groupBy("__known", "__source", "__class").agg(F.sum("__n").alias("__n"), F.sum("__sum").alias("__sum"))
    in_source = Window.partitionBy("__known", "__source").orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)
    in_class = Window.partitionBy("__known", "__source", "__class").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("__source"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    plan = (
        targets(classes.groupBy("__known", "__source").agg(F.sum("__sum").alias("__words")), weights, cap)
        .withColumn("__rate", F.when(F.col("__words") > 0, F.col("__target") / F.col("__words")).otherwise(F.lit(0.0)))
        .withColumn("__offset", offset)
    )
    starts = (
        bins.withColumn("__in_class", F.coalesce(F.sum("__n").over(in_class), F.lit(0)))
        .join(classes.withColumn("__in_source", F.coalesce(F.sum("__n").over(in_source), F.lit(0)))
              .select("__known", "__source", "__class", "__in_source"), ["__known", "__source", "__class"])
        .join(plan, ["__known", "__source"])
        .select(*keys, (F.col("__in_source") + F.col("__in_class")).alias("__start"), "__words", "__target", "__rate", "__offset")
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("mix_size", ident))
    crossed = lambda i: F.floor(F.col("__offset") + i.cast("double") * F.col("__rate"))
    at = F.col("__start") + F.col("__rank")
    return (
        placed.withColumn("__rank", rank).join(starts, keys)
        .withColumns({"mix_source_size": F.col("__words"), "mix_target": F.col("__target"),
                      "mix_copies": F.least(crossed(at) - crossed(at - 1), F.lit(cap).cast("long"))})
        .withColumn("mix_taken", F.col("mix_copies") * F.col("mix_size"))
        .select(*table.restored(), *RESULTS)
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row per copy of the documents returned by :func:`mix`, without its columns."""
    columns, copy = [c for c in mixed.columns if c not in RESULTS], free_name(mixed, "copy")
    return mixed.where("mix_copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias(copy)).drop(copy)
