"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawbook.session import drop_path, write_table


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of ``edges`` (``a``, ``b``, both long).

    Each round points the larger neighbours of a node at its smallest neighbour (large star), then all smaller ones at
    it (small star); rounds end when nothing changes. A node's smallest neighbour is an aggregate with map-side combine,
    so that a node with a third of all edges is no group in one task. Each round is written to the shared folder, which
    cuts the lineage. Loops, repeated edges and nulls in an edge are allowed; rows with a null are ignored.
    """
    spark = edges.sparkSession
    current, path = write_table(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "edges")

    def stamp(table: DataFrame) -> tuple[int, int]:
        row = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], int(row["s"] or 0)

    seen = stamp(current)
    while seen[0]:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        following, next_path = write_table(small.where("a <> b").distinct(), "edges")
        drop_path(spark, path)
        current, path = following, next_path
        now = stamp(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
