"""Views that give the base tables the shapes the operators work on, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawbook.plans.registry import cte, values_cte
from drawbook.sources.tables import table

# Thresholds of the twelve tests of the observation view: one row per test and sex.
# test, category, kind, direction, optimal, moderate, inclusive, moderate_inclusive, low_ok_on_trt, default_sex
TEST_RULES = [
    ("T0", "Inflammation", "bounded", "lower", 10.0, 20.0, False, True, False, "male"),
    ("T1", "Inflammation", "bounded", "lower", 15.0, 15.0, True, True, False, "male"),
    ("T2", "Lipids", "bounded", "lower", 20.0, 30.0, False, True, False, "male"),
    ("T3", "Lipids", "bounded", "higher", 30.0, 20.0, True, False, False, "male"),
    ("T4", "Metabolic", "range", None, None, None, True, True, False, "male"),
    ("T5", "Metabolic", "bounded", "lower", 18.0, 27.0, True, False, False, "male"),
    ("T6", "Hormones", "range", None, None, None, True, True, True, "male"),
    ("T7", "Hormones", "range", None, None, None, True, True, False, "male"),
    ("T8", "Thyroid", "bounded", "higher", 25.0, 15.0, True, True, False, "male"),
    ("T9", "Thyroid", "range", None, None, None, True, True, False, "male"),
    ("T10", "Foundational", "bounded", "higher", 35.0, 22.0, False, True, False, "male"),
    ("T11", "Also Monitored", "range", None, None, None, True, True, False, "male"),
]
# test, sex, lo, hi of the range tests; a test and sex without a row has no library range.
TEST_RANGES = [
    ("T4", "male", 12.0, 30.0), ("T4", "female", 12.0, 30.0), ("T6", "male", 10.0, 25.0), ("T6", "female", 15.0, 35.0),
    ("T7", "male", 20.0, 40.0), ("T9", "male", 14.0, 28.0), ("T9", "female", 14.0, 28.0),
]
# test, lo, hi that replace the range under an explicit treatment (female only).
TEST_OVERLAYS = [("T6", 18.0, 30.0), ("T4", 15.0, 32.0)]
# test, range text a scored result must print; tests scored only from a fasting draw; cycle-phase tests.
RANGE_BASIS = [("T9", "10-30")]
FASTING_ONLY = [("T4", "T4 (non-fasting)", "Chemistry"), ("T5", "T5 (non-fasting)", "Hormones")]
PHASE_TESTS = ["T7", "T6"]
RULE_COLUMNS = ["test", "category", "kind", "direction", "optimal", "moderate", "inclusive", "moderate_inclusive",
                "low_ok_on_trt", "default_sex"]

values_cte("rules", RULE_COLUMNS, TEST_RULES)
values_cte("rule_ranges", ["test", "sex", "lo", "hi"], TEST_RANGES)
values_cte("overlays", ["test", "o_lo", "o_hi"], TEST_OVERLAYS)
values_cte("fasting_only", ["test", "shown_name", "shown_group"], FASTING_ONLY)
values_cte("range_basis", ["test", "basis"], RANGE_BASIS)

_RULE_DDL = ("test string, category string, kind string, direction string, optimal double, moderate double, "
             "inclusive boolean, moderate_inclusive boolean, low_ok_on_trt boolean, default_sex string")


def fixed(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of a few fixed rows. It carries a hint, since a table made of Python rows has no size that the optimizer
    could check: the rows it meets would all be dealt by a handful of keys before their join turns out to be small."""
    return F.broadcast(spark.createDataFrame(rows, ddl))


def rules(spark: SparkSession) -> DataFrame:
    return fixed(spark, TEST_RULES, _RULE_DDL)


def rule_ranges(spark: SparkSession) -> DataFrame:
    return fixed(spark, TEST_RANGES, "test string, sex string, lo double, hi double")


def overlays(spark: SparkSession) -> DataFrame:
    return fixed(spark, TEST_OVERLAYS, "test string, o_lo double, o_hi double")


def fasting_only(spark: SparkSession) -> DataFrame:
    return fixed(spark, FASTING_ONLY, "test string, shown_name string, shown_group string")


def range_basis(spark: SparkSession) -> DataFrame:
    return fixed(spark, RANGE_BASIS, "test string, basis string")


def subjects(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("subject_id"),
        F.when(key % 3 == 0, "M").when(key % 3 == 1, "female").alias("sex"),
        F.when(key % 5 == 0, True).when(key % 5 == 1, False).alias("on_trt"),
        F.when(key % 7 == 1, True).alias("bhrt"),
    )


cte("subjects", """
SELECT c_custkey AS subject_id,
       CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'female' END AS sex,
       CASE c_custkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS on_trt,
       CASE c_custkey % 7 WHEN 1 THEN TRUE END AS bhrt
FROM customer""")


def observations(spark: SparkSession, folder: str, dealt: bool = False) -> DataFrame:
    """Printed results: one row per line item, dated by shipping quarter.

    What a result needs of its item is worked out before the join, so that quarters, remainders and marks travel there
    and not the prices, days and suppliers they come from. With ``dealt`` results are dealt by subject and test before their
    texts are made. The items then travel in one array: all uses in a query ask for the same exchange, whichever columns they
    need, and it is made once.
    """
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_linestatus", "l_returnflag",
        F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("day"), (F.col("l_discount") == 0.1).alias("limit"),
        F.when(F.col("l_tax") > 0, (F.lit(10) + F.round(F.col("l_tax") * 500)).cast("bigint")).alias("top"), (F.col("l_suppkey") % 4).alias("maker"))
    items = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumnsRenamed({"o_custkey": "subject_id"}).drop("o_orderkey")
    items = items.withColumn("test", F.concat(F.lit("T"), (F.col("l_partkey") % 12).cast("string")))
    if dealt:
        held = F.array(F.struct(*[c for c in items.columns if c not in ("subject_id", "test")])).alias("held")
        items = items.select("subject_id", "test", held).repartition("subject_id", "test").select("subject_id", "test", F.inline("held"))
    blank, limit = F.col("l_quantity") == 50, F.col("limit")
    quantity = F.col("l_quantity").cast("bigint").cast("string")
    top, ranged = F.col("top"), F.col("top").isNotNull()
    return items.select(
        "subject_id",
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").cast("bigint").alias("page"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.col("l_partkey").alias("row_no"),
        "test",
        "day",
        F.when(F.col("l_linestatus") == "F", "historical").otherwise("current").alias("column_kind"),
        F.when(blank, "not_performed").otherwise("final").alias("status"),
        F.when(~blank & ~limit, F.col("l_quantity")).alias("value"),
        F.when(blank, "").when(limit, F.concat(F.lit("<"), quantity)).otherwise(quantity).alias("disp"),
        F.when(F.col("l_returnflag") == "R", "H").when(F.col("l_returnflag") == "A", "L").alias("flag"),
        F.when(ranged, F.lit(10.0)).alias("range_lo"),
        F.when(ranged, top.cast("double")).alias("range_hi"),
        F.when(ranged, F.concat(F.lit("10-"), top.cast("string"))).alias("range_display"),
        F.when(F.col("maker") == 0, "mg/dL").when(F.col("maker") == 1, "µg/L").when(F.col("maker") == 2, "").alias("unit"),
    )


cte("obs", """
SELECT o_custkey AS subject_id, l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page,
       l_orderkey * 10 + l_linenumber AS ord, l_partkey AS row_no, 'T' || (l_partkey % 12) AS test,
       CAST(date_trunc('quarter', l_shipdate) AS DATE) AS day,
       CASE WHEN l_linestatus = 'F' THEN 'historical' ELSE 'current' END AS column_kind,
       CASE WHEN l_quantity = 50 THEN 'not_performed' ELSE 'final' END AS status,
       CASE WHEN l_quantity = 50 OR l_discount = 0.1::DOUBLE THEN NULL ELSE l_quantity END AS value,
       CASE WHEN l_quantity = 50 THEN '' WHEN l_discount = 0.1::DOUBLE THEN '<' || CAST(l_quantity AS BIGINT)
            ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS disp,
       CASE l_returnflag WHEN 'R' THEN 'H' WHEN 'A' THEN 'L' END AS flag,
       CASE WHEN l_tax > 0 THEN CAST(10 AS DOUBLE) END AS range_lo,
       CASE WHEN l_tax > 0 THEN CAST(10 + round(l_tax * 500) AS DOUBLE) END AS range_hi,
       CASE WHEN l_tax > 0 THEN '10-' || CAST(10 + round(l_tax * 500) AS BIGINT) END AS range_display,
       CASE l_suppkey % 4 WHEN 0 THEN 'mg/dL' WHEN 1 THEN 'µg/L' WHEN 2 THEN '' END AS unit
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
