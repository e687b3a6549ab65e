"""Reading and writing the engine's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawbook.constants import EXPIRY_SECONDS

OBSERVATION_DDL = (
    "subject_id bigint, doc_id bigint, page bigint, ord bigint, row_no bigint, test string, day date, column_kind string, "
    "status string, value double, disp string, flag string, range_lo double, range_hi double, range_display string, unit string")
MARKER_DDL = ("name string, category string, kind string, unit string, direction string, optimal double, moderate double, inclusive boolean, "
              "moderate_inclusive boolean, low_ok_on_trt boolean, default_sex string, aliases array<string>, "
              "ranges array<struct<sex:string,lo:double,hi:double>>")


def load_observations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Observation rows under an explicit schema; no inference pass over the data."""
    return spark.read.schema(OBSERVATION_DDL).format(fmt).load(path)


def load_library(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A threshold library in JSON lines as (rules, aliases, ranges); a name is an alias of itself."""
    library = spark.read.schema(MARKER_DDL).json(path)
    names = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    aliases = library.select(F.col("name").alias("canonical"), F.col("name").startswith("Urinalysis — ").alias("is_urine"),
                             F.explode(names).alias("alias"))
    ranges = library.select(F.col("name").alias("test"), F.inline("ranges"))
    return library.drop("aliases", "ranges").withColumnRenamed("name", "test"), aliases, ranges


def write_fact_rows(rows: DataFrame, path: str) -> None:
    """One folder per kind, rows clustered by subject inside it."""
    rows.repartition("kind", "subject_id").sortWithinPartitions("subject_id", "row").write.partitionBy("kind").mode("overwrite").parquet(path)


def write_issues(issues: DataFrame, path: str) -> None:
    issues.write.mode("append").parquet(path)


def write_baseline(df: DataFrame, path: str) -> None:
    """An immutable snapshot: writing over an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)


def expired_groups(files: DataFrame, now: float | None = None, max_age: int = EXPIRY_SECONDS) -> DataFrame:
    """Groups whose newest member is older than ``max_age`` seconds."""
    moment = F.unix_timestamp() if now is None else F.lit(now)
    newest = files.groupBy("group_id").agg(F.max("mtime").alias("newest"), F.count(F.lit(1)).alias("members"))
    return newest.filter(moment - F.col("newest") > max_age)
