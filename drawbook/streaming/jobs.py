"""Structured Streaming jobs: keys that went silent, and incremental reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from drawbook.constants import STALE_SECONDS
from drawbook.operators import reconcile as R


def sessions(events: DataFrame, gap_seconds: int = STALE_SECONDS, lateness: str = "10 minutes", *more: Column) -> DataFrame:
    """Sessions per key; an event exactly ``gap_seconds`` after the last one still belongs to it.

    On a stream a session is emitted once the watermark passes its end, which is when its key has gone silent. ``more``
    are further aggregates.
    """
    gap = f"{gap_seconds * 1000 + 1} milliseconds"
    if events.isStreaming:
        events = events.withWatermark("ts", lateness)
    grouped = events.groupBy("key", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_seen"), *more)
    return grouped.select("key", F.col("w.start").alias("first_seen"), *grouped.columns[3:], "events")


def stale_keys(events: DataFrame, as_of, gap_seconds: int = STALE_SECONDS) -> DataFrame:
    """Batch twin: keys with no event for more than ``gap_seconds`` before ``as_of``."""
    last = events.groupBy("key").agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("events"))
    return last.filter(F.unix_micros(F.to_timestamp(as_of)) - F.unix_micros(F.col("last_seen").cast("timestamp")) > gap_seconds * 1_000_000)


END_OF_TIME = "9999-12-01 00:00:00"


def write_sessions(stream: DataFrame, path: str, checkpoint: str, gap_seconds: int = STALE_SECONDS) -> StreamingQuery:
    """Sessions of ``stream`` (``key, ts``) as Parquet under ``path``; one that is still open waits for :func:`close_sessions`.

    The stream is joined by a second source, the folder ``<checkpoint>-marks``: a mark there is an event of no key that
    moves the watermark.
    """
    spark, marks = stream.sparkSession, f"{checkpoint}-marks"
    schema = "key string, ts timestamp"
    spark.createDataFrame([], schema).write.mode("append").parquet(marks)
    kind = stream.schema["key"].dataType
    events = stream.select(F.col("key"), F.col("ts"), F.lit(False).alias("mark"))
    moved = spark.readStream.schema(schema).parquet(marks).select(F.col("key").cast(kind).alias("key"), "ts", F.lit(True).alias("mark"))
    both = events.unionByName(moved).select(F.struct("mark", "key").alias("key"), "ts")
    # Not a filter on the key: that one would be pushed below the watermark, which would then never see a mark.
    out = sessions(both, gap_seconds, "10 minutes", F.bool_or("key.mark").alias("mark")).filter(~F.col("mark")).select(
        F.col("key.key").alias("key"), "first_seen", "last_seen", "events")
    return (out.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def close_sessions(stream: DataFrame, path: str, checkpoint: str, gap_seconds: int = STALE_SECONDS, until: str = END_OF_TIME) -> StreamingQuery:
    """End the input: a mark at ``until`` moves the watermark there, and every session silent before it comes out.

    Events before ``until`` that arrive later are late and lost, so leave the default to streams that are over.
    """
    spark = stream.sparkSession
    mark = spark.range(1).select(F.lit(None).cast("string").alias("key"), F.to_timestamp(F.lit(until)).alias("ts"))
    mark.write.mode("append").parquet(f"{checkpoint}-marks")
    return write_sessions(stream, path, checkpoint, gap_seconds)


def reconcile_stream(stream: DataFrame, verdicts: str, checkpoint: str) -> StreamingQuery:
    """Late results change what is known of their subject, test and day.

    The de-duplication is one aggregate whose state (minima, maxima and a count per subject, test and day) merges with new
    rows, so the stream keeps it in its state store: a batch reads the states of the keys it touches, never the
    history. It appends their new verdicts under its number; a batch that is replayed starts from the same states
    and rewrites the same rows. For large histories let the session keep states in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{verdicts}/batch={batch_id}")

    return R.dedupe_sources(stream).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_verdicts(spark: SparkSession, verdicts: str) -> DataFrame:
    """The newest verdict of every (subject, test, day)."""
    stored = spark.read.option("basePath", verdicts).parquet(verdicts)
    rest = [c for c in stored.columns if c not in (*R.KEYS, "batch")]
    newest = stored.groupBy(*R.KEYS).agg(F.max_by(F.struct(*rest), "batch").alias("v"))
    return newest.select(*R.KEYS, "v.*")


def current_results(spark: SparkSession, verdicts: str) -> DataFrame:
    """First and latest result of every (subject, test), from the newest verdicts."""
    return R.reconcile(R.accepted(current_verdicts(spark, verdicts)), unique=True)


def compact_verdicts(spark: SparkSession, verdicts: str, out: str) -> None:
    """One row per key in place of one per key and batch, under the number of the last batch; a reader then starts there."""
    last = spark.read.option("basePath", verdicts).parquet(verdicts).agg(F.max("batch").alias("b")).first()["b"]
    current_verdicts(spark, verdicts).write.mode("overwrite").parquet(f"{out}/batch={last}")
