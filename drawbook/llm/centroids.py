"""Centroid clustering of integer vectors by lookup tables of squared differences.

A component takes few integer values, so in each round a batch of vectors tabulates, for every dimension, the squared
difference of each occurring value and each centroid. A distance is then a sum of table entries: one gather and one addition
per dimension, for all vectors and centroids of the batch at once.

Tasks return sums and counts per centroid, which Spark adds up; only the centroids (``k`` times ``dims`` numbers) travel
through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawbook.llm.rows import kept_columns
from drawbook.session import drop_path, write_table

RESULTS = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
#: Components stop at plus and minus this, so that a squared distance over 64 of them fits a long.
LARGEST = 2**27


def integer_components(vector: Column, scale: int) -> Column:
    bound = F.lit(float(LARGEST))
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), -bound), bound)).cast("int"))


def is_usable(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null, none infinite or not a number."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (of equally near ones the first) and the squared distance to it."""
    total = np.zeros((len(values), len(centroids)), np.int64)
    for dim in range(values.shape[1]):
        occurring, place = np.unique(values[:, dim], return_inverse=True)
        table = np.square(occurring[:, None] - centroids[None, :, dim])
        total += table[place]
    cluster = total.argmin(1)
    return cluster, total[np.arange(len(values)), cluster]


def components(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def round_sums(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per task and centroid: number of vectors, component sums, and the summed distance as decimal text."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, np.int64)
        inertia = [0] * len(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = components(batch.column(0), dims)
            cluster, distance = nearest(values, centroids)
            order = np.argsort(cluster, kind="stable")
            present, first = np.unique(cluster[order], return_index=True)
            sums[present] += np.add.reduceat(values[order], first, axis=0)
            counts += np.bincount(cluster, minlength=len(centroids))
            # Two halves, so that no partial sum leaves 64 bits.
            high, low = (np.add.reduceat(half[order], first) for half in (distance >> 32, distance & 0xFFFFFFFF))
            for c, h, rest in zip(present.tolist(), high.tolist(), low.tolist(), strict=True):
                inertia[c] += (h << 32) + rest
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()), pa.array(sums[used].tolist(), pa.list_(pa.int64())),
            pa.array([str(inertia[c]) for c in used], pa.string())], ["cluster", "n", "sums", "inertia"])

    return table.mapInArrow(run, "cluster int, n long, sums array<long>, inertia string")


def moved(centroids: np.ndarray, partial: DataFrame) -> np.ndarray:
    """Centroids after one round: exact floor of sum over count; those without vectors stay."""
    totals = partial.select("cluster", "n", F.posexplode("sums").alias("dim", "value")).groupBy("cluster", "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = centroids.copy()
    for row in totals.collect():  # at most k times dims rows
        out[row["cluster"], row["dim"]] = int(row["value"]) // row["n"]
    return out


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2",
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The usable rows of ``vectors`` with ``cluster``, squared ``distance`` to its final centroid, ``cluster_inertia``,
    ``inertia`` and ``centroid_sha256``.

    * Rows whose vector is null, of another length, or holds a null, an infinity or a NaN are left out. Components are
      ``floor(scale * x)``, stopped at ``LARGEST``; sums of distances beyond a long stop at its largest value.
    * Centroids start as the ``k`` rows with the smallest SHA-256 of ``<seed>:<id>`` (a null id counts as empty text;
      rows equal in id stand by their components). With fewer rows there are fewer centroids. Ties go to the smaller number.
    * Repeated rows count each by itself. An empty table gives an empty one. Input columns named like a result are kept
      under a free name (see ``rows.kept_columns``).
    * The working table of integer components is dropped when the centroids are settled.
    """
    wanted = is_usable(F.col(vector_col), dims)
    q = integer_components(F.col(vector_col), scale)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    table, path = write_table(vectors.where(wanted).select(q.alias("q"), F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256).alias("h"), ident.alias("i")), "centroid-components")
    first = table.orderBy("h", "i", "q").limit(k).select("q").collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(len(first), dims)
    inertia: dict[int, int] = {}
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(centroids, round_sums(table.select("q"), centroids))
        sums = round_sums(table.select("q"), centroids).groupBy("cluster").agg(F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia"))
        inertia = {r["cluster"]: int(r["inertia"]) for r in sums.collect()}  # at most k rows
    drop_path(vectors.sparkSession, path)
    return assigned(vectors.where(wanted), q, centroids, inertia)


def assigned(vectors: DataFrame, q: Column, centroids: np.ndarray, inertia: dict[int, int]) -> DataFrame:
    """Every row with its centroid; what belongs to the centroid is looked up in arrays of ``k`` values."""
    packed = vectors.select(F.struct(*kept_columns(vectors, RESULTS)).alias("row"), q.alias("q"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, cluster int, distance long"
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(components(batch.column(1), dims), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["row", "cluster", "distance"])

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    top = 2**63 - 1
    each = F.array(*[F.lit(min(inertia.get(c, 0), top)).cast("long") for c in range(len(centroids))]).cast("array<bigint>")
    return packed.mapInArrow(run, schema).select(
        "row.*", "cluster", "distance", F.get(each, F.col("cluster")).alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), top)).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, digests)).cast("array<string>"), F.col("cluster")).alias("centroid_sha256"))
