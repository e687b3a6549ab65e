"""Near-duplicate vectors by a pigeonhole join over subspaces.

Unit vectors are rotated by a fixed random rotation and cut into blocks of coordinates. Two vectors within a squared
distance ``t`` are within ``t x (block's share of the coordinates)`` in at least one block, so a range join inside each
block with that budget finds every link; the union of what the blocks find is verified in double precision.

The range join lays a grid of side two radii over the leading coordinates of a block. A vector lies in its own cell and,
where it is within a radius of a lower wall, in the cell below, so that two vectors in range share exactly one cell in
which, for each coordinate, at least one of them is at home. Cells with many vectors are cut into chunks, and each pair
of chunks is a group of its own. A pair that several blocks find counts in the first of them, which each task decides for
itself from the two vectors; so tasks return numbers of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawbook.llm.components import components
from drawbook.session import write_table

CHUNK = 16_384
TILE = 256, 1024
SURVIVORS = 1 << 15
SLACK = 1e-6


@lru_cache(maxsize=64)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit_rows(packed: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(packed), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotated(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """``x @ turn`` with one fixed order of additions, so that a vector has the same coordinates in every task."""
    out = np.zeros_like(x)
    for j in range(x.shape[1]):
        out += x[:, j: j + 1] * turn[j]
    return out


def block_bounds(dim: int, blocks: int) -> list[tuple[int, int]]:
    cuts = [dim * b // blocks for b in range(blocks + 1)]
    return [(a, b) for a, b in itertools.pairwise(cuts) if a < b]


class Forest:
    """Labels under unions of many pairs at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                return
            lo, hi = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
            np.minimum.at(self.label, hi, lo)
            while True:  # pointers lead to smaller labels, so this ends at roots
                further = self.label[self.label]
                if (further == self.label).all():
                    break
                self.label = further


def count_links(left: np.ndarray, right: np.ndarray, masks: tuple[np.ndarray, np.ndarray], own: int, bounds: list[tuple[int, int]],
                turn: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of links that belong to block ``own`` and to this cell."""
    budget = [(2 - 2 * least) * (b - a) / len(turn) * (1 + SLACK) for a, b in bounds]
    x, y = rotated(left, turn), rotated(right, turn)
    a, b = bounds[own]
    # Rows (-2 x, |x|^2, 1) and columns (y, 1, |y|^2): their product is the squared distance. Tiles fit the cache.
    square = lambda m: (m[:, a:b] ** 2).sum(axis=1, keepdims=True)
    rows = np.hstack([-2 * x[:, a:b], square(x), np.ones((len(x), 1))]).astype(np.float32)
    columns = np.ascontiguousarray(np.hstack([y[:, a:b], np.ones((len(y), 1)), square(y)]).astype(np.float32).T)
    reach = np.float32(budget[own] + 1e-4)
    for s in range(0, len(x), TILE[0]):
        for t in range(s if same else 0, len(y), TILE[1]):
            gaps = rows[s: s + TILE[0]] @ columns[:, t: t + TILE[1]]
            if gaps.min() > reach:
                continue
            i, j = np.nonzero(gaps <= reach)
            i, j = i + s, j + t
            ok = (masks[0][i] & masks[1][j]) == 0
            if same:
                ok &= i < j
            i, j = i[ok], j[ok]
            for k in range(0, len(i), SURVIVORS):
                p, q = i[k: k + SURVIVORS], j[k: k + SURVIVORS]
                linked = (left[p] * right[q]).sum(axis=1) >= least
                p, q = p[linked], q[linked]
                gap = (x[p] - y[q]) ** 2
                first = gap[:, a:b].sum(axis=1) <= budget[own]
                for other in range(own):
                    c, d = bounds[other]
                    first &= gap[:, c:d].sum(axis=1) > budget[other]
                yield p[first], q[first]


def cosine_components(vectors: DataFrame, least: float = 0.95, blocks: int = 4, grid_dims: int | None = None,
                      id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(``id_col``, ``n_links``, ``component_id``, ``kept``): one row per row of ``vectors``.

    Two vectors are linked when their cosine in double precision is at least ``least``. Vectors that are null, empty or
    zero, or hold null or non-finite components have no links; vectors of different lengths are never linked.
    ``component_id`` is the smallest id reachable; ``kept`` is whether that is the row's own. Repeated rows are linked
    copies and count each. A row without an id takes part, but names no component; where no row has an id it is null, and
    ``kept`` false. Extra columns are not read. An empty table gives an empty one.

    ``grid_dims`` is the number of gridded coordinates of a block, by default so many that a cell holds about ``CHUNK``
    vectors; the result does not depend on it.
    """
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    cleaned = vectors.select(F.col(id_col).alias("key"), F.col(vector_col).cast("array<double>").alias("v")).select(
        "key", F.when(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.col("v")).alias("v"))
    rows, _ = write_table(cleaned.select("key", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("cls"), "v"), "vectors")
    classes, _ = write_table(
        rows.where("cls is not null").groupBy("cls").agg(F.first("v").alias("v"), F.count("*").alias("mult")), "vector-classes")

    if grid_dims is None:
        grid_dims = max(1, math.ceil(math.log(max(classes.count(), 1) / CHUNK, 3))) if least < 1 else 1

    def grid(dim: int) -> list[tuple[int, int, float]]:
        """(first coordinate, gridded coordinates, radius) of each block of vectors of length ``dim``."""
        return [(a, min(grid_dims, b - a, 5), math.sqrt((2 - 2 * least) * (b - a) / dim * (1 + SLACK)) + 1e-9) for a, b in block_bounds(dim, blocks)]

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_cls, all_mult, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            for v in batch.column(2):
                vectors.append(np.asarray(v.as_py(), np.float64).tobytes())
            lengths = np.array([len(v) // 8 for v in vectors], np.int64)
            for dim in np.unique(lengths).tolist():
                these = np.flatnonzero(lengths == dim)
                cls, mult, packed = all_cls[these], all_mult[these], [vectors[k] for k in these]
                x = rotated(unit_rows(packed, dim), rotation(dim))
                for block, (a, dims, radius) in enumerate(grid(dim)):
                    scaled = x[:, a: a + dims] / (2 * radius)
                    home = np.floor(scaled).astype(np.int64)
                    below = scaled - home <= 0.5
                    for mask in range(1 << dims):
                        down = np.array([(mask >> k) & 1 for k in range(dims)])
                        own = np.flatnonzero((below | (down == 0)).all(axis=1))
                        if len(own):
                            cell = ((home[own] - down + 512) * 1024 ** np.arange(dims)).sum(axis=1)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(own), dim, np.int32)), pa.array(np.full(len(own), block, np.int32)), pa.array(cell), pa.array(np.full(len(own), mask, np.int32)),
                                 pa.array(cls[own]), pa.array(mult[own]), pa.array([packed[k] for k in own], pa.binary())],
                                names=["dim", "block", "cell", "mask", "cls", "mult", "v"])

    cells = classes.select("cls", "mult", "v").mapInArrow(to_cells, "dim int, block int, cell long, mask int, cls long, mult long, v binary")
    cells, _ = write_table(cells, "cells")
    crowds = cells.groupBy("dim", "block", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n")
    part = F.pmod("cls", F.col("parts")).cast("int")
    dealt = (
        cells.join(crowds, ["dim", "block", "cell"]).withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("dim", "block", "cell", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), (F.col("part") > F.col("other")).alias("right"),
                "mask", "cls", "mult", "v")
    )

    def compare(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        dim, block, _, lo, hi = keys
        frame = frame.sort_values("cls", kind="stable")
        sides = [frame, frame] if lo == hi else [frame[~frame["right"]], frame[frame["right"]]]
        none = pd.DataFrame({"cls": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        if not len(sides[0]) or not len(sides[1]):
            return none
        (left, right) = (unit_rows(list(f["v"]), dim) for f in sides)
        masks = tuple(f["mask"].to_numpy() for f in sides)
        mult = [f["mult"].to_numpy() for f in sides]
        cls = np.concatenate([f["cls"].to_numpy() for f in sides]) if lo != hi else sides[0]["cls"].to_numpy()
        shift = len(left) if lo != hi else 0
        links, forest = np.zeros(len(cls), np.int64), Forest(len(cls))
        for p, q in count_links(left, right, masks, block, block_bounds(dim, blocks), rotation(dim), least, lo == hi):
            np.add.at(links, p, mult[1][q])
            np.add.at(links, q + shift, mult[0][p])
            forest.join(p, q + shift)
        own = np.flatnonzero(links)
        return pd.DataFrame({"cls": cls[own], "links": links[own], "root": cls[forest.label[own]]})

    found, _ = write_table(
        dealt.groupBy("dim", "block", "cell", "lo", "hi").applyInPandas(compare, "cls long, links long, root long"), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "cls"})

    labelled = (
        rows.drop("v").join(classes.select("cls", "mult").join(links, "cls", "left"), "cls", "left").join(roots, "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
    )
    smallest = labelled.where("root is not null").groupBy("root").agg(F.min("key").alias("least"))
    component = F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("least"))
    return labelled.join(smallest, "root", "left").select(
        F.col("key").alias(id_col), F.coalesce(F.col("mult") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
