"""Centroid clustering against whole numbers in plain Python, and odd rows."""

import hashlib
import math

import numpy as np

from drawbook.llm.centroids import LARGEST, RESULTS, cluster_vectors, nearest


def by_loop(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(max(-LARGEST, min(LARGEST, scale * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    text = lambda i: "" if i is None else str(i)
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{text(r[0])}".encode()).hexdigest(), text(r[0]), r[1]))[:k]
    centroids = [q for _, q in first]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda q: min((gap(q, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(best(q)[1], []).append(q)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    out = [(i, *best(q)) for i, q in kept]
    total = sum(d for _, d, _ in out)
    return sorted((text(i), n, d, sum(e for _, e, m in out if m == n), total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in out)


def result(out):
    return sorted(("" if r["vec_id"] is None else str(r["vec_id"]), *(r[c] for c in RESULTS)) for r in out.collect())


def test_against_a_loop(spark):
    random = np.random.default_rng(3)
    vectors = [[float(x) for x in random.normal(random.integers(3), 0.3, 6)] for _ in range(300)]
    rows = list(enumerate(vectors)) + [(7, vectors[7]), (None, vectors[8]), (None, vectors[9]), (900, None), (901, [1.0]), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
                                       (903, [math.nan] * 6), (904, [math.inf] * 6), (905, [1e300] * 6), (906, [-1e300, 0.0, 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert result(cluster_vectors(frame, 8, 4, 6, 256, "2")) == by_loop(rows, 8, 4, 6, 256, "2")


def test_more_centroids_than_rows_and_copies(spark):
    rows = [(k, [float(k % 2), 0.5]) for k in range(6)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    assert result(cluster_vectors(frame, 40, 3, 2)) == by_loop(rows, 40, 3, 2, 256, "2")


def test_nothing_usable(spark):
    frame = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<double>")
    assert cluster_vectors(frame).count() == 0 and cluster_vectors(frame.limit(0)).count() == 0


def test_clashing_columns_are_kept(spark):
    frame = spark.createDataFrame([(1, [0.5, 0.25], "a", 2, 3, 4)], "vec_id long, embedding array<double>, Cluster string, q int, row int, distance int")
    out = cluster_vectors(frame, 2, 1, 2)
    assert out.columns == ["vec_id", "embedding", "Cluster_in", "q", "row", "distance_in", *RESULTS]
    assert tuple(out.first())[2:6] == ("a", 2, 3, 4) and out.first()["distance"] == 0


def test_ties_go_to_the_first_centroid():
    cluster, distance = nearest(np.array([[0, 0], [4, 0]]), np.array([[1, 0], [-1, 0], [1, 0]]))
    assert cluster.tolist() == [0, 0] and distance.tolist() == [1, 9]
