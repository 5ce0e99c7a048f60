"""Exponion search against comparing all centroids, in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from loupe.llm import exponion, queries

SCHEMA = "vec_id long, embedding array<double>"
LARGEST = (1 << 63) - 1


def brute(rows, dim, k, rounds, seed):
    """rows (id, vector) -> sorted (id, cluster, distance, cluster inertia, inertia, centroid)."""
    kept = [(i, [int(math.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for left in range(rounds, -1, -1):
        near = [min((distance(v, c), j) for j, c in enumerate(centers)) for _, v in kept]
        if left:
            for j in range(len(centers)):
                mine = [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == j]
                if mine:
                    centers[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    cut = lambda x: min(x, LARGEST)
    sums = {j: cut(sum(cut(d) for d, n in near if n == j)) for j in range(len(centers))}
    total = cut(sum(cut(d) for d, _ in near))
    return sorted(((i, n, cut(d), sums[n], total, ",".join(map(str, centers[n]))) for (i, _), (d, n) in zip(kept, near, strict=True)), key=str)


def found(spark, rows, dim, k, rounds, seed):
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "'x' AS v", "2 AS cluster", "3 AS upper")
    got = exponion.cluster(table, "vec_id", "embedding", dim=dim, k=k, rounds=rounds, seed=seed).collect()
    return sorted(((r["id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], ",".join(r["centroid"])) for r in got), key=str)


@pytest.mark.parametrize("size", [0.01, 1.0, 3e4, 1e7, 1e12, 1e200])
def test_clusters_are_those_of_comparing_all(spark, size):
    rng = np.random.default_rng(int(math.log10(size)) % 7)
    centers = rng.normal(size=(5, 3)) * size
    rows = [(i, (centers[i % 5] + rng.normal(size=3) * size * 0.4).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [rows[3], rows[3]]
    rows += [(None, rows[1][1]), (300, None), (301, [1.0, 2.0]), (302, [1.0, None, 2.0]), (303, [1.0, float("nan"), 0.0]), (304, [float("inf"), 0.0, 0.0]), (305, [])]
    assert found(spark, rows, 3, 7, 4, "2") == brute(rows, 3, 7, 4, "2")


def test_few_rows_and_none(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-3.0, 1.0])]
    assert found(spark, rows, 2, 40, 3, "2") == brute(rows, 2, 40, 3, "2")
    assert found(spark, [], 2, 40, 3, "2") == []
    assert found(spark, rows, 2, 1, 3, "x") == brute(rows, 2, 1, 3, "x")


def test_search_computes_fewer_distances_and_the_border_counts():
    rng = np.random.default_rng(4)
    centers = (rng.normal(size=(40, 2)) * 1000).astype(int)
    x = np.floor(centers[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 2)) * 20)
    now = exponion.Centroids.of(centers.tolist(), np.abs(x).max())
    cluster, upper, lower, first = exponion.search(x, np.full(len(x), -1), np.full(len(x), np.inf), np.zeros(len(x)), now)
    moved, _, _, computed = exponion.search(x, cluster, upper + 30, lower - 30, now)
    assert (moved == cluster).all() and first == 160_000 and computed < 20_000
    # a vector as near to centroid 0 as to its own, 1: the smaller number wins
    two = exponion.Centroids.of([[0, 0], [4, 0], [90, 0]], 90)
    assert exponion.search(np.array([[2.0, 0.0]]), np.array([1]), np.array([2.0]), np.array([2.0]), two)[0].tolist() == [0]


def test_registered_query(spark, sf):
    got = queries.op13_clusters(spark, sf).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows, 64, 40, 5, "2")
    assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got), key=str) == [(*w[:5], hashlib.sha256(w[5].encode()).hexdigest()) for w in want]
