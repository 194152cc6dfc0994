"""Centroid clustering against a plain version."""

import hashlib
import math

import pytest

from jobsieve.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster int, label int"


def plain(rows, k, rounds, dims, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        where = nearest()
        for n in range(len(centres)):
            own = [v for (_, v), (_, m) in zip(kept, where) if m == n]
            if own:
                centres[n] = [sum(column) // len(own) for column in zip(*own)]
    return sorted((i, n, d) for (i, _), (d, n) in zip(kept, nearest())), centres


def vectors(n, dims):
    x, out = 7, []
    for i in range(n):
        row = []
        for j in range(dims):
            x = (x * 1103515245 + 12345) % (1 << 31)
            row.append((x >> 8) % 1000 / 300 - 1.5 + (i % 5) * (j % 3))
        out.append((i, row))
    return out


@pytest.mark.parametrize("k, rounds", [(6, 5), (6, 0), (1, 3), (300, 2)])
def test_clusters_equal_the_plain_version(spark, k, rounds):
    rows = vectors(200, 4) + [(3, [0.0] * 4), (500, [9.9] * 4), (500, [9.9] * 4), (600, None), (601, [1.0] * 3), (602, [1.0, None, 1.0, 1.0]),
                              (603, [1.0, float("nan"), 1.0, 1.0]), (604, [1.0, float("inf"), 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA).repartition(5)
    want, centres = plain(rows, k, rounds, 4)
    assigned, clusters = centroids.cluster_vectors(table, k=k, rounds=rounds, dims=4)
    assert sorted(tuple(r) for r in assigned.collect()) == want
    total = sum(d for _, _, d in want)
    for r in clusters.collect():
        own = [d for _, n, d in want if n == r.cluster]
        assert (r.centroid, r.n, r.cluster_inertia, r.inertia) == (centres[r.cluster], len(own), sum(own), total)
    assert clusters.count() == len({n for _, n, _ in want})


def test_awkward_vectors(spark):
    rows = [(None, [0.5] * 4), (1, [1e300] * 4), (2, [-1e300] * 4), (2, [-1e300] * 4)]
    assigned, clusters = centroids.cluster_vectors(spark.createDataFrame([(i, v, 1, 1) for i, v in rows], SCHEMA), k=2, rounds=1, dims=4)
    got = sorted(((r.vec_id is None, r.vec_id), r.cluster) for r in assigned.collect() if r.vec_id is not None)
    assert len(got) == 3 and got[1][1] == got[2][1] != got[0][1]
    assert assigned.count() == 4
    empty = centroids.cluster_vectors(spark.createDataFrame([(1, None, 1, 1)], SCHEMA), dims=4)
    assert empty[0].collect() == [] and empty[1].collect() == []


def test_large_components_keep_integer_products():
    import numpy as np

    x = np.array([[centroids.LARGEST, -centroids.LARGEST]], np.int64)
    assert centroids._exact_product(x, np.array([2 * centroids.LARGEST, 1 - 2 * centroids.LARGEST], np.int64)).tolist() == [
        centroids.LARGEST * 2 * centroids.LARGEST + centroids.LARGEST * (2 * centroids.LARGEST - 1)
    ]
