"""Clustering of vectors around centroids with an incremental matrix of dot products.

Each vector carries its exact integer dot products with all centroids.  When centroids move, a vector's
products change by its components times the centroids' changes, and only components that did change are
multiplied.  Squared distances follow from the products, so a round is: read the state, add the changes,
take the nearest centroid, write the state to the shared folder.  The next centroids come from sums per
cluster that every task adds up before the shuffle, so a cluster with a third of all vectors sends one
row of sums per task and component.  What passes through the driver is the centroids alone, ``k`` times
``dims`` integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jobsieve.llm.common import discard, stored

LARGEST = 1 << 27  # components are held within it, so that no squared distance leaves a long
STATE = "vec_id long, x array<int>, dots array<long>, cluster int, distance long"


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, max(1, matrix.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), kind))


def integer_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): vectors of ``dims`` finite components, each as floor(scale * component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("x"), dims).astype(np.float64)  # a null component is NaN here
            good = np.isfinite(values).all(axis=1)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(scale * values[good]), -LARGEST, LARGEST).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), _lists(x, pa.int32())], names=["vec_id", "x"])

    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    return named.where(F.size("x") == dims).mapInArrow(run, "vec_id long, x array<int>")


def _exact_product(x: np.ndarray, change: np.ndarray) -> np.ndarray:
    """x @ change in integers; in floating point where that is exact, as it is faster."""
    if np.abs(change).sum() * max(1, np.abs(x).max(initial=0)) < 1 << 53:
        return (x.astype(np.float64) @ change.astype(np.float64)).astype(np.int64)
    return x @ change


def _assign(centres: np.ndarray, change: np.ndarray):
    """The state after the centroids have moved by ``change`` to ``centres``."""
    moved = [(k, np.flatnonzero(row)) for k, row in enumerate(change)]
    moved = [(k, at) for k, at in moved if len(at)]
    own = (centres * centres).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), centres.shape[1]).astype(np.int64)
            if "dots" in batch.schema.names:
                dots = _matrix(batch.column("dots"), len(centres)).copy()
            else:
                dots = np.zeros((len(x), len(centres)), np.int64)
            for k, at in moved:
                dots[:, k] += _exact_product(x if len(at) == x.shape[1] else x[:, at], change[k, at])
            rest = own - 2 * dots
            cluster = rest.argmin(axis=1)  # of equals the first
            distance = (x * x).sum(axis=1) + rest[np.arange(len(x)), cluster]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), _lists(dots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance)],
                names=["vec_id", "x", "dots", "cluster", "distance"],
            )

    return run


def _means(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors; the old centroid where there are none."""
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x, cluster = _matrix(batch.column("x"), dims), batch.column("cluster").to_numpy()
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                total[c, :dims] += own.sum(axis=0, dtype=np.int64)
                total[c, dims] += len(own)
        c, part = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(part, pa.int32()), pa.array(total[c, part])], names=["cluster", "part", "total"])

    sums = state.select("x", "cluster").mapInArrow(run, "cluster int, part int, total long")
    total = np.zeros((k, dims + 1), np.int64)
    for row in sums.groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect():  # k * (dims + 1) rows
        total[row["cluster"], row["part"]] = row["total"]
    count = total[:, dims:]
    return np.where(count > 0, total[:, :dims] // np.maximum(count, 1), centres)


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2
) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of all vectors, and (cluster, centroid, n, cluster_inertia, inertia) of the clusters in use.

    ``vectors`` has vec_id and embedding.  Kept are rows whose embedding has ``dims`` components, none null,
    NaN or infinite.  The first centroids are the ``k`` kept vectors whose lower-case hex SHA-256 of
    ``seed:vec_id`` is smallest, or all if there are fewer; of rows that repeat an id the smaller vector comes
    first, and rows without id come last.  Each of ``rounds`` rounds assigns every vector to the nearest centroid (squared
    distance, of equals the smaller number) and moves each centroid that has vectors to their componentwise
    floor(sum / count); then vectors are assigned once more.

    Repeated rows count as often as they occur, and a row without id is clustered like any other.  Components
    beyond LARGEST / scale are held at that bound.  An inertia that leaves a long is null.  Extra columns are ignored.  A table without
    kept vectors gives no rows.
    """
    spark = vectors.sparkSession
    integers = integer_vectors(vectors, dims, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = integers.orderBy(order.asc_nulls_last(), "x").limit(k).collect()  # the feature: k starting points
    centres = np.array([r["x"] for r in first], np.int64).reshape(len(first), dims)
    state, change = integers, centres
    for number in range(rounds + 1):
        if number and not change.any():
            break  # no centroid moved, nor will any
        after = stored(state.mapInArrow(_assign(centres, change), STATE), "centroid-state", codec="zstd")
        if number:
            discard(state)
        state = after
        if number < rounds:
            moved = _means(state, centres)
            centres, change = moved, moved - centres
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.try_sum("distance").alias("own")).collect()  # k rows
    owns = [r["own"] for r in sums]
    inertia = sum(owns) if None not in owns else None
    inertia = inertia if inertia is not None and inertia < 1 << 63 else None
    rows = [(r["cluster"], centres[r["cluster"]].tolist(), r["n"], r["own"], inertia) for r in sums]
    clusters = spark.createDataFrame(rows, "cluster int, centroid array<long>, n long, cluster_inertia long, inertia long")
    return state.select("vec_id", "cluster", "distance"), clusters
