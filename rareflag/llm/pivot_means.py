"""Centroid clustering (Lloyd's rounds in whole numbers) with Ptolemaic lower bounds.

Vectors become whole numbers and are written once with their distances to ``PIVOTS`` fixed pivots.
For vector x, centroid c and pivots p, s Ptolemy's inequality gives

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s)

so every pair of pivots bounds each distance from cached numbers. The distance to the centroid of
least bound is computed exactly; centroids whose bound, lowered by more than its rounding error, is
above that distance can be neither nearer nor a tie, and only the others are checked exactly.

A round is one pass: each task sums its vectors by centroid, Spark adds the sums, and centroids x
dims whole numbers reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareflag.llm.scratch import written

PIVOTS = 6
#: vectors from which the pivots are chosen
PIVOT_SAMPLE = 128
ROWS = 4096
#: components beyond this are refused: squared distances must fit in 62 bits
LARGEST = 1 << 27
#: relative slack of a bound; some thirty roundings of 2^-53 and the square roots are far below
SLACK = 1e-9


class Pivots(NamedTuple):
    points: np.ndarray  # int64, pivots x dims
    apart: np.ndarray  # distances of the pairs used
    left: np.ndarray
    right: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def choose_pivots(rows: np.ndarray, most: int = PIVOTS) -> Pivots:
    """Pivots far from each other: each next one is the row farthest from those chosen."""
    picked = [0] if len(rows) else []
    near = squared(rows, rows[:1]) if len(rows) else None
    while picked and len(picked) < most and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, squared(rows, rows[picked[-1]][None]))
    points = rows[picked]
    left, right = np.triu_indices(len(points), 1)
    return Pivots(points, np.sqrt(squared(points[left], points[right]).astype(np.float64)), left, right)


def pivot_distances(x: np.ndarray, pivots: Pivots) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p[None]) for p in pivots.points], axis=1).astype(np.float64)) if len(
        pivots.points) else np.zeros((len(x), 0))


def lower_bounds(to_pivots: np.ndarray, of_centroids: np.ndarray, pivots: Pivots) -> np.ndarray:
    """(vectors, centroids) bounds of the distance, rounded down; also the triangle inequality's, as it is free."""
    best = np.zeros((len(to_pivots), len(of_centroids)))
    for k, (i, j) in enumerate(zip(pivots.left, pivots.right, strict=True)):
        a = np.outer(to_pivots[:, i], of_centroids[:, j])
        b = np.outer(to_pivots[:, j], of_centroids[:, i])
        slack = (a + b) * SLACK  # of the products, whose difference may cancel
        np.maximum(best, (np.abs(a - b) - slack) / pivots.apart[k] * (1 - SLACK), out=best)
    return best


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: Pivots
            ) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, exact distances computed); ties take the smaller number."""
    n, k = len(x), len(centroids)
    bound = lower_bounds(to_pivots, pivot_distances(centroids, pivots), pivots)
    rows = np.arange(n)
    guess = bound.argmin(axis=1)
    known = squared(x, centroids[guess])
    left = bound <= np.sqrt(known.astype(np.float64))[:, None] * (1 + SLACK)
    left[rows, guess] = False
    ri, ci = np.nonzero(left)
    exact = np.full((n, k), np.iinfo(np.int64).max)
    exact[rows, guess] = known
    for i in range(0, len(ri), 4 * ROWS):
        r, c = ri[i:i + 4 * ROWS], ci[i:i + 4 * ROWS]
        exact[r, c] = squared(x[r], centroids[c])
    best = exact.argmin(axis=1)
    return best, exact[rows, best], n + len(ri)


def _matrix(col: pa.Array, dims: int, kind: type) -> np.ndarray:
    return np.asarray(col.flatten()).astype(kind, copy=False).reshape(len(col), dims)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]),
                                    pa.array(m.ravel(), kind))


def whole_vectors(rows: DataFrame, dims: int, scale: int, key: str, vec: str) -> DataFrame:
    """(id, v): the vectors of exactly ``dims`` components, none null or non-finite, as floor(scale * x)."""
    fine = (F.size(vec) == dims) & F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    out = rows.where(F.coalesce(fine, F.lit(False))).select(
        F.col(key).cast("long").alias("id"),
        F.transform(vec, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    large = F.exists("v", lambda x: F.abs(x) > LARGEST)
    return out.withColumn("v", F.when(large, F.raise_error(F.concat(
        F.lit(f"component beyond {LARGEST} in vector "), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
        .otherwise(F.col("v")))


def cluster(rows: DataFrame, k: int, rounds: int, dims: int, scale: int, seed: int = 1, key: str = "vec_id",
            vec: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, exact_checks of every kept vector.

    Centroids start as the ``k`` kept vectors of smallest sha256 of ``seed:id`` (equal hashes: smaller
    vector first; a null id comes last), all of them where there are fewer. A vector with another
    number of components, a null or a non-finite one is not kept; repeated rows are vectors of their
    own; other columns are not read; an empty table gives an empty result. ``exact_checks`` is the number
    of exact distances of the last round over all vectors.
    """
    spark = rows.sparkSession
    vectors = written(whole_vectors(rows, dims, scale, key, vec), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    # at most k + PIVOT_SAMPLE rows: a top-k, not a collect of the table
    first = [r["v"] for r in vectors.orderBy(order.asc_nulls_last(), "v").limit(max(k, PIVOT_SAMPLE)).collect()]
    sample = np.array(first, np.int64).reshape(len(first), dims)
    centroids, pivots = sample[:k], choose_pivots(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1),
                     _lists(pivot_distances(_matrix(b.column(1), dims, np.int64), pivots), pa.float64())],
                    names=["id", "v", "far"])

    cached = written(vectors.mapInArrow(measure, "id bigint, v array<bigint>, far array<double>"), "pivot-distances")

    def parts(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                x = _matrix(b.column(1), dims, np.int64)
                far = _matrix(b.column(2), len(pivots.points), np.float64)
                yield b, x, *nearest(x, far, centroids, pivots)

    names = [f"s{i}" for i in range(dims)]

    def sums_of(centroids: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
            for _, x, best, _, _ in parts(batches, centroids):
                count += np.bincount(best, minlength=len(centroids))
                np.add.at(total, best, x)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]),
                                              *(pa.array(c) for c in total[some].T)], names=["cluster", "n", *names])
        return run

    for _ in range(rounds if len(sample) else 0):
        found = cached.mapInArrow(sums_of(centroids), "cluster int, n bigint, " + ", ".join(f"{c} bigint" for c in names))
        found = found.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect()
        centroids = centroids.copy()
        for r in found:  # k rows
            centroids[r["cluster"]] = [r[c] // r["n"] for c in names]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, best, dist, checks in parts(batches, centroids):
            each = np.zeros(b.num_rows, np.int64)
            each[0] = checks
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array(dist),
                                              pa.array(each)], names=["id", "cluster", "distance", "checks"])

    placed = written(cached.mapInArrow(assign, "id bigint, cluster int, distance bigint, checks bigint"), "placed")
    sums = placed.groupBy("cluster").agg(F.sum("distance").alias("d"), F.sum("checks").alias("c")).collect()  # k rows
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(r["cluster"], r["d"], shas[r["cluster"]]) for r in sums],
                                  "cluster int, cluster_inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(key), "cluster", "distance", "cluster_inertia",
        F.lit(sum(r["d"] for r in sums)).cast("long").alias("inertia"), "centroid_sha256",
        F.lit(sum(r["c"] for r in sums)).cast("long").alias("exact_checks"))
