"""Binned features and weighted class histograms.

Cut points are found once for a table: a feature of few distinct values gets the midpoints between
all of them, any other the cuts of a quantile sketch (bounded memory whatever the rows). A bin number
is the number of cuts below the value, so ``value <= cuts[k]`` and ``bin <= k`` are the same.

``blocks`` packs the bin numbers of many rows into one, ``held`` keeps packed rows for many passes,
``weighted_histogram`` is one job over them: every task adds up its rows in a columns x bins x classes
array, and these arrays are all that reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: error of a quantile's rank, as a share of the rows
RANK_ERROR = 1e-3
#: rows of a block, up to one Arrow batch more, and of the slices that a task adds up at once
BLOCK, SLICE = 1 << 15, 1 << 12
#: bytes of a partition that is held, about
TASK_BYTES = 64 << 20
#: tasks whose arrays the driver takes at once
FAN_IN = 64


def cut_points(rows: DataFrame, x: str, dims: int, max_bins: int) -> list[np.ndarray]:
    """Ascending cut points of each element of the array column ``x``; no cut where it is constant."""
    cols = rows.select(*[F.get(x, F.lit(i)).alias(str(i)) for i in range(dims)])
    n = cols.agg(*[F.approx_count_distinct(str(i), 0.02).alias(str(i)) for i in range(dims)]).first()
    few = [str(i) for i in range(dims) if n[str(i)] <= max_bins * 0.9]
    many = [str(i) for i in range(dims) if str(i) not in few]
    out: dict[str, np.ndarray] = {}
    if few:  # at most about max_bins values a column, by the count above
        values = cols.agg(*[F.collect_set(c).alias(c) for c in few]).first()
        for c in few:
            v = np.unique(np.array(values[c], float) + 0.0)
            out[c] = (v[:-1] + v[1:]) / 2
    if many:
        probs = [k / max_bins for k in range(max_bins + 1)]
        for c, q in zip(many, cols.approxQuantile(many, probs, RANK_ERROR)):
            v = np.unique(np.array(q, float) + 0.0)
            out[c] = v[:-1]
    return [out[str(i)] for i in range(dims)]


def blocks(rows: DataFrame, x: str, y: str, cuts: list[np.ndarray]) -> DataFrame:
    """``rows`` as blocks of up to ``BLOCK`` rows, made in the rows' own tasks: ``n``, ``b`` (bin numbers of the array
    column ``x``, feature after feature) and ``y`` (0/1 labels), so that a pass reads whole arrays instead of rows."""
    wide = np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16
    src = rows.select(F.col(y).cast("byte").alias("y"), F.col(x).alias("x"))

    def run(batches):
        import pyarrow as pa

        def block(parts):
            bins, labels = (np.concatenate(p, axis=-1) for p in zip(*parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([len(labels)], pa.int32()), pa.array([bins.tobytes()], pa.binary()),
                 pa.array([labels.tobytes()], pa.binary())], names=["n", "b", "y"])

        parts, n = [], 0
        for b in batches:
            v = np.asarray(b.column(1).flatten()).reshape(b.num_rows, len(cuts))
            bins = np.empty(v.shape[::-1], wide)
            for f, c in enumerate(cuts):
                bins[f] = np.searchsorted(c, v[:, f], side="left")
            parts.append((bins, np.asarray(b.column(0)).astype(np.int8)))
            n += b.num_rows
            if n >= BLOCK:
                yield block(parts)
                parts, n = [], 0
        if n:
            yield block(parts)

    return src.mapInArrow(run, "n int, b binary, y binary")


def held(packed: DataFrame, size: int) -> RDD:
    """Rows of ``packed``, each with the number of its partition, kept as Python objects in about one partition a core, of at
    most ``TASK_BYTES`` of the ``size`` bytes: a pass over them is one job without a plan or a shuffle, of few tasks."""
    cores = packed.sparkSession.sparkContext.defaultParallelism
    rows = packed.rdd.mapPartitionsWithIndex(lambda i, it: ((i, *r) for r in it))
    return rows.coalesce(max(cores, -(-size // TASK_BYTES))).persist(StorageLevel.MEMORY_AND_DISK)


def weighted_histogram(packed: DataFrame | RDD, tables: dict[int, np.ndarray], dims: int, n_bins: int,
                       shift: float) -> np.ndarray:
    """(dims, n_bins, 2) sums of the weights by feature, bin and 0/1 label over ``blocks`` or what is ``held`` of them: one job.

    A row's weight is exp(shift + the sum of ``tables[f][label, bin of f]``). One array a task reaches the driver, or one of
    ``FAN_IN`` tasks where there are more."""
    wide = np.uint8 if n_bins <= 256 else np.uint16
    flat = {f: np.ascontiguousarray(t.T).ravel() for f, t in tables.items()}

    def run(rows):
        total, some = np.zeros((dims, 2 * n_bins)), False
        for *_, n, raw, labels in rows:
            bins = np.frombuffer(raw, wide).reshape(dims, n)
            y = np.frombuffer(labels, np.int8)
            for at in range(0, n, SLICE):  # its arrays stay in a core's cache
                b, yy = bins[:, at:at + SLICE], y[at:at + SLICE].astype(np.intp)
                slot = 2 * b.astype(np.intp) + yy
                expo = np.full(len(yy), shift)
                for f, t in flat.items():
                    expo += t.take(slot[f])
                w = np.exp(expo, out=expo)
                for f in range(dims):
                    total[f] += np.bincount(slot[f], weights=w, minlength=2 * n_bins)
                some = True
        if some:
            yield total

    rows = packed.rdd if isinstance(packed, DataFrame) else packed
    sums = rows.mapPartitions(run)
    tasks = sums.getNumPartitions()
    found = sums.collect() if tasks <= FAN_IN else [sums.treeAggregate(0.0, np.add, np.add)]
    return sum(found, np.zeros((dims, 2 * n_bins))).reshape(dims, n_bins, 2)
