"""MLlib's forest and variance tree on a 0/1 label, grown over blocks of bin numbers.

MLlib keeps a row as an object of some 160 bytes, adds it up cell by cell, and sends three doubles a cell. Here a row is
one byte a feature and its label (``bins.blocks``), tasks add up whole arrays, and a cell is two counts of the fewest bytes
they need. The draws of features, the choice of a split and the order of the passes are MLlib's, so with the same
cut points the model is the one that it fits. MLlib takes the cut points of a table of more than ``SAMPLED`` rows from a
sample of that size; here they come from all rows (``shared_cut_points``).

A pass grows as many open nodes as fit ``maxMemoryInMB``, in two steps: tasks send every row down the trees so far and count
rows and positives by (node, drawn feature, bin); the counts of a tree's nodes are added up by tree and ``CHUNK`` nodes
and their best splits chosen there. One row a node reaches the driver. The nodes are written in MLlib's
format and read back, so the model is MLlib's own.

Up to ``SAMPLED`` rows, where both fit the same and MLlib needs fewer jobs, bootstrapped or weighted rows, categorical
features and labels other than 0 and 1 are left to MLlib.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressionModel, DecisionTreeRegressor, RandomForestRegressionModel,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareflag.operators.models.bins import RANK_ERROR, blocks, cut_points
from rareflag.operators.models.forest_draws import Draws, map_order
from rareflag.session import scratch_path

#: rows up to which MLlib looks at every value for the cut points
SAMPLED = 256 * 256
#: nodes of a tree whose counts are added up in one place
CHUNK = 16
#: rows that a task adds up at once, and that go down a tree at once
TOGETHER, SLICE = 1 << 17, 1 << 13

SUBSETS = {"all": lambda n: n, "sqrt": lambda n: math.ceil(math.sqrt(n)), "onethird": lambda n: math.ceil(n / 3.0),
           "log2": lambda n: max(1, math.ceil(math.log2(n)))}


class _Tree:
    """Nodes by heap number: (rows, positives), and where split (feature, cut, gain)."""

    def __init__(self):
        self.stats: dict[int, tuple[int, int]] = {}
        self.split: dict[int, tuple[int, int, float]] = {}

    def descent(self, open_ids: list[int], no_cut: int) -> tuple[np.ndarray, ...]:
        """feature, cut, left child and number in ``open_ids`` (-1: not open) of each node; a leaf leads to itself."""
        ids = np.array(sorted({1, *(2 * n for n in self.split), *(2 * n + 1 for n in self.split)}))
        inner = np.array([n in self.split for n in ids.tolist()])
        feature, cut = (np.array([self.split[n][i] if n in self.split else d for n in ids.tolist()])
                        for i, d in ((0, 0), (1, no_cut)))
        left = np.where(inner, np.searchsorted(ids, 2 * ids), np.arange(len(ids)))
        number = np.full(len(ids), -1)
        number[np.searchsorted(ids, open_ids)] = np.arange(len(open_ids))
        return feature, cut, left, number


def _counts(packed: DataFrame, group: dict, dims: int, n_bins: int) -> DataFrame:
    """tree, first node, bytes of a count, rows and positives by (node, drawn feature, bin) of each task."""
    shared = packed.sparkSession.sparkContext.broadcast(group)  # nodes of a pass: bounded by the model
    wide = np.uint8 if n_bins <= 256 else np.uint16

    def cells(tree, flat, y):
        """Cells of the rows in open nodes, for each of their node's features, and whether each row is positive."""
        (feature, cut, left, number), subsets, depth = tree
        n, k = len(y), subsets.shape[1]
        place, offset, per = feature * n, (subsets * n).T.copy(), k * n_bins
        every, kept, out, filled = np.arange(n), np.empty(n, np.intp), np.empty((k, n), np.intp), 0
        for at in range(0, n, SLICE):  # its arrays stay in a core's cache
            rows = every[at:at + SLICE]
            node = np.zeros(len(rows), np.intp)
            for _ in range(depth):
                i = place.take(node)
                i += rows
                above = flat.take(i) > cut.take(node)
                node = left.take(node)
                node += above
            here = number.take(node)
            live = np.flatnonzero(here >= 0)
            if len(live) < len(rows):
                rows, here = rows.take(live), here.take(live)
            to = slice(filled, filled + len(rows))
            kept[to], filled = rows, to.stop
            first = here * per
            for j in range(k):
                i = offset[j].take(here)
                i += rows
                np.add(first, flat.take(i), out=out[j, to])
                out[j, to] += j * n_bins
        return out[:, :filled], y.take(kept[:filled])

    def run(batches):
        import pyarrow as pa
        found: dict[int, np.ndarray] = {}

        def add(parts):
            bins = np.concatenate([b for b, _ in parts], axis=1).ravel()
            y = np.concatenate([v for _, v in parts]) > 0
            for t, tree in shared.value.items():
                size = tree[1].size * n_bins
                if t not in found:
                    found[t] = np.zeros((2, size), np.int64)
                places, positive = cells(tree, bins, y)
                for total, part in zip(found[t], (places.ravel(), places[:, positive].ravel())):
                    if len(part) > size:
                        total += np.bincount(part, minlength=size)
                    else:
                        np.add.at(total, part, 1)

        parts, held = [], 0
        for batch in batches:
            for n, raw, labels in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                parts.append((np.frombuffer(raw.as_buffer(), wide).reshape(dims, n), np.frombuffer(labels.as_buffer(), np.int8)))
                held += n
                if held >= TOGETHER:
                    add(parts)
                    parts, held = [], 0
        if parts:
            add(parts)
        for t, total in found.items():
            subsets = shared.value[t][1]
            per = subsets.shape[1] * n_bins
            for first in range(0, len(subsets), CHUNK):
                own = total[:, first * per:(first + CHUNK) * per]
                own = own.astype(np.min_scalar_type(own.max()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([first], pa.int32()), pa.array([own.itemsize], pa.int32()),
                     pa.array([own.tobytes()], pa.binary())], names=["tree", "first", "width", "counts"])

    return packed.mapInArrow(run, "tree int, first int, width int, counts binary")


def _impurity(n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Variance of ``n`` labels with ``p`` ones; 0 where there are none."""
    some = np.where(n > 0, n, 1.0)
    return np.where(n > 0, (p - p * p / some) / some, 0.0)


def best_splits(counts: np.ndarray, n_cuts: np.ndarray, min_rows: int) -> tuple[np.ndarray, ...]:
    """n, p, place of the drawn feature, cut, gain (-inf: no split may be made), n and p on the left of each node, of
    counts (2, nodes, drawn features, bins); ``n_cuts`` are the cuts of the drawn features. Of equal gains the first
    feature drawn and its lowest cut."""
    n, p = counts[:, :, 0].sum(axis=-1).astype(float)
    ln, lp = counts.cumsum(axis=-1)[..., :-1].astype(float)
    total, ones = n[:, None, None], p[:, None, None]
    rn, rp = total - ln, ones - lp
    some = np.where(total > 0, total, 1.0)
    gain = _impurity(total, ones) - ln / some * _impurity(ln, lp) - rn / some * _impurity(rn, rp)
    may = (np.arange(ln.shape[-1]) < n_cuts[..., None]) & (ln >= min_rows) & (rn >= min_rows) & (gain >= 0)
    gain = np.where(may, gain, -np.inf).reshape(len(n), -1)
    at, own = gain.argmax(axis=1), np.arange(len(n))
    return (n, p, *np.divmod(at, ln.shape[-1]), gain[own, at], ln.reshape(gain.shape)[own, at], lp.reshape(gain.shape)[own, at])


def _splits(counts: DataFrame, group: dict, cuts: list[np.ndarray], n_bins: int, min_rows: int) -> list:
    """tree, number of the node, and what ``best_splits`` says of it."""
    subsets = {t: tree[1] for t, tree in group.items()}
    shared = counts.sparkSession.sparkContext.broadcast((subsets, np.array([len(c) for c in cuts])))

    def run(table):
        import pyarrow as pa
        subsets, n_cuts = shared.value
        t, first = table.column("tree")[0].as_py(), table.column("first")[0].as_py()
        own = subsets[t][first:first + CHUNK]
        total = np.zeros((2, *own.shape, n_bins), np.int64)
        for width, raw in zip(table.column("width").to_pylist(), table.column("counts")):
            total += np.frombuffer(raw.as_buffer(), np.dtype(f"u{width}")).reshape(total.shape)
        n, p, place, cut, gain, ln, lp = best_splits(total, n_cuts[own], min_rows)
        nodes = np.arange(len(own))
        return pa.table({"tree": pa.array(np.full(len(own), t, np.int32)), "node": pa.array((first + nodes).astype(np.int32)),
                         **{k: pa.array(v.astype(np.int64)) for k, v in (("n", n), ("p", p), ("feature", own[nodes, place]),
                                                                         ("cut", cut), ("ln", ln), ("lp", lp))},
                         "gain": pa.array(gain)})

    schema = "tree int, node int, n long, p long, feature long, cut long, ln long, lp long, gain double"
    return counts.groupBy("tree", "first").applyInArrow(run, schema).collect()  # one row a node of the pass


def grow(packed: DataFrame, cuts: list[np.ndarray], trees: int, depth: int, min_rows: int, drawn: int, seed: int,
         memory: int) -> list[_Tree]:
    """``trees`` trees over ``blocks``, each node split by the best of ``drawn`` features."""
    dims, n_bins = len(cuts), max(map(len, cuts)) + 1
    draws, out = Draws(seed, dims, drawn), [_Tree() for _ in range(trees)]
    stack = [(t, 1) for t in range(trees)]  # the last one is taken first
    while stack:
        open_ids: dict[int, list[int]] = {}
        subsets: dict[int, list[list[int]]] = {}
        used = 0
        while stack and (used < memory or not used):
            t, node = stack[-1]
            subset = draws.next()
            need = 24 * sum(len(cuts[f]) + 1 for f in subset)  # three doubles a bin, as MLlib counts it
            if not used or used + need <= memory:
                stack.pop()
                open_ids.setdefault(t, []).append(node)
                subsets.setdefault(t, []).append(subset)
            used += need
        # (nothing is above the last bin, so a leaf keeps its rows)
        group = {t: (out[t].descent(ids, n_bins), np.array(subsets[t]), max(n.bit_length() - 1 for n in ids))
                 for t, ids in open_ids.items()}
        found = {(r["tree"], r["node"]): r for r in _splits(_counts(packed, group, dims, n_bins), group, cuts, n_bins, min_rows)}
        for t in map_order(open_ids):
            for i, node in enumerate(open_ids[t]):
                r = found[t, i]
                out[t].stats[node] = (r["n"], r["p"])
                level = node.bit_length() - 1
                if r["gain"] <= 0 or level == depth:
                    continue
                out[t].split[node] = (r["feature"], r["cut"], r["gain"])
                for kid, n, p in ((2 * node, r["ln"], r["lp"]), (2 * node + 1, r["n"] - r["ln"], r["p"] - r["lp"])):
                    out[t].stats[kid] = (n, p)
                    if level + 1 < depth and abs(float(_impurity(np.float64(n), np.float64(p)))) >= 2.0 ** -52:
                        stack.append((t, kid))
    return out


def node_rows(tree: _Tree, cuts: list[np.ndarray]) -> list[tuple]:
    """Rows of MLlib's node table in pre-order; two leaves of one value are one, as there."""
    same = set()  # nodes whose sides are leaves of one value

    def value(node: int) -> float:
        n, p = tree.stats[node]
        return p / n if n else 0.0

    leaf_value = {}
    for node in sorted(tree.stats, reverse=True):
        left, right = leaf_value.get(2 * node), leaf_value.get(2 * node + 1)
        if node not in tree.split:
            leaf_value[node] = value(node)
        elif left is not None and left == right:
            same.add(node)
            leaf_value[node] = left
    out: list[tuple] = []

    def visit(node: int) -> int:
        at = len(out)
        n, p = tree.stats[node]
        row = (float(_impurity(np.float64(n), np.float64(p))), [float(n), float(p), float(p)], n)
        out.append(())
        if node in leaf_value:
            out[at] = (at, leaf_value[node], *row, -1.0, -1, -1, (-1, [], -1))
        else:
            f, cut, gain = tree.split[node]
            out[at] = (at, value(node), *row, gain, visit(2 * node), visit(2 * node + 1), (f, [float(cuts[f][cut])], -1))
        return at

    visit(1)
    return out


NODE = ("id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, "
        "rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>")


def _as_mllib(spark, est, trees: list[_Tree], cuts: list[np.ndarray]):
    """The MLlib model of these nodes, through its file format."""
    forest = isinstance(est, RandomForestRegressor)
    path = scratch_path(spark, f"forest-{uuid.uuid4().hex}")
    nodes = [node_rows(t, cuts) for t in trees]
    if forest:
        data = spark.createDataFrame([(t, n) for t, rows in enumerate(nodes) for n in rows], f"treeID int, nodeData struct<{NODE}>")
    else:
        data = spark.createDataFrame(nodes[0], NODE)
    data.coalesce(1).write.parquet(f"{path}/data")

    def metadata(kind: str, uid: str, params, **more) -> str:
        name = f"org.apache.spark.ml.regression.{kind}"
        return json.dumps({"class": name, "timestamp": 0, "sparkVersion": spark.version, "uid": uid,
                           "paramMap": {p.name: est.getOrDefault(p) for p in params if est.isSet(p)},
                           "defaultParamMap": {p.name: est._defaultParamMap[p] for p in params if est.hasDefault(p)}, **more})

    tree_params = [p for p in est.params if DecisionTreeRegressor().hasParam(p.name)]
    if forest:
        own = metadata("RandomForestRegressionModel", est.uid, est.params, numFeatures=len(cuts), numTrees=len(trees))
        each = [(t, metadata("DecisionTreeRegressionModel", f"{est.uid}_{t}", tree_params), 1.0) for t in range(len(trees))]
        spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    else:
        own = metadata("DecisionTreeRegressionModel", est.uid, est.params, numFeatures=len(cuts))
    spark.createDataFrame([(own,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return (RandomForestRegressionModel if forest else DecisionTreeRegressionModel).load(path)


def shared_cut_points(rows: DataFrame, dims: int, max_bins: int) -> list[np.ndarray]:
    """Cut points of a table of any size from all its rows: quantiles of one pass, and ``cut_points`` where these are few
    values, as then the feature may have few, each of which counts."""
    names = [str(i) for i in range(dims)]
    cols = rows.select(*[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(names)])
    probs = [k / max_bins for k in range(max_bins + 1)]
    seen = cols.agg(*[F.percentile_approx(c, probs, int(1 / RANK_ERROR)).alias(f"q{c}") for c in names],
                    *[f(c).alias(f"{k}{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {c: np.unique(np.array(seen[f"q{c}"], float) + 0.0)[:-1] for c in names}  # none where it is constant
    few = [c for c in names if len(out[c]) < max_bins * 0.9 and seen[f"lo{c}"] != seen[f"hi{c}"]]
    if few:
        own = rows.select(F.array(*[F.get("x", F.lit(int(c))) for c in few]).alias("x"))
        out.update(zip(few, cut_points(own, "x", len(few), max_bins)))
    return [out[c] for c in names]


class BlockGrown(Estimator):
    """Fits MLlib's ``estimator`` (``RandomForestRegressor``, ``DecisionTreeRegressor``) over blocks where it can."""

    @keyword_only
    def __init__(self, *, estimator=None):
        super().__init__()
        self.estimator = estimator

    def _fit(self, df: DataFrame):
        est = self.estimator
        get = est.getOrDefault
        forest = isinstance(est, RandomForestRegressor)
        attributes = df.schema[get("featuresCol")].metadata.get("ml_attr", {}).get("attrs", {})
        subsets = get("featureSubsetStrategy") if forest else "all"
        if (forest and (get("bootstrap") or get("subsamplingRate") != 1.0) or est.isSet("weightCol")
                or {"nominal", "binary"} & set(attributes) or subsets not in SUBSETS):
            return est.fit(df)
        rows = df.select(vector_to_array(get("featuresCol")).alias("x"), F.col(get("labelCol")).cast("double").alias("y"))
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("y").isin(0.0, 1.0), F.lit(False))).alias("fit")).first()
        n = seen["n"]
        if n <= SAMPLED or seen["fit"] < n:
            return est.fit(df)
        dims = rows.select(F.size("x")).first()[0]
        max_bins = min(get("maxBins"), n)
        cuts = shared_cut_points(rows, dims, max_bins - 1)
        packed = blocks(rows, "x", "y", cuts).persist()
        try:
            trees = grow(packed, cuts, get("numTrees") if forest else 1, get("maxDepth"), get("minInstancesPerNode"),
                         SUBSETS[subsets](dims), get("seed"), get("maxMemoryInMB") << 20)
        finally:
            packed.unpersist()
        return _as_mllib(df.sparkSession, est, trees, cuts)
