"""``min_samples_split`` for Spark trees (post-pruning).

Greedy growth only looks at ``min_samples_split`` to stop, so growing the
tree once and collapsing every internal node that holds fewer than ``m``
rows gives the tree that would have been grown (exactly for a single tree
without bootstrap). The saved model's node table (one row per node:
prediction, impurity, rawCount, children, split) is rewritten on the driver
— its size is bounded by the model, not the data — re-indexed in pre-order
and loaded back as a native MLlib model.
"""

from __future__ import annotations

import uuid

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters

from rareflag.session import scratch_path


def _prune_nodes(nodes: dict, m: int) -> list[dict]:
    out = []

    def visit(nid):
        n = dict(nodes[nid])
        new_id = len(out)
        out.append(n)
        n["id"] = new_id
        internal = n["leftChild"] >= 0
        if internal and n["rawCount"] < m:
            n["leftChild"], n["rightChild"], n["gain"] = -1, -1, -1.0
            n["split"] = {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
            internal = False
        if internal:
            left, right = n["leftChild"], n["rightChild"]
            n["leftChild"] = visit(left)
            n["rightChild"] = visit(right)
        return new_id

    visit(0)
    return out


def prune_min_samples_split(model, m: int):
    """Return a copy of a fitted DecisionTree/RandomForest regression or
    classification model with nodes of fewer than ``m`` rows collapsed."""
    if m is None or m <= 2:
        return model
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, f"prune-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    schema = data.schema
    rows = [r.asDict(recursive=True) for r in data.collect()]
    if "treeID" in schema.fieldNames():
        trees: dict[int, dict] = {}
        for r in rows:
            trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
        new_rows = [{"treeID": t, "nodeData": n} for t, nodes in sorted(trees.items())
                    for n in _prune_nodes(nodes, m)]
    else:
        nodes = {r["id"]: r for r in rows}
        new_rows = _prune_nodes(nodes, m)
    out = f"{path}-pruned"
    import shutil  # noqa: F401  (local copy of the metadata is done by Spark below)
    spark.createDataFrame(new_rows, schema).write.mode("overwrite").parquet(f"{out}/data")
    spark.read.text(f"{path}/metadata").coalesce(1).write.mode("overwrite").text(f"{out}/metadata")
    try:
        spark.read.parquet(f"{path}/treesMetadata").write.mode("overwrite").parquet(f"{out}/treesMetadata")
    except Exception:  # noqa: BLE001  (single trees have no trees metadata)
        pass
    return type(model).load(out)


class MinSplitPruned(Estimator):
    """Wraps a tree estimator: fit, then post-prune to ``minSamplesSplit``."""

    minSamplesSplit = Param(Params._dummy(), "minSamplesSplit", "min rows to split",
                            typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, estimator=None, minSamplesSplit=2):
        super().__init__()
        self.estimator = estimator
        self._setDefault(minSamplesSplit=2)
        self._set(minSamplesSplit=minSamplesSplit)

    def _fit(self, df):
        return prune_min_samples_split(self.estimator.fit(df), self.getOrDefault("minSamplesSplit"))
