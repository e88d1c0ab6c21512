"""Bench: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]. Prints one JSON line.

Scoring timings mirror the reference's published ones: predict on the
train and the test part (batch-local medians, as the reference) plus the
confusion counts of both, for an already fitted model. Fit times are
reported separately. Data-operator timings cover the observation table
build + cleaning, the exact split, the curves and the neighbour join.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from rareflag.operators import metrics as M  # noqa: E402
from rareflag.session import local_session  # noqa: E402


def timed(fn):
    t = time.time()
    fn()
    return round(time.time() - t, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, driver_memory="16g")
    from rareflag.operators.models.adaboost import adaboost_stages
    from rareflag.operators.models.forest import forest_stages
    from rareflag.operators.models.knn import knn_stages
    from rareflag.operators.models.ksvm import ksvm_stages
    from rareflag.plans import model_queries as MQ
    from rareflag.plans import queries as Q
    from rareflag.plans.score import fit, prepared_obs, score_parts
    from rareflag.sources import obs as O

    q = {}
    # warm-up (JVM, Python workers) outside the timings
    spark.range(1000).agg(F.sum("id")).collect()

    q["obs_clean"] = timed(lambda: Q.q_median_impute(spark, sf_dir).agg(F.count(F.lit(1))).collect())
    q["train_test_split"] = timed(lambda: Q.q_train_test_split(spark, sf_dir).groupBy("split").count().collect())
    q["roc_pr_curves"] = timed(lambda: M.roc_auc_ap(Q.rule_scored(spark, sf_dir)).collect())
    q["knn_join_embeddings"] = timed(lambda: MQ.q_knn_join_l2(spark, sf_dir).agg(F.count(F.lit(1))).collect())

    data = prepared_obs(spark, sf_dir, O.LABEL)
    data.count()
    train = data.where(F.col("split") == "train")
    n_train = train.count()
    families = {
        "rf": forest_stages(**MQ.FOREST),
        "ada": adaboost_stages(n_estimators=200, learning_rate=1.0),
        "svc": ksvm_stages(C=10.0, kernel="rbf", n_train=n_train),
        "knn": knn_stages(n_neighbors=5, weights="distance", p=2),
    }
    for name, stages in families.items():
        t = time.time()
        model = fit(train, stages, "batch")
        q[f"fit_{name}"] = round(time.time() - t, 3)

        def score():
            out = score_parts(model, data, "batch")
            M.error_metrics(out, "label", "prediction", by=["split"]).collect()
        q[f"score_{name}"] = timed(score)
    headline = [k for k in q if k.startswith("score_")] + ["obs_clean", "train_test_split", "roc_pr_curves",
                                                            "knn_join_embeddings"]
    total = round(sum(q[k] for k in headline), 3)
    print(json.dumps({"metric": "headline_total_sec", "value": total, "unit": "sec", "queries": q,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": int(cpus),
                      "rows_scored": data.count()}))
    spark.stop()


if __name__ == "__main__":
    main()
