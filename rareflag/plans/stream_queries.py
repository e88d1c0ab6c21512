"""Streaming queries: obs (derived by Spark from the driver tables) is
written as several parquet files and read back as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rareflag.functions.columns import r6
from rareflag.plans.score import fit, prepared_obs
from rareflag.session import scratch_path
from rareflag.sources import obs as O
from rareflag.streaming.score import read_stream, read_tally, stream_score, stream_score_batches, stream_tally

#: micro-batches of a source
BATCHES = 4


def _files(spark) -> int:
    return max(BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _read(spark, src, schema):
    return read_stream(spark, src, schema, -(-_files(spark) // BATCHES))


def _stream_source(spark, sf_dir):
    data = prepared_obs(spark, sf_dir, O.LABEL)
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    src = f"{base}/source"
    # a file for each shuffle partition of the session, so tasks and files grow with the cluster's setting
    data.repartition(_files(spark), "id").write.mode("overwrite").parquet(src)
    schema = spark.read.parquet(src).schema
    return data, base, src, schema


def _frozen_model(data, stages):
    return fit(data.where(F.col("split") == "train"), stages, mode="frozen")


def q_stream_clean_frozen(spark, sf_dir):
    """Cleaner with statistics frozen on the train split, applied to a
    stream of all rows (R1; checked against SQL)."""
    from pyspark.ml import Pipeline
    from rareflag.plans.score import obs_preprocessing
    data, base, src, schema = _stream_source(spark, sf_dir)
    cleaner = Pipeline(stages=obs_preprocessing("frozen")[:1]).fit(data.where(F.col("split") == "train"))
    q = stream_score(cleaner, _read(spark, src, schema), f"{base}/sink", f"{base}/ckpt",
                     [O.ID] + O.VARIABLES + [f"{c}_isnan" for c in O.VARIABLES])
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/sink")
    return out.select(*[r6(c).alias(c) if c in O.FEATURES else F.col(c) for c in out.columns])


def _forest():
    from rareflag.operators.models.forest import forest_stages
    return forest_stages(numTrees=20, maxDepth=6, bootstrap=False, seed=42)


def q_stream_score_frozen(spark, sf_dir):
    """Forest scoring of a parquet stream, frozen statistics."""
    data, base, src, schema = _stream_source(spark, sf_dir)
    model = _frozen_model(data, _forest())
    q = stream_score(model, _read(spark, src, schema), f"{base}/sink", f"{base}/ckpt",
                     [O.ID, "prediction", "p1"])
    q.awaitTermination()
    return spark.read.parquet(f"{base}/sink").select(O.ID, F.col("prediction").cast("int").alias("prediction"),
                                                     r6("p1").alias("p1"))


def q_stream_score_batch(spark, sf_dir):
    """Micro-batch scoring with batch-local medians, the reference's
    semantics (R2)."""
    from rareflag.plans.score import fit as fit_model
    data, base, src, schema = _stream_source(spark, sf_dir)
    model = fit_model(data.where(F.col("split") == "train"), _forest(), mode="batch")
    q = stream_score_batches(model, _read(spark, src, schema), f"{base}/sink", f"{base}/ckpt",
                             [O.ID, "prediction", "p1"])
    q.awaitTermination()
    return spark.read.parquet(f"{base}/sink").select(O.ID, F.col("prediction").cast("int").alias("prediction"),
                                                     r6("p1").alias("p1"))


def q_stream_tally(spark, sf_dir):
    """Running tally of flagged / total over the stream."""
    data, base, src, schema = _stream_source(spark, sf_dir)
    model = _frozen_model(data, _forest())
    stream_tally(model.transform, _read(spark, src, schema), f"{base}/tally", f"{base}/ckpt").awaitTermination()
    return read_tally(spark, f"{base}/tally")


def q_stream_rule_tally(spark, sf_dir):
    """The tally with the closed-form score, so that SQL has the same totals."""
    from rareflag.plans.queries import rule_prediction
    _, base, src, schema = _stream_source(spark, sf_dir)
    stream_tally(lambda d: d.withColumn("prediction", rule_prediction()), _read(spark, src, schema), f"{base}/tally",
                 f"{base}/ckpt").awaitTermination()
    return read_tally(spark, f"{base}/tally")
