"""Fit-and-score plans over the observation table.

Scoring is ``PipelineModel.transform``: after the statistics aggregation the
cleaner, assembler, scaler, normaliser and the tree ensemble are one narrow
projection over the scan — no shuffle. In batch mode the reference predicts
the train and the test parts separately, each with its own medians; the plan
does the same and unions the two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareflag.operators.metrics import prediction_tally
from rareflag.operators.split import train_test_split
from rareflag.plans.pipeline import preprocessing_stages
from rareflag.sources import obs as O

OUT_COLS = [O.ID, "split", "label", "prediction", "p0", "p1", "score"]


def prepared_obs(spark: SparkSession, sf_dir: str, label: str = O.LABEL, test_size: float = 0.2,
                 seed: int = 123) -> DataFrame:
    """obs with ``label`` (double) and an exact ``split`` column. The split persists obs and adds
    a projection: it, the statistics and every fit read the rows again."""
    obs = O.observations(spark, sf_dir).withColumn("label", F.col(label).cast("double"))
    return train_test_split(obs, test_size=test_size, seed=seed)


def obs_preprocessing(mode: str = "batch", variables: Sequence[str] = O.VARIABLES, **kw):
    return preprocessing_stages(variables, flag_cols=O.FLAG_COLS, binary_cols=O.BINARY_COLS,
                                pass_cols=[O.ID, "split", "label", O.CASE_COL], mode=mode, **kw)


def fit(train: DataFrame, model_stages, mode: str = "batch", **kw) -> PipelineModel:
    return Pipeline(stages=obs_preprocessing(mode, **kw) + list(model_stages)).fit(train)


def score_parts(model: PipelineModel, data: DataFrame, mode: str = "batch") -> DataFrame:
    """Score train and test; batch mode takes statistics per part."""
    if mode == "batch":
        out = _score_batches(model, data, "split", ["train", "test"])
    else:
        out = model.transform(data)
    for c in ("p0", "p1", "score"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out.select(*OUT_COLS)


def _score_batches(model: PipelineModel, data: DataFrame, by: str, batches: Sequence[str]) -> DataFrame:
    """Batch-mode scoring of several batches: each batch keeps its own
    statistics, but all batches' statistics come from one pass (one masked
    column per batch and variable) instead of one pass per batch."""
    from rareflag.operators.clean import CleanerModel, compute_statistics
    cleaner = model.stages[0]
    if not isinstance(cleaner, CleanerModel) or cleaner.getOrDefault("mode") != "batch":
        parts = [model.transform(data.where(F.col(by) == b)) for b in batches]
    else:
        num = cleaner._numeric_vars()
        masked = data.select(*[F.when(F.col(by) == b, F.col(c)).alias(f"{c}@{i}")
                               for i, b in enumerate(batches) for c in num])
        stats = compute_statistics(masked, masked.columns, cleaner.getOrDefault("strategy"),
                                   cleaner.getOrDefault("medianMethod"))
        rest = PipelineModel(stages=model.stages[1:])
        parts = []
        for i, b in enumerate(batches):
            fills = {c: stats.get(f"{c}@{i}") for c in num}
            parts.append(rest.transform(cleaner.transform_with_fills(data.where(F.col(by) == b), fills)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_and_score(spark: SparkSession, sf_dir: str, model_stages, mode: str = "batch",
                  label: str = O.LABEL, **kw) -> DataFrame:
    data = prepared_obs(spark, sf_dir, label)
    model = fit(data.where(F.col("split") == "train"), model_stages, mode, **kw)
    return score_parts(model, data, mode)


def score_table(df: DataFrame, model: PipelineModel | str, id_col: str = O.ID) -> DataFrame:
    """One-call scoring from a stored model (M14): ``id, prediction, p0, p1``.

    The tally (A18) is observed while the result is written, not by a
    second pass: see :func:`observed_tally`.
    """
    if isinstance(model, str):
        model = PipelineModel.load(model)
    out = model.transform(df)
    for c in ("p0", "p1"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out.select(id_col, "prediction", "p0", "p1")


def observed_tally(df: DataFrame, name: str = "tally"):
    """Attach the flagged / total tally as a metric observed during the next
    action (``Observation.get`` after writing)."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.sum(F.col("prediction").cast("bigint")).alias("flagged"),
                      F.count(F.lit(1)).alias("total")), obs


def tally(df: DataFrame) -> DataFrame:
    return prediction_tally(df)
