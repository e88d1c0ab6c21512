"""Feature importances (M17, A24, T1) and PCA.

Importances come from the fitted model on the driver (size: trees x
features); PCA's covariance is one distributed aggregation inside MLlib.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareflag.operators.clean import cleaned_feature_names
from rareflag.plans.pipeline import preprocessing_stages
from rareflag.sources import obs as O


def _input_names(model: PipelineModel) -> list[str]:
    from pyspark.ml.feature import VectorAssembler
    for st in model.stages:
        if isinstance(st, VectorAssembler):
            return list(st.getInputCols())
    raise ValueError("no assembler in the pipeline")


def forest_importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    names = _input_names(model)
    rf = next(st for st in model.stages if isinstance(st, RandomForestRegressionModel))
    total = rf.featureImportances.toArray()
    per_tree = np.stack([t.featureImportances.toArray() for t in rf.trees])
    rows = [(names[i], float(total[i]), float(per_tree[:, i].mean()), float(per_tree[:, i].std()))
            for i in range(len(names))]
    df = spark.createDataFrame(rows, "feature string, importance double, tree_mean double, tree_std double")
    return df.select("feature", F.round("importance", 6).alias("importance"),
                     F.round("tree_mean", 6).alias("tree_mean"), F.round("tree_std", 6).alias("tree_std"))


def pca_explained(spark: SparkSession, df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Correct form of the notebook's PCA: standardise, project, keep the
    smallest k whose cumulative explained variance reaches the threshold."""
    names = cleaned_feature_names(O.VARIABLES)
    pre = preprocessing_stages(O.VARIABLES, flag_cols=O.FLAG_COLS, binary_cols=O.BINARY_COLS,
                               pass_cols=[O.ID], normalise=False)
    k = len(names)
    model = Pipeline(stages=pre + [PCA(k=k, inputCol="features", outputCol="pcs")]).fit(df)
    ev = model.stages[-1].explainedVariance.toArray()
    cum = np.cumsum(ev)
    k_sel = int(np.argmax(cum >= threshold) + 1) if (cum >= threshold).any() else k
    rows = [(i + 1, float(ev[i]), float(cum[i]), i + 1 <= k_sel) for i in range(k)]
    out = spark.createDataFrame(rows, "component int, explained_variance double, cumulative double, selected boolean")
    return out.select("component", F.round("explained_variance", 6).alias("explained_variance"),
                      F.round("cumulative", 6).alias("cumulative"), "selected")


@dataclass(frozen=True)
class PrincipalAxes:
    """Principal axes of standardised columns, by falling variance (columns x columns numbers)."""

    names: list[str]
    mean: np.ndarray
    std: np.ndarray
    #: variance along each axis; the sum is the number of columns that vary
    variances: np.ndarray
    #: one axis a column; its loading of largest size (the first of equal ones) is positive
    vectors: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """(component, variance, feature, loading), components and features in order."""
        rows = [(k + 1, float(self.variances[k]), name, float(self.vectors[i, k]))
                for k in range(len(self.names)) for i, name in enumerate(self.names)]
        return spark.createDataFrame(rows, "component int, variance double, feature string, loading double")

    def project(self, df: DataFrame, k: int, prefix: str = "pc") -> DataFrame:
        """``df`` with the first ``k`` components as columns pc1, pc2, ...: one expression each, no Python worker."""
        zs = [(F.col(c) - float(m)) / float(s) if s > 0 else F.lit(0.0)
              for c, m, s in zip(self.names, self.mean, self.std)]
        parts = [sum((z * float(w) for z, w in zip(zs, self.vectors[:, j])), F.lit(0.0)).alias(f"{prefix}{j + 1}")
                 for j in range(k)]
        return df.select("*", *parts)


def principal_axes(df: DataFrame, cols: Sequence[str]) -> PrincipalAxes:
    """Fit the axes (A23, T3): MLlib sums the Gram matrix by tree aggregation, only columns x columns numbers
    reach the driver. A row with a null column is left out; a constant column has loading and variance 0."""
    rows = VectorAssembler(inputCols=list(cols), outputCol="x", handleInvalid="skip").transform(df).select("x")
    model = Pipeline(stages=[StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True),
                             PCA(k=len(cols), inputCol="z", outputCol="p")]).fit(rows)
    scaler, pca = model.stages
    vectors = pca.pc.toArray()
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(len(cols))] < 0, -1.0, 1.0)
    std = scaler.std.toArray()
    return PrincipalAxes(list(cols), scaler.mean.toArray(), std,
                         pca.explainedVariance.toArray() * int((std > 0).sum()), vectors)
