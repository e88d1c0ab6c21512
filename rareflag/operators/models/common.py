"""Shared model output: every family yields ``p0``, ``p1`` (when defined),
``score`` (ranking score) and ``prediction`` (0/1 double)."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ScoreToProbability(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Regression score on a 0/1 label → class probabilities and label.

    A regression tree's leaf mean on a 0/1 label is P(class 1) in that leaf
    and a forest's mean is the averaged probability; the label is
    ``p1 > threshold`` (a tie goes to class 0).
    """

    inputCol = Param(Params._dummy(), "inputCol", "score column", typeConverter=TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "class-1 threshold", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol="score", threshold=0.5):
        super().__init__()
        self._setDefault(inputCol="score", threshold=0.5)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        s = F.col(self.getOrDefault("inputCol"))
        p1 = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
        return (df.withColumn("p1", p1).withColumn("p0", 1.0 - F.col("p1"))
                .withColumn("prediction", (F.col("p1") > self.getOrDefault("threshold")).cast("double")))


class ProbabilityColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """MLlib probabilistic classifier output → p0, p1, score."""

    @keyword_only
    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        arr = vector_to_array(F.col("probability"))
        return (df.withColumn("p0", arr.getItem(0)).withColumn("p1", arr.getItem(1))
                .withColumn("score", F.col("p1")))


class RawScoreColumn(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Margin classifiers (SVM): score = raw margin of class 1, no probability."""

    @keyword_only
    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        arr = vector_to_array(F.col("rawPrediction"))
        return (df.withColumn("score", arr.getItem(1))
                .withColumn("p1", F.lit(None).cast("double"))
                .withColumn("p0", F.lit(None).cast("double")))


class _WeightParams(Params):
    labelCol = Param(Params._dummy(), "labelCol", "label", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "weight column", typeConverter=TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "labels", typeConverter=TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "weight of each label", typeConverter=TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="label", outputCol="class_weight")


class BalancedWeights(Estimator, _WeightParams, DefaultParamsReadable, DefaultParamsWritable):
    """Balanced class weights n / (classes * n_class) as a stage (A9): learned with the model, column added before it."""

    @keyword_only
    def __init__(self, *, labelCol="label", outputCol="class_weight"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "BalancedWeightsModel":
        y = self.getOrDefault("labelCol")
        counts = {float(r[y]): r["n"] for r in df.where(F.col(y).isNotNull()).groupBy(y).agg(
            F.count(F.lit(1)).alias("n")).collect()}  # one row a class
        total = sum(counts.values())
        m = BalancedWeightsModel()
        self._copyValues(m)
        m._set(classes=sorted(counts), weights=[total / (len(counts) * counts[c]) for c in sorted(counts)])
        return m


class BalancedWeightsModel(Model, _WeightParams, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        y, out = self.getOrDefault("labelCol"), self.getOrDefault("outputCol")
        if y not in df.columns:  # rows to score need no weight
            return df
        w = F.lit(None).cast("double")
        for c, v in zip(self.getOrDefault("classes"), self.getOrDefault("weights")):
            w = F.when(F.col(y).cast("double") == c, F.lit(v)).otherwise(w)
        return df.withColumn(out, w)
