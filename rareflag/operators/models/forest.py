"""Random forest and decision tree (M2, M3).

Spark's tree classifiers merge sibling leaves that predict the same class,
which with a 0.3 % positive class collapses nearly every leaf and destroys
the probabilities. A regression tree on the 0/1 label splits on variance,
which for a Bernoulli label is half the Gini index: the same split choice,
and the leaf mean is P(class 1). So the gini families are fitted as
regressors and the score is turned into probabilities.
"""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor

from rareflag.operators.models.binned_forest import BlockGrown
from rareflag.operators.models.common import ProbabilityColumns, ScoreToProbability

MAX_BINS = 256   # sklearn tries every cut point; more bins come closer


def forest_stages(numTrees: int = 100, maxDepth: int = 5, minInstancesPerNode: int = 1,
                  bootstrap: bool = True, featureSubsetStrategy: str = "sqrt",
                  seed: int = 42, weightCol: str | None = None, labelCol: str = "label",
                  featuresCol: str = "features", maxBins: int = MAX_BINS,
                  subsamplingRate: float = 1.0, minSamplesSplit: int = 2):
    rf = RandomForestRegressor(featuresCol=featuresCol, labelCol=labelCol, predictionCol="score",
                               numTrees=int(numTrees), maxDepth=int(maxDepth),
                               minInstancesPerNode=int(minInstancesPerNode), bootstrap=bool(bootstrap),
                               featureSubsetStrategy=featureSubsetStrategy, seed=int(seed),
                               maxBins=int(maxBins), subsamplingRate=float(subsamplingRate))
    if weightCol:
        rf.setWeightCol(weightCol)
    return [_pruned(BlockGrown(estimator=rf), minSamplesSplit), ScoreToProbability(inputCol="score")]


def _pruned(est, min_samples_split):
    if min_samples_split and int(min_samples_split) > 2:
        from rareflag.operators.models.prune import MinSplitPruned
        return MinSplitPruned(estimator=est, minSamplesSplit=int(min_samples_split))
    return est


def tree_stages(criterion: str = "gini", maxDepth: int = 5, minInstancesPerNode: int = 1,
                seed: int = 42, weightCol: str | None = None, labelCol: str = "label",
                featuresCol: str = "features", maxBins: int = MAX_BINS, minSamplesSplit: int = 2,
                splitter: str = "best"):
    if splitter not in ("best", "random"):
        raise ValueError(f"unknown splitter {splitter!r}")
    if splitter == "random":
        from rareflag.operators.models.random_tree import RandomSplitTree
        return [RandomSplitTree(criterion=criterion, maxDepth=int(maxDepth), minInstancesPerNode=int(minInstancesPerNode),
                                minSamplesSplit=int(minSamplesSplit or 2), seed=int(seed), weightCol=weightCol,
                                labelCol=labelCol, featuresCol=featuresCol), ScoreToProbability(inputCol="score")]
    if criterion == "gini":
        dt = DecisionTreeRegressor(featuresCol=featuresCol, labelCol=labelCol, predictionCol="score",
                                   maxDepth=int(maxDepth), minInstancesPerNode=int(minInstancesPerNode),
                                   seed=int(seed), maxBins=int(maxBins))
        if weightCol:
            dt.setWeightCol(weightCol)
        return [_pruned(BlockGrown(estimator=dt), minSamplesSplit), ScoreToProbability(inputCol="score")]
    if criterion == "entropy":
        dt = DecisionTreeClassifier(featuresCol=featuresCol, labelCol=labelCol, impurity="entropy",
                                    maxDepth=int(maxDepth), minInstancesPerNode=int(minInstancesPerNode),
                                    seed=int(seed), maxBins=int(maxBins))
        if weightCol:
            dt.setWeightCol(weightCol)
        return [_pruned(dt, minSamplesSplit), ProbabilityColumns()]
    raise ValueError(f"unknown criterion {criterion!r}")
