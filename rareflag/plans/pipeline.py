"""Preprocessing pipeline (M1): cleaner → assembler → scaler → normaliser.

All four stages are narrow: after the statistics aggregation the whole
preprocessing is one projection, fused by codegen with the scan and with the
model's scoring expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import Normalizer, StandardScaler, VectorAssembler

from rareflag.operators.clean import Cleaner, cleaned_feature_names


def preprocessing_stages(variables: Sequence[str], *, flag_cols: Sequence[str], binary_cols: Sequence[str],
                         pass_cols: Sequence[str], mode: str = "batch", strategy: str = "median",
                         on_unscorable: str = "drop", median_method: str = "select",
                         scale: bool = True, normalise: bool = True):
    stages = [Cleaner(inputCols=list(variables), flagCols=list(flag_cols), binaryCols=list(binary_cols),
                      passCols=list(pass_cols), mode=mode, strategy=strategy,
                      onUnscorable=on_unscorable, medianMethod=median_method),
              VectorAssembler(inputCols=cleaned_feature_names(variables),
                              outputCol="raw_features" if (scale or normalise) else "features",
                              handleInvalid="keep")]
    last = "raw_features"
    if scale:
        # sample vs population std differs by a common factor, which the
        # following row-wise L2 normalisation cancels exactly
        stages.append(StandardScaler(inputCol=last, outputCol="scaled", withMean=True, withStd=True))
        last = "scaled"
    if normalise:
        stages.append(Normalizer(inputCol=last, outputCol="features", p=2.0))
        last = "features"
    if last != "features":
        from pyspark.ml.feature import SQLTransformer
        stages.append(SQLTransformer(statement=f"SELECT *, {last} AS features FROM __THIS__"))
    return stages


def full_pipeline(pre_stages, model_stages) -> Pipeline:
    return Pipeline(stages=list(pre_stages) + list(model_stages))
