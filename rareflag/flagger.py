"""Run API (E5): construct from a configuration, train, save, load, predict, evaluate.

    flagger = RareFlagger(RunConfig(variables=[...], label="is_pos"))
    flagger.train(df)
    flagger.save("/shared/models", "set_1")
    RareFlagger(config).load(path).predict(new_rows)
    flagger.evaluate(df)

Everything is a DataFrame in and a DataFrame out; nothing but the search's scores reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareflag.config import RunConfig
from rareflag.operators import metrics as M
from rareflag.operators.split import train_test_split
from rareflag.plans.pipeline import preprocessing_stages
from rareflag.plans.search import SearchResult, search, smote_training
from rareflag.sources import store


class RareFlagger:
    """A search, its best model, and what is done with it."""

    def __init__(self, config: RunConfig | dict):
        self.config = config if isinstance(config, RunConfig) else RunConfig(**config)
        self.result: SearchResult | None = None
        self.best_model: PipelineModel | None = None
        self.family: str | None = None

    def preprocessing(self, carry: list[str]) -> list:
        """Fresh preprocessing stages; ``carry`` passes the cleaner untouched."""
        c = self.config
        return preprocessing_stages(c.variables, flag_cols=c.flag_cols, binary_cols=c.binary_cols, pass_cols=carry,
                                    mode=c.mode)

    def split(self, df: DataFrame) -> DataFrame:
        """Rows with ``split`` (train, test) and ``label`` as a number."""
        c = self.config
        rows = df.select(c.id_col, *c.variables, F.col(c.label).cast("double").alias("label"))
        return train_test_split(rows, test_size=c.test_size, seed=c.seed, id_col=c.id_col)

    def train(self, df: DataFrame, *, cv: int | None = None, scoring: str | Callable[[DataFrame], float] | None = None,
              resample: bool | None = None) -> "RareFlagger":
        """Search every configured family on the training part and refit the best of each."""
        c = self.config
        part = self.split(df).where(F.col("split") == "train").drop("split")
        resample = c.resample if resample is None else resample
        carry = [c.id_col, "label"]
        self.result = search(part, c.families, lambda: self.preprocessing(carry), cv=cv or c.cv,
                             scoring=scoring or c.scoring, id_col=c.id_col,
                             resample=(lambda x: smote_training(x, id_col=c.id_col)) if resample else None)
        if self.result.best:
            # without a positive score there is no winner; the best mean score, first family first, is used
            best = max(self.result.best, key=lambda f: (self.result.best[f][1], -list(c.families).index(f)))
            self.family = self.result.winner[0] if self.result.winner else best
            self.best_model = self.result.models[self.family]
        return self

    def _trained(self) -> PipelineModel:
        if self.best_model is None:
            raise ValueError("train or load a model first")
        return self.best_model

    def save(self, root: str, feature_set: str, all_families: bool = False) -> dict[str, str]:
        """Store the best model, or that of every family; {family: path}."""
        self._trained()
        if self.result is None:
            raise ValueError("only a trained search can be saved")
        spark = self.result.cv_results.sparkSession
        names = list(self.result.models) if all_families else [self.family]
        return {f: store.save_model(spark, self.result.models[f], root, feature_set, f, *self.result.best[f][:2])
                for f in names}

    def load(self, path: str) -> "RareFlagger":
        self.best_model = store.load_model(path)
        return self

    def predict(self, df: DataFrame, prob: bool = False) -> DataFrame:
        """id and prediction of every row that can be scored, and p0, p1 with ``prob`` (null for a family without)."""
        c, model = self.config, self._trained()
        # the label, where there is one, is not an input
        rows = df.select(c.id_col, *c.variables).withColumn("label", F.lit(None).cast("double"))
        out = model.transform(rows)
        for p in ("p0", "p1"):
            if p not in out.columns:
                out = out.withColumn(p, F.lit(None).cast("double"))
        return out.select(c.id_col, "prediction", *(["p0", "p1"] if prob else []))

    def evaluate(self, df: DataFrame) -> DataFrame:
        """Confusion counts, MAE, RMSE, F1 and accuracy on the training and the test part."""
        parts = self.split(df)
        out = None
        for name in ("train", "test"):  # batch statistics are those of each part
            part = self._trained().transform(parts.where(F.col("split") == name).drop("split"))
            part = part.select("label", "prediction", F.lit(name).alias("split"))
            out = part if out is None else out.unionByName(part)
        return M.error_metrics(out, "label", "prediction", by=["split"])
