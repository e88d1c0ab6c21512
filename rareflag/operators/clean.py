"""Cleaning: null indicators, imputation, sentinel fill, byte flags, one-hot.

``Cleaner`` is a ``pyspark.ml`` Estimator so it sits in a ``Pipeline`` and is
saved with the model. One aggregation computes all column statistics; the
rewrite is one ``select`` of built-in expressions (a single narrow stage).

Modes (§ traps 2-4 of the survey):

* ``mode="batch"`` — parity with the reference: statistics are taken from the
  batch being transformed, so train, test and each scoring batch get their own
  fills. Nothing is learned at fit.
* ``mode="frozen"`` — statistics are learned at fit and reused; the mode for
  production and streaming (a source's score does not depend on its batch).

``on_unscorable="drop"`` drops rows still holding a null after cleaning (the
reference's ``dropna``; an all-null column in a batch drops every row);
``"null"`` keeps such rows with nulls so the id survives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareflag.functions.columns import byte_flag, null_indicator
from rareflag.operators.quantiles import means, medians

# The extraction-flag columns of the telescope table, which get
# the sentinel -1 when still null after imputation.
EFLAG_COLUMNS = ["EFLAG_R0", "EFLAG_R1", "EFLAG_R2", "EFLAG_R3",
                 "EFLAG_B0", "EFLAG_B1", "EFLAG_B2", "EFLAG_B3"]
# Byte-string flag columns of the telescope table.
BINARY_COLUMNS = ["NEW_SRC", "DMAG_CAT"]
SENTINEL = -1.0
ISNAN_SUFFIX = "_isnan"


def check_columns(df: DataFrame, required: Sequence[str]) -> None:
    """Predict-time projection check (P2): extras are ignored, missing fail."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise KeyError(f"input is missing configured columns: {missing}")


def indicator_names(variables: Sequence[str]) -> list[str]:
    return [f"{c}{ISNAN_SUFFIX}" for c in variables]


def cleaned_feature_names(variables: Sequence[str]) -> list[str]:
    """Model inputs after cleaning: variables in order, then all indicators."""
    return list(variables) + indicator_names(variables)


class _CleanerParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "configured feature columns",
                      typeConverter=TypeConverters.toListString)
    flagCols = Param(Params._dummy(), "flagCols", "columns filled with -1 when still null",
                     typeConverter=TypeConverters.toListString)
    binaryCols = Param(Params._dummy(), "binaryCols", "byte columns turned into 0/1",
                       typeConverter=TypeConverters.toListString)
    passCols = Param(Params._dummy(), "passCols", "columns carried through (id, label, ...)",
                     typeConverter=TypeConverters.toListString)
    mode = Param(Params._dummy(), "mode", "batch | frozen", typeConverter=TypeConverters.toString)
    strategy = Param(Params._dummy(), "strategy", "median | mean | drop | keep",
                     typeConverter=TypeConverters.toString)
    onUnscorable = Param(Params._dummy(), "onUnscorable", "drop | null",
                         typeConverter=TypeConverters.toString)
    medianMethod = Param(Params._dummy(), "medianMethod", "select | exact | approx",
                         typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(flagCols=list(EFLAG_COLUMNS), binaryCols=list(BINARY_COLUMNS),
                         passCols=[], mode="batch", strategy="median", onUnscorable="drop",
                         medianMethod="select")

    def _numeric_vars(self) -> list[str]:
        binary = set(self.getOrDefault("binaryCols"))
        return [c for c in self.getOrDefault("inputCols") if c not in binary]


class Cleaner(Estimator, _CleanerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator for the cleaning step."""

    @keyword_only
    def __init__(self, *, inputCols=None, flagCols=None, binaryCols=None, passCols=None,
                 mode=None, strategy=None, onUnscorable=None, medianMethod=None):
        super().__init__()
        kwargs = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**kwargs)

    def _fit(self, df: DataFrame) -> "CleanerModel":
        stats: dict[str, float | None] = {}
        if self.getOrDefault("mode") == "frozen":
            stats = compute_statistics(df, self._numeric_vars(), self.getOrDefault("strategy"),
                                       self.getOrDefault("medianMethod"))
        m = CleanerModel()
        self._copyValues(m)
        m._set(statistics=[("" if stats.get(c) is None else repr(stats[c]))
                           for c in self._numeric_vars()] if stats else [])
        return m


class CleanerModel(Model, _CleanerParams, DefaultParamsReadable, DefaultParamsWritable):
    statistics = Param(Params._dummy(), "statistics", "frozen fill values ('' = none)",
                       typeConverter=TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(statistics=[])

    def fill_values(self, df: DataFrame) -> dict[str, float | None]:
        num = self._numeric_vars()
        if self.getOrDefault("mode") == "frozen":
            vals = self.getOrDefault("statistics")
            return {c: (None if v == "" else float(v)) for c, v in zip(num, vals)}
        return compute_statistics(df, num, self.getOrDefault("strategy"),
                                  self.getOrDefault("medianMethod"))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.transform_with_fills(df, None)

    def transform_with_fills(self, df: DataFrame, fills: dict[str, float | None] | None) -> DataFrame:
        """Transform with given fill values (statistics computed by the caller,
        e.g. for several batches in one pass); ``None`` uses the mode's own."""
        variables = self.getOrDefault("inputCols")
        check_columns(df, variables)
        if fills is None:
            fills = self.fill_values(df)
        return apply_cleaning(df, variables, fills,
                              flag_cols=self.getOrDefault("flagCols"),
                              binary_cols=self.getOrDefault("binaryCols"),
                              pass_cols=[c for c in self.getOrDefault("passCols") if c in df.columns],
                              strategy=self.getOrDefault("strategy"),
                              on_unscorable=self.getOrDefault("onUnscorable"))


def compute_statistics(df: DataFrame, cols: Sequence[str], strategy: str,
                       median_method: str = "select") -> dict[str, float | None]:
    if strategy == "median":
        return medians(df, cols, median_method)
    if strategy == "mean":
        return means(df, cols)
    if strategy in ("drop", "keep"):
        return {}
    raise ValueError(f"unknown null strategy {strategy!r}; use median, mean, drop or keep")


def apply_cleaning(df: DataFrame, variables: Sequence[str], fills: dict[str, float | None],
                   flag_cols: Sequence[str] = EFLAG_COLUMNS, binary_cols: Sequence[str] = BINARY_COLUMNS,
                   pass_cols: Sequence[str] = (), strategy: str = "median",
                   on_unscorable: str = "drop") -> DataFrame:
    """One projection: filled variables, byte flags, then indicators."""
    flags, binary = set(flag_cols), set(binary_cols)
    values, checks = [], []
    for c in variables:
        if c in binary:
            values.append(byte_flag(c).alias(c))
            continue
        v = F.col(c).cast("double")
        fill = fills.get(c)
        if fill is not None:
            v = F.coalesce(v, F.lit(float(fill)))
        if c in flags and strategy in ("median", "mean"):
            v = F.coalesce(v, F.lit(SENTINEL))
        values.append(v.alias(c))
        checks.append(c)
    indicators = [null_indicator(c).alias(f"{c}{ISNAN_SUFFIX}") for c in variables]
    out = df.select(*[F.col(c) for c in pass_cols], *values, *indicators)
    if strategy == "keep":
        return out
    if on_unscorable == "drop" or strategy == "drop":
        return out.na.drop("any", subset=checks) if checks else out
    if on_unscorable == "null":
        return out
    raise ValueError(f"unknown on_unscorable {on_unscorable!r}")


def clean(df: DataFrame, variables: Sequence[str], *, flag_cols=EFLAG_COLUMNS,
          binary_cols=BINARY_COLUMNS, pass_cols=(), strategy="median",
          on_unscorable="drop", median_method="select") -> DataFrame:
    """Functional form of a batch-mode cleaner (statistics from ``df``).

    The statistics take a few passes over ``df``; it is persisted first so
    the passes (and the projection) do not recompute its lineage."""
    check_columns(df, variables)
    if not df.is_cached:
        df = df.persist()
    num = [c for c in variables if c not in set(binary_cols)]
    fills = compute_statistics(df, num, strategy, median_method)
    return apply_cleaning(df, variables, fills, flag_cols, binary_cols, pass_cols, strategy,
                          on_unscorable)


# ---------------------------------------------------------------- one-hot

class _OneHotParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "categorical columns",
                      typeConverter=TypeConverters.toListString)
    maxCategories = Param(Params._dummy(), "maxCategories", "error above this many categories",
                          typeConverter=TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(maxCategories=1000)


class OneHotColumns(Estimator, _OneHotParams, DefaultParamsReadable, DefaultParamsWritable):
    """One-hot encoding into flat named columns ``<col>_<value>``.

    Fit learns the distinct values (ascending) of each column; unseen values
    get all zeros; originals are dropped and the new columns appended.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, maxCategories=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "OneHotColumnsModel":
        cols = self.getOrDefault("inputCols")
        limit = self.getOrDefault("maxCategories")
        # distinct values of all columns in one job, bounded by maxCategories
        parts = [df.select(F.lit(i).alias("k"), F.col(c).cast("string").alias("v")).where(F.col("v").isNotNull())
                 for i, c in enumerate(cols)]
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        rows = u.distinct().limit(limit * len(cols) + 1).collect()
        cats: dict[int, list[str]] = {i: [] for i in range(len(cols))}
        for r in rows:
            cats[int(r["k"])].append(r["v"])
        for i, c in enumerate(cols):
            if len(cats[i]) > limit:
                raise ValueError(f"column {c} has more than {limit} categories")
        m = OneHotColumnsModel()
        self._copyValues(m)
        m._set(categories=["\u0001".join(sorted(cats[i])) for i in range(len(cols))])
        return m


class OneHotColumnsModel(Model, _OneHotParams, DefaultParamsReadable, DefaultParamsWritable):
    categories = Param(Params._dummy(), "categories", "sorted categories per column",
                       typeConverter=TypeConverters.toListString)

    def __init__(self):
        super().__init__()

    def category_lists(self) -> list[list[str]]:
        return [s.split("\u0001") if s else [] for s in self.getOrDefault("categories")]

    def output_names(self) -> list[str]:
        out = []
        for c, cats in zip(self.getOrDefault("inputCols"), self.category_lists()):
            out += [f"{c}_{v}" for v in cats]
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault("inputCols")
        new = []
        for c, cats in zip(cols, self.category_lists()):
            for v in cats:
                hit = F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0))
                new.append(hit.alias(f"{c}_{v}"))
        keep = [F.col(c) for c in df.columns if c not in set(cols)]
        return df.select(*keep, *new)
