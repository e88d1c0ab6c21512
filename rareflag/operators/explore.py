"""Exploration operators.

Each is one aggregation (partial aggregation before the shuffle) whose
result is small, then reshaped with ``inline`` — no per-column jobs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of numeric type (P10)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def null_inventory(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and any-null flag per column (P11, A2), one pass."""
    cols = list(cols or df.columns)
    a = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"))
                     for i, c in enumerate(cols)])
    return a.select(F.inline(rows)).withColumn("any_null", F.col("null_count") > 0)


def _distinct_key(df: DataFrame, c: str):
    """Doubles are compared at 6 decimals (last-bit noise of computed values
    would otherwise count as distinct)."""
    t = df.schema[c].dataType
    return F.round(F.col(c), 6) if isinstance(t, (T.DoubleType, T.FloatType)) else F.col(c)


def profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Type, row count, non-null count and distinct count per column."""
    cols = list(cols or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    a = df.agg(F.count(F.lit(1)).alias("n_rows"),
               *[F.count(F.col(c)).alias(f"nn{i}") for i, c in enumerate(cols)],
               *[F.countDistinct(_distinct_key(df, c)).alias(f"nd{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"),
                              F.col("n_rows").alias("n_rows"), F.col(f"nn{i}").alias("n_non_null"),
                              F.col(f"nd{i}").alias("n_distinct")) for i, c in enumerate(cols)])
    return a.select(F.inline(rows))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value, nulls excluded (A5)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def group_class_counts(df: DataFrame, group: str, label: str, cols: Sequence[str]) -> DataFrame:
    """Per group and class: all rows and rows without any null in ``cols``."""
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    return df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"),
                                        F.count_if(complete).alias("n_complete"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced class weights n / (k · n_c) (A9). The result has one row per
    class; join it to the data to get a ``weightCol``."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    # one-row totals broadcast on a constant key (proven size: one row)
    j = c.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k")
    return j.select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Add the balanced weight column; the class table is tiny (one row per
    class) so the join is a broadcast."""
    w = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label)


def corr_pairs(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation for every pair (i < j), pairwise complete like
    pandas (A19); ``by`` gives one matrix per group."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    g = df.groupBy(*by) if by else df.groupBy()
    a = g.agg(*[F.corr(x, y).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), F.col(f"c{i}").alias("corr"))
                     for i, (x, y) in enumerate(pairs)])
    return a.select(*by, F.inline(rows)).withColumn("abs_corr", F.abs("corr"))


def covariance_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample covariance for every pair i <= j (A23 input)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    a = df.agg(*[F.covar_samp(x, y).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), F.col(f"c{i}").alias("cov"))
                     for i, (x, y) in enumerate(pairs)])
    return a.select(F.inline(rows))


def max_bins_histogram(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Histogram with ``max(col)`` equal-width bins over [min, max], the last
    bin closed (A20, A21); all rows of a constant column are in bin 0. min/max is one tiny aggregate, broadcast."""
    mm = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx"))
    d = df.where(F.col(col).isNotNull()).withColumn("_k", F.lit(1))
    j = d.join(F.broadcast(mm.withColumn("_k", F.lit(1))), "_k")
    b = F.when(F.col("mx") > F.col("mn"), F.least(
        F.floor((F.col(col) - F.col("mn")) / (F.col("mx") - F.col("mn")) * F.col("mx")).cast("int"),
        F.col("mx").cast("int") - 1)).otherwise(0)
    return j.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density_grid(df: DataFrame, x: str, y: str, label: str, bins: int = 20,
                 sigma: float = 1.0, reach: float = 4.0) -> DataFrame:
    """2-D density by class on a bins x bins grid (A22), Gaussian-smoothed.

    The kernel is separable: one pass spreads each cell's count along x, one along y, over
    ``reach`` sigmas with weights that sum to 1. What would leave the grid is reflected at its
    edge, so a class's densities add up to its rows. After the count only bins x bins cells a
    class are left. A constant column is one bin."""
    mm = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_k", F.lit(1))
    j = d.join(F.broadcast(mm.withColumn("_k", F.lit(1))), "_k")

    def cell(c, lo, hi):
        at = F.floor((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins).cast("int")
        return F.when(F.col(hi) > F.col(lo), F.least(at, F.lit(bins - 1))).otherwise(0)

    g = j.groupBy(F.col(label).alias("class"), cell(x, "x0", "x1").alias("bx"),
                  cell(y, "y0", "y1").alias("by")).agg(F.count(F.lit(1)).cast("double").alias("density"))
    radius = math.ceil(reach * sigma)
    weight = {o: math.exp(-o * o / (2 * sigma * sigma)) for o in range(-radius, radius + 1)}
    total = sum(weight.values())
    offsets = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w / total).alias("w")) for o, w in weight.items()])
    for axis in ("bx", "by"):
        other = "by" if axis == "bx" else "bx"
        at = F.pmod(F.col(axis) + F.col("o"), F.lit(2 * bins))
        at = F.when(at < bins, at).otherwise(2 * bins - 1 - at)
        g = (g.select("class", axis, other, "density", F.inline(offsets))
             .groupBy("class", F.col(other), at.alias(axis)).agg(F.sum(F.col("density") * F.col("w")).alias("density")))
    return g.select("class", "bx", "by", "density")
