"""Train/test split (W1) and stratified k-fold (W2), exact and reproducible.

Randomness is ``md5(seed:id)``, so the assignment does not depend on
partitioning, file order or retries, and the DuckDB oracle reproduces it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareflag.functions.randomness import TWO32, hash_u32
from rareflag.operators.ordered import cut_values, rank_within


def split_key(seed: int, id_col: str = "id"):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = 123, id_col: str = "id",
                     split_col: str = "split", exact: bool = True) -> DataFrame:
    """Adds ``split`` = 'test' / 'train'. Shuffled, not stratified.

    ``exact``: the test part has exactly ceil(test_size * n) rows — the rows
    with the smallest md5(seed:id) (ties by id). Only the last key of the test
    part is searched, so rows stay where they are; where rows of one id lie on
    both sides of it, all rows are ranked. ``exact=False`` thresholds
    the hash's leading 32 bits instead (no count, no ranking; size within
    sampling error).
    """
    if not exact:
        return df.withColumn(split_col, F.when(hash_u32(seed, F.col(id_col)) < F.lit(test_size * TWO32),
                                               "test").otherwise("train"))
    # the count and the passes of the search each read the input: persist it once
    if not df.is_cached:
        df = df.persist()
    n = df.count()
    n_test = math.ceil(test_size * n)
    if not n_test:
        return df.withColumn(split_col, F.lit("train"))
    last, below, equal = cut_values(df, split_key(seed, id_col), {0: [n_test - 1]})[0][n_test - 1]
    if below + equal == n_test:
        return df.withColumn(split_col, F.when(_up_to(split_key(seed, id_col), last), "test").otherwise("train"))
    keyed = df.withColumn("_rf_key", split_key(seed, id_col))
    # leading 52 bits of the hex key: a number non-decreasing in the key order
    prefix = F.conv(F.substring(F.col("_rf_key"), 1, 13), 16, 10).cast("double")
    ranked = rank_within(keyed, [F.col("_rf_key").asc(), F.col(id_col).asc()], prefix, out="_rf_rank")
    # rows of one id have no order of their own: drawn once
    return (ranked.withColumn(split_col, F.when(F.col("_rf_rank") < n_test, "test").otherwise("train"))
            .drop("_rf_key", "_rf_rank").persist())


def _up_to(value: Column, last) -> Column:
    """Whether ``value`` is at most ``last``, nulls first."""
    return value.isNull() if last is None else value.isNull() | (value <= F.lit(last))


def fold_bounds(class_counts: dict, k: int) -> dict:
    """Per class, the exclusive upper rank bound of each fold.

    Classes in ascending order; class c with n_c rows and s_c rows in smaller
    classes gives fold i floor((s+n-1-i+k)/k) - floor((s-1-i+k)/k) rows —
    the allocation of stratified k-fold without shuffling.
    """
    out, s = {}, 0
    for c in sorted(class_counts):
        n = class_counts[c]
        hi, bounds = 0, []
        for i in range(k):
            a = (s + n - 1 - i + k) // k - (s - 1 - i + k) // k
            hi += a
            bounds.append(hi)
        out[c] = bounds
        s += n
    return out


def stratified_folds(df: DataFrame, k: int = 5, label_col: str = "label", id_col: str = "id",
                     fold_col: str = "fold") -> DataFrame:
    """Adds ``fold`` in 0..k-1: rows of each class in id order, consecutive blocks.

    Only the last id of each block is searched; where rows of one id lie on both sides of a bound,
    all rows are ranked."""
    if not df.is_cached:
        df = df.persist()
    counts = {r[0]: int(r[1]) for r in df.groupBy(label_col).count().collect()}
    bounds = fold_bounds(counts, k)
    wanted = {c: sorted({hi - 1 for hi in bs if 0 < hi < counts[c]}) for c, bs in bounds.items()
              if c is not None}
    cuts = cut_values(df, F.col(id_col), wanted, F.col(label_col))
    exact = all(below + equal == r + 1 for found in cuts.values() for r, (_, below, equal) in found.items())
    ranked = df if exact else rank_within(df, [F.col(id_col).asc()], F.col(id_col), keys=[label_col], out="_rf_rank")
    expr = None
    for c, bs in bounds.items():
        inner = None
        for i, hi in enumerate(bs):
            if not exact:
                cond = F.col("_rf_rank") < hi
            elif 0 < hi < counts[c] and c is not None:
                cond = _up_to(F.col(id_col), cuts[c][hi - 1][0])
            else:
                cond = F.lit(hi > 0)
            inner = F.when(cond, i) if inner is None else inner.when(cond, i)
        cc = F.col(label_col) == F.lit(c)
        expr = F.when(cc, inner) if expr is None else expr.when(cc, inner)
    return ranked.withColumn(fold_col, expr.cast("int")).drop("_rf_rank")
