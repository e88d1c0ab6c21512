"""Evaluation metrics as DataFrames.

Counting metrics are one aggregation pass with conditional sums (partial
aggregation on every executor, a single tiny row out); per-split metrics
group by the split column. Curves group by score and take running sums via
range partitions (``ordered.running_sums``), never a single-task window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareflag.operators.ordered import running_sums


def _y(c):
    return F.col(c).cast("int")


def counts_expr(label: str = "label", pred: str = "prediction") -> list[Column]:
    y, p = _y(label), F.col(pred).cast("int")
    return [F.count(F.lit(1)).alias("n"),
            F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).cast("bigint").alias("tn"),
            F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).cast("bigint").alias("fp"),
            F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).cast("bigint").alias("fn"),
            F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).cast("bigint").alias("tp")]


def f1_from_counts(tp: Column, fp: Column, fn: Column) -> Column:
    """Binary F1 of class 1: 2tp / (2tp + fp + fn); 0 when undefined."""
    den = 2 * tp + fp + fn
    return F.when(den == 0, F.lit(0.0)).otherwise((2.0 * tp) / den)


def error_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                  by: Sequence[str] = ()) -> DataFrame:
    """n, tn, fp, fn, tp, mae, rmse, f1, accuracy in one pass."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    g = df.groupBy(*by) if by else df.groupBy()
    a = g.agg(*counts_expr(label, pred),
              F.avg(F.abs(y - p)).alias("mae"),
              F.sqrt(F.avg(F.pow(y - p, 2))).alias("rmse"),
              F.avg((y == p).cast("double")).alias("accuracy"))
    return a.withColumn("f1", f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction",
              by: Sequence[str] = ()) -> DataFrame:
    """2x2 confusion matrix, zero cells kept: (actual, predicted, n) (A10)."""
    c = error_metrics(df, label, pred, by).select(*by, "tn", "fp", "fn", "tp")
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(n).alias("n"))
                      for a, b, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return c.select(*by, F.inline(cells))


def confusion_percent(df: DataFrame, label: str = "label", pred: str = "prediction",
                      by: Sequence[str] = ()) -> DataFrame:
    """Row-normalised confusion matrix in percent."""
    c = confusion(df, label, pred, by)
    tot = c.groupBy(*by, "actual").agg(F.sum("n").alias("row_n"))
    j = c.join(tot, [*by, "actual"])
    return j.select(*by, "actual", "predicted", "n",
                    F.when(F.col("row_n") == 0, F.lit(0.0))
                    .otherwise(100.0 * F.col("n") / F.col("row_n")).alias("percent"))


def class_prediction_error(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Counts of predicted class per actual class, one row per actual."""
    c = error_metrics(df, label, pred)
    return c.select(F.inline(F.array(
        F.struct(F.lit(0).alias("actual"), F.col("tn").alias("predicted_0"), F.col("fp").alias("predicted_1")),
        F.struct(F.lit(1).alias("actual"), F.col("fn").alias("predicted_0"), F.col("tp").alias("predicted_1")))))


def _row(name, p, r, f, s):
    return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                    s.alias("support"))


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1, support per class plus accuracy, macro and
    weighted averages (A16); undefined ratios are 0."""
    c = error_metrics(df, label, pred)

    def ratio(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    p1, r1 = ratio(tp, tp + fp), ratio(tp, tp + fn)
    p0, r0 = ratio(tn, tn + fn), ratio(tn, tn + fp)
    s0, s1 = tn + fp, tp + fn
    per = c.select(p0.alias("p0"), r0.alias("r0"), p1.alias("p1"), r1.alias("r1"),
                   s0.alias("s0"), s1.alias("s1"), F.col("accuracy"), F.col("n").cast("double").alias("n"))
    f = lambda p, r: F.when((F.col(p) + F.col(r)) == 0, F.lit(0.0)).otherwise(
        2 * F.col(p) * F.col(r) / (F.col(p) + F.col(r)))
    per = per.withColumn("f0", f("p0", "r0")).withColumn("f1", f("p1", "r1"))
    rows = F.array(
        _row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        _row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        _row("accuracy", F.col("accuracy"), F.col("accuracy"), F.col("accuracy"), F.col("n")),
        _row("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2,
             (F.col("f0") + F.col("f1")) / 2, F.col("n")),
        _row("weighted avg", (F.col("p0") * F.col("s0") + F.col("p1") * F.col("s1")) / F.col("n"),
             (F.col("r0") * F.col("s0") + F.col("r1") * F.col("s1")) / F.col("n"),
             (F.col("f0") * F.col("s0") + F.col("f1") * F.col("s1")) / F.col("n"), F.col("n")))
    return per.select(F.inline(rows))


def prediction_tally(df: DataFrame, pred: str = "prediction") -> DataFrame:
    """Number flagged and total."""
    return df.agg(F.sum(F.col(pred).cast("bigint")).cast("bigint").alias("flagged"),
                  F.count(F.lit(1)).alias("total"))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], label: str = "label",
                    score: str = "p1") -> DataFrame:
    """Re-prediction at each threshold (p1 > t), confusion counts and F1 per
    threshold — one pass over the data for all thresholds (F9)."""
    y, s = _y(label), F.col(score)
    aggs = []
    for i, t in enumerate(thresholds):
        hit = s > F.lit(float(t))
        aggs += [F.sum(F.when(hit & (y == 1), 1).otherwise(0)).alias(f"tp{i}"),
                 F.sum(F.when(hit & (y == 0), 1).otherwise(0)).alias(f"fp{i}"),
                 F.sum(F.when(~hit & (y == 1), 1).otherwise(0)).alias(f"fn{i}"),
                 F.sum(F.when(~hit & (y == 0), 1).otherwise(0)).alias(f"tn{i}")]
    a = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"),
                              F.col(f"tn{i}").cast("bigint").alias("tn"), F.col(f"fp{i}").cast("bigint").alias("fp"),
                              F.col(f"fn{i}").cast("bigint").alias("fn"), F.col(f"tp{i}").cast("bigint").alias("tp"))
                     for i, t in enumerate(thresholds)])
    out = a.select(F.inline(rows))
    return out.withColumn("f1", f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn")))


def _curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score (descending): running tp, fp and totals."""
    y = _y(label)
    g = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.sum(y).cast("bigint").alias("t"), F.sum(1 - y).cast("bigint").alias("f"))
    tot = g.agg(F.sum("t").alias("tt"), F.sum("f").alias("ff"))
    c = running_sums(g, [F.col("threshold").desc()], -F.col("threshold"), ["t", "f"])
    # totals are exactly one row (proven size): broadcast on a constant key
    c = c.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return (c.withColumn("tp", F.col("cum_t")).withColumn("fp", F.col("cum_f"))
            .withColumn("tp0", F.col("cum_t") - F.col("t")).withColumn("fp0", F.col("cum_f") - F.col("f")))


def roc_curve(df: DataFrame, label: str = "label", score: str = "p1") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score (W6); the rate of an absent class is null."""
    c = _curve_points(df, label, score)
    return c.select("threshold", (F.try_divide("fp", "ff")).alias("fpr"),
                    (F.try_divide("tp", "tt")).alias("tpr"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "p1") -> DataFrame:
    """(threshold, precision, recall) per distinct score."""
    c = _curve_points(df, label, score)
    return c.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    (F.try_divide("tp", "tt")).alias("recall"))


def roc_auc_ap(df: DataFrame, label: str = "label", score: str = "p1") -> DataFrame:
    """ROC AUC (trapezoids) and average precision Σ (R_n − R_{n−1}) P_n; null without rows of a class it needs."""
    c = _curve_points(df, label, score)
    tpr, fpr = F.try_divide("tp", "tt"), F.try_divide("fp", "ff")
    tpr0, fpr0 = F.try_divide("tp0", "tt"), F.try_divide("fp0", "ff")
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    return c.agg(F.sum((fpr - fpr0) * (tpr + tpr0) / 2).alias("auc"),
                 F.sum((tpr - tpr0) * prec).alias("average_precision"))
