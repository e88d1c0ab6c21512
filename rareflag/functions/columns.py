"""Scalar column functions (F1-F10, E2). Each returns a ``Column`` built from
``pyspark.sql.functions`` so it stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: str | Column) -> Column:
    """Round to 6 places (stable comparison of float results)."""
    return F.round(_c(c), 6)


def sig(c: str | Column, digits: int = 9) -> Column:
    """Round to ``digits`` significant digits (stable comparison of large sums)."""
    x = _c(c)
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | x.isNull(), x).otherwise(F.round(x / p, digits - 1) * p)


def null_indicator(c: str | Column) -> Column:
    """1 where the value is NULL (NaN is made NULL at the source), else 0 (F1)."""
    return F.isnull(_c(c)).cast("int")


def byte_flag(c: str | Column) -> Column:
    """Bytes → UTF-8 text → 1 if non-empty else 0 (F4). ``b"0"`` gives 1.
    NULL gives 0; its null indicator carries the missing value."""
    return F.coalesce((F.length(F.decode(_c(c), "UTF-8")) > 0).cast("int"), F.lit(0))


def colour_index(a: str | Column, b: str | Column) -> Column:
    """Difference of two magnitudes, NULL-propagating."""
    return _c(a) - _c(b)


def label_equals(c: str | Column, value: str) -> Column:
    """Class string equality as 0/1."""
    return (_c(c) == F.lit(value)).cast("int")


def threshold_label(p1: str | Column, t: float | Column) -> Column:
    """Re-prediction with a threshold: 1 if p1 > t (strict), else 0."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return (_c(p1) > t).cast("int")


def class1_probability(probability: str | Column) -> Column:
    """Second entry of an MLlib probability vector."""
    return vector_to_array(_c(probability)).getItem(1)
