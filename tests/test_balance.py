import math

import pytest
from pyspark.errors import PySparkException

from rareflag.operators.balance import smote
from rareflag.sources.tables import nan_to_null


def _rows(spark, sizes):
    rows = [(10 * c + i, [float(i), float(c)], c) for c, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int")


def test_smote_needs_more_than_k_rows(spark):
    with pytest.raises(ValueError, match="more than 5 rows"):
        smote(_rows(spark, [10, 3]), "label", "v")
    with pytest.raises(ValueError, match="strategy"):
        smote(_rows(spark, [10, 8]), "label", "v", strategy="majority")


@pytest.mark.parametrize("strategy,want", [("minority", {2: 4}), ("not majority", {1: 2, 2: 4})])
def test_smote_fills_to_the_largest_class(spark, strategy, want):
    out = smote(_rows(spark, [10, 8, 6]), "label", "v", strategy=strategy)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == want


def test_nan_becomes_null_and_infinity_is_an_error(spark):
    df = spark.createDataFrame([(1, 2.0), (2, math.nan), (3, None)], "id long, `a.b` double")
    assert [r[1] for r in nan_to_null(df).orderBy("id").collect()] == [2.0, None, None]
    for bad in (math.inf, -math.inf):
        with pytest.raises(PySparkException, match="infinite value in column x"):
            nan_to_null(spark.createDataFrame([(bad,)], "x double")).collect()
