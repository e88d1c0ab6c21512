import numpy as np
import pytest

from rareflag.operators.quantiles import builtin_medians, select_medians


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1001])
def test_select_medians_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=n)
    b = np.where(rng.random(n) < 0.4, 3.0, rng.normal(size=n))   # a hot value
    rows = [(float(x), float(y), None) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = select_medians(df, ["a", "b", "c"], bins=8, collect_limit=5)
    assert got["a"] == pytest.approx(float(np.median(a)), abs=0, rel=0)
    assert got["b"] == float(np.median(b))
    assert got["c"] is None
    assert builtin_medians(df, ["a"])["a"] == pytest.approx(float(np.median(a)))


@pytest.mark.parametrize("n", [3, 5000, 20001])
def test_fast_window_path_exact(spark, n):
    rng = np.random.default_rng(7)
    a = rng.normal(size=n)
    hot = np.where(rng.random(n) < 0.34, 0.25, rng.normal(size=n))   # a third of the rows equal
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, hot)], "a double, h double")
    got = select_medians(df, ["a", "h"])
    assert got["a"] == float(np.median(a))
    assert got["h"] == float(np.median(hot))
