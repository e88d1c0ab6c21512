import pytest
from pyspark.sql import functions as F

from rareflag.operators.ordered import bucket_column, rank_within
from rareflag.operators.split import stratified_folds


@pytest.mark.parametrize("value", [
    "if(id = 0, 1.0D, id * 1e-9)",  # one value far off
    "exp(id / 2000.0)", "concat('row-', sha2(cast(id as string), 256))", "cast(id % 40 as int)",
    "cast(id as decimal(20, 3))", "date_add(date'2020-01-01', cast(id as int))"])
def test_buckets_are_even_and_monotone(spark, value):
    df = spark.range(20_000).select("id", F.expr(value).alias("v")).persist()
    got = df.select("v", bucket_column(df, F.col("v"), 16).alias("b")).groupBy("b").agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
    assert len(got) >= 12 and max(r.n for r in got) <= 2 * 20_000 / 16
    assert all(x.hi < y.lo for x, y in zip(got, got[1:]))
    df.unpersist()


def test_ranks_of_strings_nulls_and_nan(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("é",)], "k string")
    out = {r.k: r["rank"] for r in rank_within(df, [F.col("k").asc()], F.col("k"), buckets=3).collect()}
    assert out == {None: 0, "a": 1, "b": 2, "c": 3, "é": 4}
    nums = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (-5.0,), (float("inf"),)], "k double")
    out = [(r["rank"], str(r.k)) for r in rank_within(nums, [F.col("k").asc()], F.col("k"), buckets=4).collect()]
    assert sorted(out) == [(0, "None"), (1, "-5.0"), (2, "1.0"), (3, "inf"), (4, "nan")]
    assert rank_within(nums.limit(0), [F.col("k").asc()], F.col("k"), buckets=4).count() == 0


def test_folds_of_string_ids(spark):
    df = spark.range(100).select(F.concat(F.lit("x"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("id"),
                                 (F.col("id") % 2).cast("int").alias("label"))
    sizes = {(r.label, r.fold): r["count"] for r in stratified_folds(df, 5).groupBy("label", "fold").count().collect()}
    assert sizes == {(lab, f): 10 for lab in (0, 1) for f in range(5)}
