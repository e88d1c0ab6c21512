import pytest
from pyspark.sql import functions as F

from rareflag import RareFlagger, RunConfig
from rareflag.config import feature_set
from rareflag.operators.explore import density_grid, max_bins_histogram
from rareflag.operators.metrics import roc_auc_ap, roc_curve
from rareflag.sources.tables import read_parquet, read_table
from tests.conftest import SF0001

CONFIG = {"variables": ["a", "b"], "label": "y", "cv": 2,
          "families": {"rfc": {"n_estimators": [3], "max_depth": [3]}, "dt": {"max_depth": [2]}}}


@pytest.fixture(scope="module")
def data(spark):
    h = F.xxhash64("id")
    df = spark.range(200).withColumns({"a": F.pmod(h, F.lit(97)) / 97.0, "b": F.pmod(F.shiftright(h, 9), F.lit(89)) / 89.0})
    return df.withColumn("y", (F.col("a") > 0.6).cast("int")).persist()


@pytest.fixture(scope="module")
def trained(spark, data):
    return RareFlagger(CONFIG).train(data)


def test_construct(spark):
    f = RareFlagger(RunConfig(**CONFIG))
    assert f.config.variables == ["a", "b"] and f.best_model is None and f.preprocessing(["id"])
    with pytest.raises(ValueError):
        f.predict(None)


def test_train(trained):
    assert trained.best_model is not None and trained.family in ("rfc", "dt")
    assert set(trained.result.models) == {"rfc", "dt"}


def test_save_and_load(trained, data, tmp_path):
    paths = trained.save(str(tmp_path / "store"), "set_1", all_families=True)
    assert set(paths) == {"rfc", "dt"}
    again = RareFlagger(CONFIG).load(paths[trained.family])
    want = {r.id: r.prediction for r in trained.predict(data).collect()}
    assert {r.id: r.prediction for r in again.predict(data).collect()} == want


def test_predict_needs_no_label(trained, data):
    out = trained.predict(data.drop("y"), prob=True)
    assert out.columns == ["id", "prediction", "p0", "p1"]
    rows = out.collect()
    assert len(rows) == 200 and all(abs(r.p0 + r.p1 - 1) < 1e-9 for r in rows)


def test_evaluate(trained, data):
    got = {r.split: r for r in trained.evaluate(data).collect()}
    assert got["train"].n == 160 and got["test"].n == 40
    assert got["train"].f1 > 0.9


def test_feature_sets_grow_by_eight_names():
    assert [len(feature_set(n)) for n in (1, 2, 3, 4)] == [8, 16, 24, 32]
    assert all(set(feature_set(n)) < set(feature_set(n + 1)) for n in (1, 2, 3))


def test_comparisons_reach_the_parquet_reader(spark, tmp_path):
    df = read_table(spark, SF0001, "lineitem", ["l_quantity"], where=[("l_quantity", ">", 30.0)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,30.0)]" in plan
    path = str(tmp_path / "t")
    rows = [(1, 40.0), (2, float("nan")), (3, None), (4, 5.0)]
    spark.createDataFrame(rows, "id int, x double").write.parquet(path)
    assert [r.id for r in read_parquet(spark, path, where=[("x", ">", 30.0)]).collect()] == [1]
    assert {r.id: r.x for r in read_parquet(spark, path).collect()} == {1: 40.0, 2: None, 3: None, 4: 5.0}
    with pytest.raises(ValueError):
        read_parquet(spark, path, where=[("x", "is", None)])
    spark.createDataFrame([(1, float("inf"))], "id int, x double").write.mode("append").parquet(path)
    with pytest.raises(Exception, match="infinite value"):
        read_parquet(spark, path, where=[("x", ">", 30.0)]).collect()


def test_constant_columns_and_one_class_do_not_divide_by_zero(spark):
    df = spark.createDataFrame([(2.0, 2.0, 1, 0.5), (2.0, 2.0, 1, 0.7)], "x double, z double, c int, p1 double")
    assert [(r.bin, r.n) for r in max_bins_histogram(df, "x").collect()] == [(0, 2)]
    assert sum(r.density for r in density_grid(df, "x", "z", "c").collect()) == pytest.approx(2)
    auc = roc_auc_ap(df, "c", "p1").first()
    assert auc.auc is None and auc.average_precision == pytest.approx(1.0)
    assert all(r.fpr is None for r in roc_curve(df, "c", "p1").collect())


def test_density_keeps_the_mass_of_each_class(spark):
    df = spark.range(500).select((F.col("id") % 37 * 1.0).alias("x"), (F.col("id") % 23 * 1.0).alias("z"),
                                 (F.col("id") % 3).alias("c"))
    mass = {r["class"]: r.m for r in density_grid(df, "x", "z", "c").groupBy("class").agg(F.sum("density").alias("m")).collect()}
    assert mass == pytest.approx({0: 167, 1: 167, 2: 166})
