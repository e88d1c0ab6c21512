import math

import pytest
from pyspark.sql import functions as F

from rareflag.operators.clean import Cleaner, OneHotColumns, clean
from rareflag.sources.tables import nan_to_null

SCHEMA = "id long, a double, EFLAG_R0 double, NEW_SRC binary, y int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_empty_frame_keeps_schema(spark):
    out = clean(frame(spark, []), ["a", "EFLAG_R0", "NEW_SRC"], pass_cols=["id", "y"])
    assert out.count() == 0
    assert out.columns == ["id", "y", "a", "EFLAG_R0", "NEW_SRC", "a_isnan", "EFLAG_R0_isnan", "NEW_SRC_isnan"]


def test_median_fill_indicator_and_bytes(spark):
    rows = [(1, 1.0, 2.0, b"", 0), (2, None, None, b"0", 1), (3, 3.0, 4.0, None, 0), (4, 10.0, 5.0, b"x", 0)]
    out = {r.id: r for r in clean(frame(spark, rows), ["a", "EFLAG_R0", "NEW_SRC"], pass_cols=["id"]).collect()}
    assert out[2].a == 3.0 and out[2].a_isnan == 1          # median of 1, 3, 10
    assert out[2].EFLAG_R0 == 4.0                            # median first, sentinel only if still null
    assert out[1].NEW_SRC == 0 and out[2].NEW_SRC == 1       # b"" -> 0, b"0" -> 1
    assert out[3].NEW_SRC == 0 and out[3].NEW_SRC_isnan == 1  # null bytes: value 0, indicator 1


def test_all_null_column(spark):
    rows = [(1, None, None, b"1", 0), (2, None, None, b"1", 1)]
    # a non-flag column that is all null drops every row (reference parity)
    assert clean(frame(spark, rows), ["a", "EFLAG_R0"], pass_cols=["id"]).count() == 0
    # the flag column alone gets the sentinel
    out = clean(frame(spark, rows), ["EFLAG_R0"], pass_cols=["id"]).collect()
    assert [r.EFLAG_R0 for r in out] == [-1.0, -1.0]
    # on_unscorable="null" keeps the ids
    kept = clean(frame(spark, rows), ["a"], pass_cols=["id"], on_unscorable="null")
    assert kept.count() == 2


def test_nan_and_null_alike(spark):
    df = nan_to_null(spark.createDataFrame([(1, float("nan")), (2, None), (3, 4.0)], "id long, a double"))
    out = clean(df, ["a"], flag_cols=[], binary_cols=[], pass_cols=["id"]).orderBy("id").collect()
    assert [r.a for r in out] == [4.0, 4.0, 4.0]
    assert [r.a_isnan for r in out] == [1, 1, 0]


@pytest.mark.parametrize("method", ["select", "exact"])
def test_frozen_mode_independent_of_batch(spark, method):
    train = spark.createDataFrame([(i, float(i)) for i in range(11)], "id long, a double")
    model = Cleaner(inputCols=["a"], flagCols=[], binaryCols=[], passCols=["id"], mode="frozen",
                    medianMethod=method).fit(train)
    b1 = spark.createDataFrame([(100, None), (101, 50.0)], "id long, a double")
    b2 = spark.createDataFrame([(100, None), (102, -50.0), (103, -60.0)], "id long, a double")
    v1 = model.transform(b1).where("id = 100").first().a
    v2 = model.transform(b2).where("id = 100").first().a
    assert v1 == v2 == 5.0
    # batch mode: the same source gets different fills in different batches
    bm = Cleaner(inputCols=["a"], flagCols=[], binaryCols=[], passCols=["id"], mode="batch").fit(train)
    assert bm.transform(b1).where("id = 100").first().a != bm.transform(b2).where("id = 100").first().a


def test_cleaner_roundtrip(spark, tmp_path):
    from rareflag.operators.clean import CleanerModel
    train = spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, a double")
    m = Cleaner(inputCols=["a"], flagCols=[], binaryCols=[], passCols=["id"], mode="frozen").fit(train)
    m.write().overwrite().save(str(tmp_path / "c"))
    m2 = CleanerModel.load(str(tmp_path / "c"))
    assert m2.fill_values(train) == m.fill_values(train)


def test_missing_column_is_an_error(spark):
    with pytest.raises(KeyError):
        clean(spark.createDataFrame([(1, 1.0)], "id long, b double"), ["a"])


def test_one_hot_unseen_is_all_zero(spark):
    fit_df = spark.createDataFrame([("x",), ("y",)], "c string")
    m = OneHotColumns(inputCols=["c"]).fit(fit_df)
    out = m.transform(spark.createDataFrame([("x",), ("z",), (None,)], "c string")).collect()
    assert [tuple(r) for r in out] == [(1, 0), (0, 0), (0, 0)]
    assert m.output_names() == ["c_x", "c_y"]


def test_one_pass_batch_fills_equal_per_part(spark):
    from pyspark.ml import Pipeline
    from rareflag.plans.score import _score_batches
    rows = [(i, float(i % 7) if i % 5 else None, "train" if i % 3 else "test") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, split string")
    model = Pipeline(stages=[Cleaner(inputCols=["a"], flagCols=[], binaryCols=[], passCols=["id", "split"],
                                     mode="batch")]).fit(df)
    one = {r.id: r.a for r in _score_batches(model, df, "split", ["train", "test"]).collect()}
    sep = {}
    for part in ("train", "test"):
        sep.update({r.id: r.a for r in model.transform(df.where(F.col("split") == part)).collect()})
    assert one == sep
