import numpy as np
from pyspark.sql import functions as F

from rareflag.plans.importance import principal_axes
from rareflag.streaming.score import read_stream, read_tally, stream_tally


def test_axes_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + 5
    x[:, 3] = 2.0  # a constant column
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    axes = principal_axes(df, cols)
    want = np.linalg.eigvalsh(np.corrcoef(x[:, :3].T))[::-1]
    assert np.allclose(axes.variances[:3], want) and abs(axes.variances[3]) < 1e-9
    v = axes.vectors[:3, :3]
    assert np.allclose(v.T @ v, np.eye(3))
    assert all(col[np.abs(col).argmax()] > 0 for col in v.T)
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0, ddof=1)
    got = np.array([r[4:] for r in axes.project(df, 3).collect()])
    assert np.allclose(got, z @ v)


def test_tally_survives_a_restart(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / n) for n in ("src", "sink", "ckpt"))
    score = lambda d: d.withColumn("prediction", (F.col("id") % 3 == 0).cast("int"))
    run = lambda: stream_tally(score, read_stream(spark, src, schema), sink, ckpt).awaitTermination()
    part = spark.range(0, 100, numPartitions=4)
    schema = part.schema
    part.write.parquet(src)
    run()
    assert read_tally(spark, sink).collect() == [(34, 100)]
    spark.range(100, 150).write.mode("append").parquet(src)
    run()
    assert read_tally(spark, sink).collect() == [(50, 150)]
    # an epoch whose commit was lost is replayed, and counts once
    last = max((tmp_path / "ckpt" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert read_tally(spark, sink).collect() == [(50, 150)]
