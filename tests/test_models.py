import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from rareflag.operators.models.adaboost import adaboost_stages
from rareflag.operators.models.forest import forest_stages, tree_stages


def leaf_rates(spark):
    # 100 rows at rate 0.6 (x=0) and 100 rows at rate 0.9 (x=1)
    rows = [(i, 0.0, 1 if i < 60 else 0) for i in range(100)] + [(100 + i, 1.0, 1 if i < 90 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, label int")
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(df)


def test_tree_keeps_both_leaf_rates(spark):
    df = leaf_rates(spark)
    m = Pipeline(stages=tree_stages("gini", maxDepth=2)).fit(df)
    p = sorted({round(r.p1, 6) for r in m.transform(df).collect()})
    assert p == [0.6, 0.9]


def test_forest_probability_is_mean_of_trees(spark):
    df = leaf_rates(spark)
    m = Pipeline(stages=forest_stages(numTrees=5, maxDepth=2, bootstrap=False, featureSubsetStrategy="all")).fit(df)
    p = sorted({round(r.p1, 6) for r in m.transform(df).collect()})
    assert p == [0.6, 0.9]


def test_adaboost_learns_a_threshold(spark, tmp_path):
    rows = [(i, float(i), 1 if i >= 70 else 0) for i in range(100)]
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame(rows, "id long, x double, label int"))
    m = Pipeline(stages=adaboost_stages(n_estimators=5)).fit(df)
    out = m.transform(df)
    assert out.where(F.col("prediction") != F.col("label")).count() == 0
    m.write().overwrite().save(str(tmp_path / "ada"))
    m2 = PipelineModel.load(str(tmp_path / "ada"))
    a = sorted((r.id, r.p1) for r in m.transform(df).collect())
    b = sorted((r.id, r.p1) for r in m2.transform(df).collect())
    assert a == b


def boosted(x, y, rounds):
    """Stumps over all midpoints, weights of all rounds, by the definition."""
    import math

    import numpy as np
    w, out = np.ones(len(y)) / len(y), []
    for _ in range(rounds):
        best = None
        for f in range(x.shape[1]):
            v = np.unique(x[:, f])
            for t in (v[:-1] + v[1:]) / 2:
                pure, err, labels = 0.0, 0.0, []
                for side in (x[:, f] <= t, x[:, f] > t):
                    c = np.array([w[side & (y == 0)].sum(), w[side & (y == 1)].sum()])
                    pure += (c ** 2).sum() / c.sum()
                    labels.append(int(c[1] > c[0]))
                    err += c.min()
                if best is None or pure > best[0] + 1e-9:
                    best = (pure, f, t, labels, err / w.sum())
        _, f, t, labels, err = best
        a = math.log((1 - err) / err)
        miss = np.where(x[:, f] <= t, *labels) != y
        w = w * np.exp(a * miss)
        w /= w.sum()
        out.append((f, t, *labels, a))
    return out


def test_adaboost_rounds_match_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, 0] + x[:, 1] > 11) ^ (rng.random(300) < 0.1)).astype(int)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, c double, label int"))
    m = Pipeline(stages=adaboost_stages(n_estimators=23)).fit(df).stages[0]  # writes its weights twice
    want = boosted(x, y, 23)
    assert [(f, t, int(a), int(b)) for f, t, a, b in m.stump_list()] == [w[:4] for w in want]
    alphas = [w[4] for w in want]
    assert m.getOrDefault("alphas") == pytest.approx(alphas, rel=1e-6)
    d = sum(a * (2 * np.where(x[:, f] <= t, lo, hi) - 1) for f, t, lo, hi, a in want) / sum(alphas)
    got = sorted((r.a, r.b, r.c, r.label, r.score) for r in m.transform(df).collect())
    assert [g[4] for g in got] == pytest.approx([v[4] for v in sorted(zip(*x.T, y, d))], abs=1e-6)


def test_adaboost_odd_tables(spark):
    def fit(rows):
        df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "x double, label int"))
        return Pipeline(stages=adaboost_stages(n_estimators=4)).fit(df).stages[0], df
    with pytest.raises(ValueError, match="no row"):
        fit([])
    m, df = fit([(1.0, 1), (1.0, 1), (1.0, 0)])  # a constant feature: the majority, then no better than chance
    assert {r.prediction for r in m.transform(df).collect()} == {1.0}
    m, df = fit([(1.0, 1), (2.0, 1)])  # one class
    assert {r.prediction for r in m.transform(df).collect()} == {1.0}


def test_min_samples_split_prunes(spark):
    from pyspark.ml.regression import DecisionTreeRegressor
    from rareflag.operators.models.prune import prune_min_samples_split
    df = leaf_rates(spark).withColumn("x2", F.col("id") % 13 * 1.0)
    df = VectorAssembler(inputCols=["x", "x2"], outputCol="f2").transform(df)
    m = DecisionTreeRegressor(featuresCol="f2", maxDepth=5).fit(df)
    assert prune_min_samples_split(m, 2) is m
    p = prune_min_samples_split(m, 150)
    assert p.numNodes < m.numNodes
    # nodes with >= 150 rows: only the root (200) may split; its children hold 100 each
    assert p.numNodes == 3
    assert sorted({round(r.prediction, 6) for r in p.transform(df).collect()}) == [0.6, 0.9]


def grown(x, y, depth, seed, min_leaf=1):
    """Leaves of a random-split tree by the definition: {heap number: (feature, threshold, n, p)}."""
    import hashlib

    import numpy as np
    out = {}

    def gini(v):
        return len(v) * 2 * v.mean() * (1 - v.mean()) if len(v) else 0.0

    def visit(node, rows, level):
        v = y[rows]
        best = None
        if level < depth and 0 < v.sum() < len(v):
            for f in range(x.shape[1]):
                lo, hi = x[rows, f].min(), x[rows, f].max()
                if lo == hi:
                    continue
                u = int(hashlib.md5(f"{seed}:{node}:{f}".encode()).hexdigest()[:8], 16) / 2 ** 32
                t = lo + u * (hi - lo)
                left = x[rows, f] <= t
                if min(left.sum(), (~left).sum()) < min_leaf:
                    continue
                gain = round((gini(v) - gini(v[left]) - gini(v[~left])) / len(v), 12)
                if best is None or gain > best[0]:
                    best = (gain, f, t, left)
        out[node] = (best[1:3] if best else (-1, 0.0)) + (len(v), v.mean())
        if best:
            visit(2 * node, rows[best[3]], level + 1)
            visit(2 * node + 1, rows[~best[3]], level + 1)

    visit(1, np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize("seed,min_leaf", [(42, 1), (7, 5)])
def test_random_splitter_matches_brute_force(spark, tmp_path, seed, min_leaf):
    import numpy as np
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.random(400), rng.integers(0, 5, 400), np.ones(400)])
    y = ((x[:, 0] > 0.6) ^ (rng.random(400) < 0.2)).astype(int)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, c double, label int")
        .repartition(3))
    m = Pipeline(stages=tree_stages(splitter="random", maxDepth=4, seed=seed, minInstancesPerNode=min_leaf)).fit(df)
    t = m.stages[0]
    want = grown(x, y, 4, seed, min_leaf)
    get = t.getOrDefault
    assert get("feature") == [want[n][0] for n in sorted(want)]
    assert get("threshold") == pytest.approx([want[n][1] for n in sorted(want)])
    assert get("rows") == [want[n][2] for n in sorted(want)]
    assert get("value") == pytest.approx([want[n][3] for n in sorted(want)])
    out = m.transform(df)
    leaves = out.groupBy("leaf").agg(F.count("*").alias("n"), F.avg("label").alias("p"), F.max("p1").alias("p1")).collect()
    assert all(r.n == get("rows")[r.leaf] and r.p == pytest.approx(r.p1) for r in leaves) and len(leaves) > 4
    m.write().overwrite().save(str(tmp_path / "t"))
    assert PipelineModel.load(str(tmp_path / "t")).transform(df).exceptAll(out).count() == 0


def test_random_splitter_odd_tables(spark):
    def fit(rows, **kw):
        df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "x double, label int"))
        return Pipeline(stages=tree_stages(splitter="random", **kw)).fit(df).transform(df).select("p1").collect()
    with pytest.raises(ValueError, match="no row"):
        fit([])
    assert {r.p1 for r in fit([(1.0, 1), (1.0, 0)])} == {0.5}  # constant feature: no split
    assert {r.p1 for r in fit([(1.0, 1), (2.0, 0)], criterion="entropy")} == {0.0, 1.0}
    with pytest.raises(ValueError, match="splitter"):
        tree_stages(splitter="worst")


@pytest.mark.parametrize("kind", ["rbf", "poly", "sigmoid"])
def test_kernel_map_matches_brute_force(spark, kind):
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from rareflag.operators.models.ksvm import Nystroem, kernel
    x = np.random.default_rng(3).normal(size=(60, 4))
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(
        spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double"))
    m = Nystroem(kernel=kind, landmarks=60, degree=2, coef0=0.5).fit(df.repartition(3))
    out = m.transform(df).select("id", vector_to_array("kfeatures").alias("z")).orderBy("id").collect()
    z = np.array([r.z for r in out])
    k = kernel(x, x, kind, m.getOrDefault("gammaValue"), 2, 0.5)
    if kind == "sigmoid":  # the part of the kernel with eigenvalues above 0
        w, u = np.linalg.eigh(k)
        w = np.where(w > 0, w, 0)
        assert np.abs(z @ z.T - (u * w) @ u.T).max() < 1e-5
        with pytest.raises(ValueError, match="residual"):
            m.residual(df)
        return
    assert np.abs(z @ z.T - k).max() < 1e-5  # all rows are landmarks: the kernel itself
    assert max(abs(r.residual) for r in m.residual(df).collect()) < 1e-5
    few = Nystroem(kernel=kind, landmarks=4, degree=2, coef0=0.5).fit(df).residual(df).collect()
    assert min(r.residual for r in few) > -1e-9 and max(r.residual for r in few) > 0.01


def test_adaboost_keeps_blocks_and_no_weights(spark, monkeypatch):
    # a weight column was kept beside the rows and written every ten rounds; a round read them row by row
    import numpy as np
    from pyspark.sql import DataFrame

    from rareflag.operators.models import adaboost, bins
    monkeypatch.setattr(DataFrame, "checkpoint", lambda *a, **k: pytest.fail("a round wrote its weights"))
    monkeypatch.setattr(bins, "SLICE", 7)
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 300, (900, 2)).astype(float), rng.integers(0, 2, 900)
    df = spark.createDataFrame([([float(a) for a in r], int(v)) for r, v in zip(x, y)], "x array<double>, y int").repartition(3)
    cuts = [np.arange(299) + 0.5] * 2
    packed = bins.blocks(df, "x", "y", cuts)
    assert packed.agg(F.sum("n")).first()[0] == 900 and packed.count() <= 3
    tables = {}
    for stump, alpha in (((0, 100, 1, 0), 0.7), ((1, 40, 0, 1), 0.3), ((-1, 0, 1, 1), 0.2)):
        adaboost.add_stump(tables, stump, alpha, 300)
    w = np.exp(0.7 * ((x[:, 0] <= 100) != y) + 0.3 * ((x[:, 1] > 40) != y) + 0.2 * (y != 1) - 0.1)
    want = np.zeros((2, 300, 2))
    for f in range(2):
        np.add.at(want, (f, x[:, f].astype(int), y), w)
    np.testing.assert_allclose(bins.weighted_histogram(packed, tables, 2, 300, -0.1), want, rtol=1e-12)
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, label int"))
    assert len(Pipeline(stages=adaboost_stages(n_estimators=12)).fit(rows).stages[0].stump_list()) == 12


def test_random_tree_places_rows_of_a_batch_at_once():
    import numpy as np

    from rareflag.operators.models.random_tree import _Growing
    tree = _Growing()
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(200, 3))
    assert (tree.placer(np.array([1]))(x) == 0).all()
    tree.split = {1: (0, 0.5), 3: (1, 0.4), 6: (2, 0.6)}  # 2, 7, 12 and 13 are leaves, 7 is closed
    open_ids, want = np.array([2, 12, 13]), []
    for r in x:
        n = 1
        while n in tree.split:
            f, t = tree.split[n]
            n = 2 * n + (not r[f] <= t)
        want.append({2: 0, 12: 1, 13: 2}.get(n, -1))
    assert tree.placer(open_ids)(x).tolist() == want


@pytest.mark.parametrize("kind", ["rbf", "poly", "sigmoid"])
def test_kernel_machine_is_linear_svc_on_the_map_without_mapped_rows(spark, tmp_path, monkeypatch, kind):
    # the m mapped values of every row were cached, where the d inputs are enough
    import numpy as np
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import vector_to_array

    from rareflag.operators.models import ksvm
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = (np.abs(x[:, 0]) + 0.3 * rng.normal(size=400) > 0.8).astype(float)
    df = VectorAssembler(inputCols=list("abc"), outputCol="features").transform(spark.createDataFrame(
        [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
        "id long, a double, b double, c double, label double")).repartition(3, "id").persist()
    for steps in (3, 25):
        z = ksvm.Nystroem(kernel=kind, landmarks=30, degree=2, coef0=0.5).fit(df).transform(df)
        svc = LinearSVC(featuresCol="kfeatures", regParam=1 / 4000, maxIter=steps, standardization=False).fit(z)
        want = {r.id: r.s for r in svc.transform(z).select("id", vector_to_array("rawPrediction")[1].alias("s")).collect()}
        with monkeypatch.context() as m:
            m.setattr(ksvm.NystroemModel, "_transform", lambda *a: pytest.fail("mapped rows were made"))
            m.setattr(ksvm, "SLICE", 50)
            model = Pipeline(stages=ksvm.ksvm_stages(C=10.0, kernel=kind, degree=2, coef0=0.5, n_train=400, landmarks=30,
                                                     max_iter=steps)).fit(df)
        model.write().overwrite().save(str(tmp_path / "m"))
        got = PipelineModel.load(str(tmp_path / "m")).transform(df).select("id", "score", "prediction", "p0", "p1").collect()
        assert max(abs(r.score - want[r.id]) for r in got) < 1e-6
        assert all(r.prediction == (r.score > 0) and r.p0 is None and r.p1 is None for r in got)
    with pytest.raises(Exception, match="labels of 0 or 1"):
        Pipeline(stages=ksvm.ksvm_stages(landmarks=5)).fit(df.withColumn("label", F.lit(None).cast("double")))


def few_values(spark, n=1500):
    """Features of few values (one of them constant, one a copy), so that all cut points are the midpoints."""
    import numpy as np
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, m, n) for m in (40, 7, 2, 1, 25, 90, 3, 11)]).astype(float)
    x[:, 6] = x[:, 1]
    y = ((x[:, 0] + 3 * x[:, 1] > 40) ^ (rng.random(n) < 0.1)).astype(float)
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], [*names, "label"]).repartition(3)
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


def node_table(spark, model, path):
    model.write().save(path)
    d = spark.read.parquet(f"{path}/data")
    d = d.select("treeID", "nodeData.*") if "treeID" in d.columns else d.select(F.lit(0).alias("treeID"), "*")
    return {(r.treeID, r.id): (round(r.prediction, 12), r.rawCount, r.impurityStats, r.gain, r.leftChild, r.rightChild, r.split)
            for r in d.collect()}


def test_block_grown_models_are_those_of_mllib(spark, tmp_path, monkeypatch):
    from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor

    from rareflag.operators.models import binned_forest as B
    monkeypatch.setattr(B, "SAMPLED", 0)
    df = few_values(spark).persist()
    common = dict(bootstrap=False, maxBins=256)
    for i, est in enumerate((
            RandomForestRegressor(numTrees=40, maxDepth=6, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=42, **common),
            # (a pass takes some of the nodes only)
            RandomForestRegressor(numTrees=60, maxDepth=6, featureSubsetStrategy="onethird", seed=-7, maxMemoryInMB=1, **common),
            RandomForestRegressor(numTrees=2, maxDepth=3, featureSubsetStrategy="all", seed=1, **common),
            DecisionTreeRegressor(maxDepth=5, minInstancesPerNode=9, maxBins=256))):
        want, got = est.fit(df), B.BlockGrown(estimator=est).fit(df)
        assert type(got) is type(want) and got.numFeatures == want.numFeatures
        assert node_table(spark, got, str(tmp_path / f"got{i}")) == node_table(spark, want, str(tmp_path / f"want{i}"))
        assert got.featureImportances.toArray().tolist() == want.featureImportances.toArray().tolist()
        a, b = (sorted((r.features.toArray().tolist(), r.prediction) for r in m.transform(df).collect()) for m in (want, got))
        assert [v for _, v in a] == pytest.approx([v for _, v in b], abs=1e-12)


def test_forest_keeps_a_byte_a_feature_and_every_row(spark, monkeypatch):
    from rareflag.operators.models import binned_forest as B
    monkeypatch.setattr(B, "SAMPLED", 0)
    held, blocks = [], B.blocks
    monkeypatch.setattr(B, "blocks", lambda *a: held.append(blocks(*a)) or held[-1])
    df = few_values(spark)
    m = Pipeline(stages=forest_stages(numTrees=2, maxDepth=2, bootstrap=False, minSamplesSplit=10)).fit(df)
    n, bins, labels = held[0].agg(F.sum("n"), F.sum(F.length("b")), F.sum(F.length("y"))).first()
    assert (n, bins, labels) == (1500, 8 * 1500, 1500)
    assert [t._call_java("rootNode").impurityStats().rawCount() for t in m.stages[0].trees] == [1500, 1500]


def test_cut_points_of_shared_values_keep_rare_ones(spark):
    from rareflag.operators.models.binned_forest import shared_cut_points
    rows = spark.range(0, 40000, 1, 4).select(F.array(
        F.col("id") * 1.0, (F.col("id") == 17).cast("double"), F.lit(3.0),
        # one value in two of three rows, so few quantiles
        F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.col("id") * 1.0)).alias("x"))
    a, b, c, d = shared_cut_points(rows, 4, 255)
    assert len(a) == 255 and abs(a[128] - 20000) < 400
    assert b.tolist() == [0.5] and len(c) == 0
    assert len(d) > 50 and d[0] <= 3


def test_forest_leaves_other_labels_and_weights_to_mllib(spark, monkeypatch):
    from rareflag.operators.models import binned_forest as B
    monkeypatch.setattr(B, "SAMPLED", 0)
    monkeypatch.setattr(B, "grow", None)
    df = few_values(spark, 60)
    for stages, rows in ((forest_stages(numTrees=2, bootstrap=True), df),
                         (forest_stages(numTrees=2, bootstrap=False, weightCol="x0"), df.where("x0 > 0")),
                         (tree_stages("gini"), df.withColumn("label", F.col("label") * 2))):
        assert Pipeline(stages=stages).fit(rows).transform(rows).count() == rows.count()


def test_passes_of_boosting_and_kernel_machine_plan_no_query(spark, monkeypatch):
    # each round and each step of the descent planned a query of its own, with as many tasks as the table has partitions
    import numpy as np

    from rareflag.operators.models import adaboost, bins, ksvm
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] * x[:, 1] + 0.2 * rng.normal(size=400) > 0).astype(float)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(
        [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, label double")
    ).repartition(40, "id").persist()
    planned, tasks, plan, held = [], [], type(df).mapInArrow, bins.held
    monkeypatch.setattr(type(df), "mapInArrow", lambda *a, **k: planned.append(1) or plan(*a, **k))

    def counted(*a):
        out = held(*a)
        tasks.append(out.getNumPartitions())
        assert sum(len(r[-1]) for r in out.collect()) in (400, 8 * 2 * 400)  # labels or inputs of every row
        return out

    for module in (adaboost, ksvm):
        monkeypatch.setattr(module, "held", counted)
    ada = Pipeline(stages=adaboost_stages(n_estimators=9)).fit(df).stages[0]
    assert len(ada.stump_list()) == 9 and len(planned) == 1
    Pipeline(stages=ksvm.ksvm_stages(C=10.0, landmarks=20, n_train=400, max_iter=9)).fit(df)
    assert len(planned) == 2
    assert all(n <= max(spark.sparkContext.defaultParallelism, 1) for n in tasks)
    # more tasks than the driver takes arrays from at once
    cuts = [np.sort(c) for c in rng.normal(size=(2, 20))]
    rows = spark.createDataFrame([([float(a) for a in r], int(t)) for r, t in zip(x, y)], "x array<double>, y int").repartition(5)
    want = bins.weighted_histogram(bins.blocks(rows, "x", "y", cuts), {}, 2, 21, 0.0)
    monkeypatch.setattr(bins, "FAN_IN", 2)
    np.testing.assert_allclose(bins.weighted_histogram(bins.blocks(rows, "x", "y", cuts), {}, 2, 21, 0.0), want)
    assert want.sum() == 2 * 400
