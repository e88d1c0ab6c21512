from collections import Counter

from pyspark.sql import functions as F

from rareflag.operators.ordered import cut_values, rank_within, running_sums
from rareflag.operators.split import fold_bounds, stratified_folds, train_test_split


def sklearn_like_folds(labels_in_id_order, k):
    """Published StratifiedKFold (no shuffle) allocation, written out plainly."""
    import numpy as np
    y = np.asarray(labels_in_id_order)
    classes, y_enc = np.unique(y, return_inverse=True)
    y_order = np.sort(y_enc)
    alloc = np.asarray([np.bincount(y_order[i::k], minlength=len(classes)) for i in range(k)])
    folds = np.empty(len(y), dtype=int)
    for c in range(len(classes)):
        folds[y_enc == c] = np.arange(k).repeat(alloc[:, c])
    return folds.tolist()


def test_fold_bounds_match_published_allocation():
    import random
    random.seed(3)
    labels = [random.choice([0, 0, 0, 1, 2]) for _ in range(103)]
    ref = sklearn_like_folds(labels, 5)
    counts = Counter(labels)
    b = fold_bounds(counts, 5)
    ours, seen = [], Counter()
    for y in labels:
        r = seen[y]
        seen[y] += 1
        ours.append(next(i for i, hi in enumerate(b[y]) if r < hi))
    assert ours == ref


def test_split_exact_and_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "id")
    a = train_test_split(df, 0.2, seed=123)
    assert a.where("split = 'test'").count() == 200
    b = train_test_split(df.repartition(7), 0.2, seed=123)
    ta = {r.id for r in a.where("split = 'test'").collect()}
    tb = {r.id for r in b.where("split = 'test'").collect()}
    assert ta == tb


def test_folds_partition_and_balance(spark):
    df = spark.range(503).select("id", (F.col("id") % 7 == 0).cast("int").alias("label"))
    f = stratified_folds(df, k=5).groupBy("fold", "label").count().collect()
    per = {}
    for r in f:
        per.setdefault(r.label, []).append(r["count"])
    for sizes in per.values():
        assert max(sizes) - min(sizes) <= 1
    assert sum(r["count"] for r in f) == 503


def test_rank_and_running_sums_across_buckets(spark):
    import random
    random.seed(1)
    rows = [(i, random.randint(0, 3), random.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g int, v double")
    r = rank_within(df, [F.col("v").asc(), F.col("id").asc()], F.col("v"), keys=["g"], buckets=6)
    got = {x.id: x["rank"] for x in r.collect()}
    for g in range(4):
        ids = [i for i, gg, v in sorted((row for row in rows if row[1] == g), key=lambda t: (t[2], t[0]))]
        assert [got[i] for i in ids] == list(range(len(ids)))
    s = running_sums(df.withColumn("one", F.lit(1)), [F.col("v").desc(), F.col("id").asc()], -F.col("v"),
                     ["one"], buckets=5)
    by = sorted(((x.v, x.cum_one) for x in s.collect()), reverse=True)
    assert [c for _, c in by] == list(range(1, 2001))


def test_split_and_folds_move_no_rows(spark):
    # the ranking of all rows dealt them over a hash of few buckets, some tasks got several times the others' share
    df = spark.range(0, 4000, 1, 10).select("id", (F.col("id") % 9 == 0).cast("int").alias("label"))
    for out in (train_test_split(df, 0.2, seed=5), stratified_folds(df, k=3)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
        sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 10 and max(sizes) == 400


def test_cut_values_of_groups_nulls_and_repeats(spark):
    import random
    random.seed(2)
    rows = [(random.randint(0, 2), random.choice([None, *range(60), *range(1000, 1900)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g int, v long").persist()
    for limit in (50, 100_000):
        ranks = {g: [0, 17, 500, sum(r[0] == g for r in rows) - 1] for g in (0, 2)}
        got = cut_values(df, F.col("v"), ranks, F.col("g"), limit)
        for g, rs in ranks.items():
            v = sorted((r[1] for r in rows if r[0] == g), key=lambda x: (x is not None, x or 0))
            assert got[g] == {r: (v[r], v.index(v[r]), v.count(v[r])) for r in rs}


def test_split_and_folds_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(i // 50 if i < 950 else None, i, i % 2) for i in range(1000)], "id long, n long, label int")
    out = train_test_split(df, 0.33).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"test": 330, "train": 670}
    folds = stratified_folds(df, k=3)
    sizes = Counter({(r.label, r.fold): r["count"] for r in folds.groupBy("label", "fold").count().collect()})
    assert sorted(sizes.values()) == [166, 166, 167, 167, 167, 167]
    assert {r.fold for r in folds.where("id is null").select("fold").collect()} == {0}
    assert train_test_split(df.limit(0), 0.2).count() == 0


def test_passes_of_a_cut_search_do_not_grow(spark, monkeypatch):
    # a pass named the buckets of the one before by their expressions, so the driver's plans grew from pass to pass
    rows = spark.range(0, 60_000, 1, 4).select(F.col("id").alias("v"), (F.col("id") % 2).alias("g")).persist()
    sizes, collect = [], type(rows).collect

    def counted(self):
        out = collect(self)
        sizes.append((len(self._jdf.queryExecution().optimizedPlan().toString()), len(out)))
        return out

    monkeypatch.setattr(type(rows), "collect", counted)
    ranks = {g: [5_000, 9_000, 15_000, 21_000, 26_000] for g in (0, 1)}
    got = cut_values(rows, F.col("v"), ranks, F.col("g"), 60)
    assert got == {g: {r: (2 * r + g, r, 1) for r in rs} for g, rs in ranks.items()}
    plans = [n for n, _ in sizes]
    assert max(plans) < 3 * plans[2] and max(n for _, n in sizes) < 10_000  # plans[2]: the first count by bucket
    monkeypatch.undo()
    # few values, strings among them
    for values in (["b", None, "a", "a", "c"], [2.5, float("nan"), None, 2.5, -1.0]):
        df = spark.createDataFrame([(x, i) for i, x in enumerate(values)], ["v", "i"])
        top = cut_values(df, F.col("v"), {0: [0, 1, 4]})[0]
        assert top[0] == (None, 0, 1) and top[1][1:] == (1, 2 if values[2] == "a" else 1) and top[4][1:] == (4, 1)
