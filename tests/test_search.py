import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from rareflag.operators.models.growth import Member, as_prediction, score_members
from rareflag.plans import search as S


@pytest.fixture(scope="module")
def rows(spark):
    h = F.xxhash64("id")
    df = spark.range(240).withColumns({
        "a": (F.pmod(h, F.lit(97)) / 97.0), "b": (F.pmod(F.shiftright(h, 9), F.lit(89)) / 89.0),
        "c": (F.pmod(F.shiftright(h, 17), F.lit(83)) / 83.0)})
    return df.withColumn("label", ((F.col("a") + 0.5 * F.col("b") > 0.8) & (F.col("c") > 0.3)).cast("int")).persist()


def pre():
    return [VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")]


def test_trees_inside_a_growth_equal_their_own_training(spark, rows):
    x = pre()[0].transform(rows)
    grown = Pipeline(stages=S.family_stages("dt", {"max_depth": 6}, 240)).fit(x)
    members = [Member(1, d, m) for d in (1, 3, 6) for m in (2, 40)]
    scored = score_members(grown.stages[0], x.select("id", "label", "features"), members)
    for i, m in enumerate(members):
        own = Pipeline(stages=S.family_stages("dt", {"max_depth": m.depth, "min_samples_split": m.split}, 240)).fit(x)
        want = {r.id: round(r.p1, 9) for r in own.transform(x).collect()}
        assert {r.id: round(r.p1, 9) for r in as_prediction(scored, i).collect()} == want


def test_forest_prefix_is_the_mean_of_its_first_trees(spark, rows):
    x = pre()[0].transform(rows)
    forest = Pipeline(stages=S.family_stages("rfc", {"n_estimators": 6, "max_depth": 4}, 240)).fit(x)
    model = next(s for s in forest.stages if hasattr(s, "featureImportances"))
    got = score_members(model, x.select("id", "features"), [Member(2, 4, 2), Member(6, 4, 2)]).collect()
    trees = {r.id: [] for r in got}
    for tree in model.trees:
        for r in tree.transform(x).collect():
            trees[r.id].append(r.prediction if "prediction" in r else r.score)
    for r in got:
        assert r.member_p1[0] == pytest.approx(sum(trees[r.id][:2]) / 2)
        assert r.member_p1[1] == pytest.approx(sum(trees[r.id]) / 6)


def test_search_shares_trainings_and_scores_like_single_ones(spark, rows):
    grid = {"dt": {"max_depth": [1, 3], "min_samples_split": [2, 30]}, "ada": {"n_estimators": [1, 3]},
            "knn": {"n_neighbors": [1, 3], "weights": ["uniform", "distance"], "algorithm": ["brute", "kd_tree"]}}
    res = S.search(rows, grid, pre, cv=2, refit=False)
    assert res.trainings == {"dt": 2, "ada": 2, "knn": 2} and not res.errors
    got = {(r.family, r.params, r.fold): r.score for r in res.cv_results.collect()}
    assert len(got) == 2 * (4 + 2 + 8)
    for (fam, params, fold), value in list(got.items())[::5]:
        import json
        one = S.search(rows, {fam: {k: [v] for k, v in json.loads(params).items()}}, pre, cv=2, refit=False)
        assert {r.fold: r.score for r in one.cv_results.collect()}[fold] == pytest.approx(value)


def test_failed_candidates_score_nan_and_come_last(spark, rows):
    grid = {"lr": {"C": [1.0], "penalty": ["l2", "no such"]}, "dt": {"max_depth": [2], "splitter": ["best", "no such"]}}
    res = S.search(rows, grid, pre, cv=2)
    bad = {(r.family, r.params): r.score for r in res.cv_results.collect() if math.isnan(r.score)}
    assert {f for f, _ in bad} == {"lr", "dt"} and len(bad) == 2 and len(res.errors) == 4
    ranks = {(r.family, r.rank_in_family): r.mean_score for r in S.summarize(res.cv_results).collect()}
    assert math.isnan(ranks["lr", 2]) and not math.isnan(ranks["lr", 1])
    assert set(res.models) == {"lr", "dt"}


def test_class_weights_hold_in_the_refit_and_the_stored_model(spark, rows, tmp_path):
    res = S.search(rows, {"rfc": {"n_estimators": [3], "max_depth": [3], "class_weight": ["balanced"]}}, pre, cv=2)
    assert not res.errors
    res.models["rfc"].write().save(str(tmp_path / "m"))
    out = PipelineModel.load(str(tmp_path / "m")).transform(rows.drop("label"))
    assert out.count() == 240


def test_scoring_may_be_a_function(spark, rows):
    res = S.search(rows, {"dt": {"max_depth": [2]}}, pre, cv=2, scoring=lambda df: df.count() / 1000, refit=False)
    assert sum(r.score for r in res.cv_results.collect()) == pytest.approx(0.24)


def test_unknown_names_raise_at_once(spark, rows):
    for fam, grid in (("xyz", {}), ("dt", {"no_such": [1]})):
        with pytest.raises((KeyError, ValueError)):
            S.search(rows, {fam: grid}, pre)
    with pytest.raises(KeyError):
        S.search(rows, {"dt": {"max_depth": [1]}}, pre, scoring="no such")


def test_resampling_works_on_training_rows_only(spark, rows):
    seen = []

    def resample(df):
        out = S.smote_training(df)
        seen.append((df.count(), out.count()))
        return out

    res = S.search(rows, {"dt": {"max_depth": [3]}}, pre, cv=2, resample=resample)
    assert len(seen) == 3 and all(b > a for a, b in seen) and not res.errors
    assert res.models["dt"].transform(rows).count() == 240


def test_stored_neighbour_model_can_be_moved(spark, rows, tmp_path):
    model = Pipeline(stages=pre() + S.family_stages("knn", {"n_neighbors": 3}, 240)).fit(rows)
    want = {r.id: r.p1 for r in model.transform(rows).collect()}
    model.write().save(str(tmp_path / "a"))
    model.stages[-1]._set(trainPath="/no/such/folder")
    (tmp_path / "a").rename(tmp_path / "b")
    assert {r.id: r.p1 for r in PipelineModel.load(str(tmp_path / "b")).transform(rows).collect()} == want


def test_members_of_a_growth_share_one_descent(monkeypatch):
    import numpy as np

    from rareflag.operators.models import growth as G
    tree = G.Tree(np.array([0, 1, -1, -1, 0, -1, -1]), np.array([0.5, 0.5, 0, 0, 0.8, 0, 0]), np.array([1, 2, 0, 0, 5, 0, 0]),
                  np.array([4, 3, 0, 0, 6, 0, 0]), np.arange(7) / 10, np.array([20, 12, 6, 6, 8, 4, 4]), {})
    x = np.array([[0.1, 0.1], [0.1, 0.9], [0.7, 0.0], [0.9, 0.0]])
    calls, leaf_of = [], G.leaf_of
    monkeypatch.setattr(G, "leaf_of", lambda *a: calls.append(1) or leaf_of(*a))
    members = [Member(1, 2, 2), Member(1, 1, 2), Member(1, 2, 10), Member(1, 0, 2)]
    got = G.member_probabilities([tree], x, members)
    assert len(calls) == 1
    assert got.T.tolist() == [[0.2, 0.3, 0.5, 0.6], [0.1, 0.1, 0.4, 0.4], [0.2, 0.3, 0.4, 0.4], [0, 0, 0, 0]]


def test_search_keeps_only_what_the_families_read(spark, rows, monkeypatch):
    seen, fold_scores = [], S._fold_scores
    monkeypatch.setattr(S, "_fold_scores", lambda fam, group, tr, va, *a: seen.append((tr.columns, va.columns))
                        or fold_scores(fam, group, tr, va, *a))
    S.search(rows.withColumn("other", F.lit("x")), {"dt": {"max_depth": [2]}}, pre, cv=2, refit=False)
    assert seen == [(["id", "label", "features"],) * 2] * 2


def test_elimination_takes_the_fill_values_of_each_part_once(spark, monkeypatch):
    from rareflag.operators import clean
    from rareflag.plans.pipeline import preprocessing_stages
    df = spark.createDataFrame([(i, float(i % 3 == 0), float(i % 3) if i % 7 else None, float(i % 5), float(i % 2)) for i in range(120)],
                               "id long, label double, a double, b double, c double")
    calls, statistics = [], clean.compute_statistics
    monkeypatch.setattr(clean, "compute_statistics", lambda *a: calls.append(1) or statistics(*a))
    out = S.recursive_elimination(df, ["a", "b", "c"], lambda v: preprocessing_stages(
        v, flag_cols=[], binary_cols=[], pass_cols=["id", "label"]), {"n_estimators": 3, "max_depth": 3, "bootstrap": False}, cv=2)
    assert [r["n_features"] for r in out.collect()] == [3, 2, 1] and len(calls) == 5


def test_best_candidate_searches_every_family(monkeypatch):
    from types import SimpleNamespace

    from rareflag.plans import model_queries as Q
    asked = []

    def search(spark, sf_dir, grid=None, cv=3):
        asked.extend(grid or Q.SEARCH_GRID)
        return None, SimpleNamespace(best={f: ({"a": 1}, 0.5, 0) for f in asked}, winner=("rfc", {"a": 1}, 0.5))

    monkeypatch.setattr(Q, "_search", search)
    rows = []
    Q.q_best_candidate(SimpleNamespace(createDataFrame=lambda r, schema: rows.extend(r)), "")
    assert asked == S.FAMILY_ORDER and [(r[0], r[3]) for r in rows if r[3]] == [("rfc", True)] and len(rows) == 6
