"""Named queries for neighbours, resampling and learned models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareflag.functions.columns import r6
from rareflag.operators.neighbors import knn_join, knn_vote
from rareflag.operators.split import train_test_split
from rareflag.sources.tables import read_table

KNN_K = 5
SAMPLE_SEED = 42


def embeddings(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])


def _knn_self(spark, sf_dir, p):
    e = embeddings(spark, sf_dir)
    nn = knn_join(e, e, KNN_K, p, q_id="vec_id", t_id="vec_id", q_vec="embedding", t_vec="embedding",
                  exclude_self=True)
    return nn.select(F.col("qid").alias("vec_id"), F.col("tid").alias("neighbor_id"),
                     F.col("rank").cast("bigint").alias("rank"), r6("distance").alias("distance"))


def q_knn_join_l2(spark, sf_dir):
    """Every vector's 5 nearest other vectors, Euclidean."""
    return _knn_self(spark, sf_dir, 2.0)


def q_knn_join_l1(spark, sf_dir):
    """Every vector's 5 nearest other vectors, Manhattan."""
    return _knn_self(spark, sf_dir, 1.0)


def _knn_classify(spark, sf_dir, weights):
    e = train_test_split(embeddings(spark, sf_dir), id_col="vec_id")
    test, train = e.where(F.col("split") == "test"), e.where(F.col("split") == "train")
    nn = knn_join(test, train, KNN_K, 2.0, q_id="vec_id", t_id="vec_id", q_vec="embedding",
                  t_vec="embedding", t_cols=["label"])
    v = knn_vote(nn, "label", weights)
    return (v.join(test.select(F.col("vec_id").alias("qid"), F.col("label")), "qid")
            .select(F.col("qid").alias("vec_id"), "label", F.col("prediction").cast("int").alias("prediction"),
                    r6("vote_share").alias("vote_share")))


def q_knn_vote_uniform(spark, sf_dir):
    """kNN classifier, majority vote: test split scored against train split."""
    return _knn_classify(spark, sf_dir, "uniform")


def q_knn_vote_distance(spark, sf_dir):
    """kNN classifier, inverse-distance vote."""
    return _knn_classify(spark, sf_dir, "distance")


def q_sample_neighbors(spark, sf_dir):
    """Neighbours of one row drawn by a seeded hash."""
    e = embeddings(spark, sf_dir)
    key = F.md5(F.concat(F.lit(f"{SAMPLE_SEED}:"), F.col("vec_id").cast("string")))
    one = e.orderBy(key, "vec_id").limit(1)
    nn = knn_join(one, e, KNN_K, 2.0, q_id="vec_id", t_id="vec_id", q_vec="embedding", t_vec="embedding",
                  exclude_self=True, t_cols=["label"])
    return nn.select(F.col("qid").alias("vec_id"), F.col("tid").alias("neighbor_id"),
                     F.col("rank").cast("bigint").alias("rank"), r6("distance").alias("distance"), "label")


def q_smote_rows(spark, sf_dir, strategy="minority"):
    """SMOTE synthetic rows, the smallest class up to the majority count."""
    from rareflag.operators.balance import smote
    s = smote(embeddings(spark, sf_dir), "label", "embedding", id_col="vec_id", k=KNN_K, seed=SAMPLE_SEED,
              strategy=strategy)
    return s.select("label", "synth_i", "base_id", "neighbor_id", r6("u").alias("u"),
                    r6(F.element_at("embedding", 1)).alias("x0"),
                    r6(F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b)).alias("xsum"),
                    # depends on the place of every coordinate
                    r6(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b))
                    .alias("xplaces"))


def q_smote_rows_all_classes(spark, sf_dir):
    """SMOTE synthetic rows, every class up to the majority count."""
    return q_smote_rows(spark, sf_dir, "not majority")


def q_smote_union_counts(spark, sf_dir):
    """Class counts after the union of original and synthetic rows."""
    from rareflag.operators.balance import smote_union
    u = smote_union(embeddings(spark, sf_dir), "label", "embedding", id_col="vec_id", k=KNN_K, seed=SAMPLE_SEED)
    return u.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- learned models on obs

def _scored(spark, sf_dir, stages_fn, mode="batch", label=None):
    from rareflag.plans.score import fit, prepared_obs, score_parts
    from rareflag.sources import obs as O
    data = prepared_obs(spark, sf_dir, label or O.LABEL)
    train = data.where(F.col("split") == "train")
    model = fit(train, stages_fn(train), mode)
    return score_parts(model, data, mode), model


def _out(df):
    return df.select("id", "split", F.col("label").cast("int").alias("label"),
                     F.col("prediction").cast("int").alias("prediction"), r6("p1").alias("p1"),
                     r6("score").alias("score"))


FOREST = dict(numTrees=100, maxDepth=8, minInstancesPerNode=2, bootstrap=False, seed=42, minSamplesSplit=10)


def q_forest_score(spark, sf_dir):
    """Flagship: clean → z-score → L2 → random forest (100 trees, depth 8,
    no bootstrap, leaf 2, split 10), train and test scored with batch medians
    (M2, M13)."""
    from rareflag.operators.models.forest import forest_stages
    out, _ = _scored(spark, sf_dir, lambda tr: forest_stages(**FOREST))
    return _out(out)


def q_forest_evaluation(spark, sf_dir):
    """Confusion counts, MAE, RMSE, F1 of the forest on train and test."""
    from rareflag.operators.metrics import error_metrics
    from rareflag.operators.models.forest import forest_stages
    out, _ = _scored(spark, sf_dir, lambda tr: forest_stages(**FOREST))
    m = error_metrics(out, "label", "prediction", by=["split"])
    return m.select("split", "n", "tn", "fp", "fn", "tp", r6("mae").alias("mae"), r6("rmse").alias("rmse"),
                    r6("f1").alias("f1"))


def q_tree_score(spark, sf_dir):
    """Decision tree, gini as a variance tree on the 0/1 label (M3)."""
    from rareflag.operators.models.forest import tree_stages
    out, _ = _scored(spark, sf_dir, lambda tr: tree_stages("gini", maxDepth=6, minInstancesPerNode=2))
    return _out(out)


def q_tree_entropy_score(spark, sf_dir):
    """Decision tree, entropy criterion (M3)."""
    from rareflag.operators.models.forest import tree_stages
    out, _ = _scored(spark, sf_dir, lambda tr: tree_stages("entropy", maxDepth=6, minInstancesPerNode=2))
    return _out(out)


def q_logistic_score(spark, sf_dir):
    """Logistic regression, l2, C=1 (M4)."""
    from rareflag.operators.models.logistic import logistic_stages
    out, _ = _scored(spark, sf_dir, lambda tr: logistic_stages(C=1.0, penalty="l2", n_train=tr.count()))
    return _out(out)


def q_adaboost_score(spark, sf_dir):
    """AdaBoost SAMME over stumps, 200 rounds, lr 1 (M6)."""
    from rareflag.operators.models.adaboost import adaboost_stages
    out, _ = _scored(spark, sf_dir, lambda tr: adaboost_stages(n_estimators=200, learning_rate=1.0))
    return _out(out)


def q_ksvm_score(spark, sf_dir):
    """Kernel SVM, rbf, C=10, Nyström with 100 landmarks (M7)."""
    from rareflag.operators.models.ksvm import ksvm_stages
    out, _ = _scored(spark, sf_dir, lambda tr: ksvm_stages(C=10.0, kernel="rbf", n_train=tr.count()))
    return _out(out)


def q_ksvm_poly_score(spark, sf_dir):
    """Kernel SVM, poly of degree 3, C=10, 300 landmarks (M7)."""
    from rareflag.operators.models.ksvm import ksvm_stages
    out, _ = _scored(spark, sf_dir, lambda tr: ksvm_stages(C=10.0, kernel="poly", degree=3, landmarks=300, n_train=tr.count()))
    return _out(out)


def q_ksvm_sigmoid_score(spark, sf_dir):
    """Kernel SVM, sigmoid, C=10, 300 landmarks (M7)."""
    from rareflag.operators.models.ksvm import ksvm_stages
    out, _ = _scored(spark, sf_dir, lambda tr: ksvm_stages(C=10.0, kernel="sigmoid", landmarks=300, n_train=tr.count()))
    return _out(out)


#: bound of the mean kernel residual with 300 landmarks (measured: rbf 0.079, poly 0.009)
KERNEL_BOUNDS = {"rbf": 0.1, "poly": 0.02}


def q_kernel_map_error(spark, sf_dir):
    """Kernel map of all rows: whether it ever overstates k(x, x), and whether the mean of what it lacks is below the
    stated bound (M7); SQL has the rows."""
    from rareflag.operators.models.ksvm import Nystroem
    from rareflag.plans.score import fit, prepared_obs
    from rareflag.sources import obs as O
    data = prepared_obs(spark, sf_dir, O.LABEL)
    x = fit(data, [], "batch").transform(data).select(O.ID, "features").persist()
    out = None
    for kind, bound in KERNEL_BOUNDS.items():
        r = Nystroem(kernel=kind, landmarks=300, idCol=O.ID).fit(x).residual(x)
        one = r.agg(F.lit(kind).alias("kernel"), F.count(F.lit(1)).alias("n"), (F.min("residual") < -1e-6).alias("overstated"),
                    (F.avg("residual") < bound).alias("within"))
        out = one if out is None else out.unionByName(one)
    return out


def q_tree_random_score(spark, sf_dir):
    """Decision tree with random thresholds (M3)."""
    from rareflag.operators.models.forest import tree_stages
    out, _ = _scored(spark, sf_dir, lambda tr: tree_stages("gini", maxDepth=6, minInstancesPerNode=2, splitter="random"))
    return _out(out)


def q_tree_random_root(spark, sf_dir):
    """A tree of one random split of all vectors, class 0 against the rest: where each vector goes (M3)."""
    from pyspark.ml.functions import array_to_vector

    from rareflag.operators.models.random_tree import RandomSplitTree
    e = embeddings(spark, sf_dir).select("vec_id", (F.col("label") == 0).cast("double").alias("label"),
                                         array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    m = RandomSplitTree(maxDepth=1, seed=SAMPLE_SEED).fit(e)
    return m.transform(e).select("vec_id", F.lit(m.getOrDefault("feature")[0]).alias("feature"),
                                 F.round(F.lit(m.getOrDefault("threshold")[0]), 6).alias("threshold"),
                                 (F.col("leaf") == 1).alias("went_left"), r6("score").alias("p1"))


def q_leaf_means_check(spark, sf_dir):
    """A single variance tree (no bootstrap): each leaf's probability equals
    the mean label of its training rows (note 7). One row per leaf."""
    from pyspark.ml.regression import DecisionTreeRegressor
    from rareflag.plans.score import fit, prepared_obs
    from rareflag.sources import obs as O
    data = prepared_obs(spark, sf_dir, O.LABEL)
    train = data.where(F.col("split") == "train")
    from rareflag.operators.models.common import ScoreToProbability
    dt = DecisionTreeRegressor(featuresCol="features", labelCol="label", predictionCol="score", maxDepth=4,
                               leafCol="leaf", maxBins=256)
    model = fit(train, [dt, ScoreToProbability()], "frozen")
    out = model.transform(train)
    return out.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("label")).alias("label_mean"),
                                   r6(F.min("p1")).alias("p1_min"), r6(F.max("p1")).alias("p1_max"))


def q_feature_importance_top(spark, sf_dir):
    """Forest importances by input name, top 15, with the spread over trees
    (M17, T1, A24)."""
    from rareflag.operators.models.forest import forest_stages
    from rareflag.plans.importance import forest_importances
    _, model = _scored(spark, sf_dir, lambda tr: forest_stages(**FOREST))
    imp = forest_importances(spark, model)
    return imp.orderBy(F.desc("importance"), "feature").limit(15)


def q_pca_explained(spark, sf_dir):
    """PCA of the z-scored cleaned inputs; cumulative explained variance and
    the smallest k reaching 0.9 (A23, W8, T3)."""
    from rareflag.plans.importance import pca_explained
    from rareflag.sources import obs as O
    return pca_explained(spark, O.observations(spark, sf_dir))


def _axes(spark, sf_dir):
    from rareflag.plans.importance import principal_axes
    from rareflag.plans.queries import _clean
    from rareflag.sources import obs as O
    data = _clean(spark, sf_dir, "median").select(O.ID, *O.FEATURES)
    return data, principal_axes(data, O.FEATURES)


def q_pca_vectors(spark, sf_dir):
    """Eigen-pairs in order: variance and loadings of every component."""
    _, axes = _axes(spark, sf_dir)
    return axes.table(spark).select("component", r6("variance").alias("variance"), "feature",
                                    r6("loading").alias("loading"))


def q_pca_reconstruction(spark, sf_dir):
    """Correlations put together again from the eigen-pairs; SQL computes them from the rows."""
    _, axes = _axes(spark, sf_dir)
    t = axes.table(spark)
    a, b = t.withColumnRenamed("feature", "col_a"), t.select(
        "component", F.col("feature").alias("col_b"), F.col("loading").alias("other"))
    out = a.join(b, "component").groupBy("col_a", "col_b").agg(
        F.sum(F.col("variance") * F.col("loading") * F.col("other")).alias("corr"))
    return out.select("col_a", "col_b", F.round(F.col("corr"), 5).alias("corr"))


def q_pca_projection(spark, sf_dir):
    """Every row on the first three components."""
    from rareflag.sources import obs as O
    data, axes = _axes(spark, sf_dir)
    return axes.project(data, 3).select(O.ID, *[r6(f"pc{k}").alias(f"pc{k}") for k in (1, 2, 3)])


def q_pca_projected_variances(spark, sf_dir):
    """Sum of the projected variances and of their squares, the largest covariance of two components: SQL has
    trace and squared norm of the correlation matrix, and 0 (A23)."""
    from rareflag.operators.explore import covariance_pairs
    from rareflag.sources import obs as O
    data, axes = _axes(spark, sf_dir)
    names = [f"pc{k + 1}" for k in range(len(O.FEATURES))]
    cov = covariance_pairs(axes.project(data, len(names)), names)
    own = F.col("col_a") == F.col("col_b")
    return cov.agg(F.round(F.sum(F.when(own, F.col("cov"))), 5).alias("trace"),
                   F.round(F.sum(F.when(own, F.col("cov") * F.col("cov"))), 5).alias("squares"),
                   (F.max(F.when(~own, F.abs("cov"))) > 1e-6).alias("correlated"))


# ------------------------------------------------------------- search, store, leaderboard

#: all six families; each line of trees, rounds and neighbours needs one training a fold
FULL_GRID = {
    "rfc": {"n_estimators": [10, 30], "max_depth": [4, 8], "min_samples_split": [2, 10], "min_samples_leaf": [1],
            "bootstrap": [False]},
    "svc": {"C": [10.0], "kernel": ["rbf"], "degree": [2, 3]},
    "knn": {"n_neighbors": [3, 5, 7], "weights": ["uniform", "distance"], "p": [1], "algorithm": ["ball_tree", "kd_tree"]},
    "lr": {"C": [1.0, 10.0], "penalty": ["l2"], "solver": ["lbfgs", "liblinear"]},
    "dt": [{"criterion": ["gini", "entropy"], "max_depth": [2, 4], "min_samples_split": [2, 10], "min_samples_leaf": [1]},
           {"criterion": ["gini"], "max_depth": [4], "splitter": ["random"]}],
    "ada": {"n_estimators": [5, 10], "learning_rate": [1.0]},
}

#: what the stored models of the leaderboard are chosen from
SEARCH_GRID = {f: FULL_GRID[f] for f in ("rfc", "dt", "lr")}


def _search(spark, sf_dir, grid=None, cv=3):
    from rareflag.plans.score import obs_preprocessing, prepared_obs
    from rareflag.plans.search import search
    from rareflag.sources import obs as O
    data = prepared_obs(spark, sf_dir, O.LABEL)
    train = data.where(F.col("split") == "train")
    res = search(train, grid or SEARCH_GRID, lambda: obs_preprocessing("batch"), cv=cv, scoring="f1")
    return data, res


def q_grid_search_results(spark, sf_dir):
    """cv_results: candidate x fold F1, mean, std, rank per family."""
    from rareflag.plans.search import summarize
    _, res = _search(spark, sf_dir, FULL_GRID)
    s = summarize(res.cv_results)
    return s.select("family", "candidate", "params", r6("mean_score").alias("mean_score"),
                    r6("std_score").alias("std_score"), "n_folds", "rank_in_family")


def q_run_api_evaluation(spark, sf_dir):
    """Train, store, load and evaluate through the run API; rows and positives of each part, and whether
    the confusion counts and F1 fit them (E5, M15)."""
    import uuid

    from rareflag import RareFlagger, RunConfig
    from rareflag.session import scratch_path
    from rareflag.sources import obs as O
    data = O.observations(spark, sf_dir)
    config = RunConfig(variables=list(O.VARIABLES), label=O.LABEL, flag_cols=list(O.FLAG_COLS),
                       binary_cols=list(O.BINARY_COLS), cv=2,
                       families={"rfc": {"n_estimators": [10], "max_depth": [4], "bootstrap": [False]}})
    path = RareFlagger(config).train(data).save(scratch_path(spark, f"api-{uuid.uuid4().hex}"), "set_3")["rfc"]
    m = RareFlagger(config).load(path).evaluate(data)
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return m.select("split", "n", (F.col("tp") + F.col("fn")).alias("positives"),
                    (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp") == F.col("n")).alias("adds_up"),
                    (F.abs(F.coalesce(f1, F.lit(0.0)) - F.col("f1")) < 1e-9).alias("f1_fits"))


def q_best_candidate(spark, sf_dir):
    """Best candidate of each of the six families and the cross-family winner."""
    import json
    _, res = _search(spark, sf_dir, FULL_GRID)
    rows = [(fam, json.dumps(p, sort_keys=True), round(sc, 6), res.winner is not None and res.winner[0] == fam)
            for fam, (p, sc, _) in res.best.items()]
    return spark.createDataFrame(rows, "family string, params string, mean_score double, winner boolean")


def q_leaderboard(spark, sf_dir):
    """Search, save every family's best in the store, then evaluate every
    stored model on train and test (S7-S10, M16)."""
    import uuid
    from rareflag.operators.metrics import error_metrics
    from rareflag.plans.score import score_parts
    from rareflag.session import scratch_path
    from rareflag.sources.store import list_models, load_model, save_model
    data, res = _search(spark, sf_dir)
    store = scratch_path(spark, f"store-{uuid.uuid4().hex}")
    for fam, model in res.models.items():
        params, sc, _ = res.best[fam]
        save_model(spark, model, store, "set_3", fam, params, sc)
    out = None
    for r in list_models(spark, store).collect():
        scored = score_parts(load_model(r["path"]), data, "batch")
        m = error_metrics(scored, "label", "prediction", by=["split"]).select(
            F.lit(r["feature_set"]).alias("feature_set"), F.lit(r["family"]).alias("family"),
            F.lit(round(r["cv_score"], 6)).alias("cv_score"), "split", "tn", "fp", "fn", "tp",
            r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("f1").alias("f1"))
        out = m if out is None else out.unionByName(m)
    return out


def q_validation_curve(spark, sf_dir):
    """CV F1 on the fit and held-out folds per forest depth."""
    from rareflag.plans.score import obs_preprocessing, prepared_obs
    from rareflag.plans.search import validation_curve
    from rareflag.sources import obs as O
    data = prepared_obs(spark, sf_dir, O.LABEL)
    train = data.where(F.col("split") == "train")
    vc = validation_curve(train, "rfc", {"n_estimators": 10, "bootstrap": False}, "max_depth", [2, 4, 8],
                          lambda: obs_preprocessing("batch"), cv=3)
    return vc.select("param", "value", "fold", r6("train_f1").alias("train_f1"), r6("test_f1").alias("test_f1"))


def q_rfe(spark, sf_dir):
    """Recursive feature elimination with CV, weighted F1."""
    from rareflag.plans.score import obs_preprocessing, prepared_obs
    from rareflag.plans.search import recursive_elimination
    from rareflag.sources import obs as O
    data = prepared_obs(spark, sf_dir, O.LABEL)
    train = data.where(F.col("split") == "train")
    r = recursive_elimination(train, O.VARIABLES, lambda v: obs_preprocessing("batch", variables=v),
                              {"n_estimators": 10, "max_depth": 4, "bootstrap": False}, cv=2, min_features=1)
    return r.select("n_features", r6("mean_f1").alias("mean_f1"), r6("std_f1").alias("std_f1"), "dropped")


def q_knn_score(spark, sf_dir):
    """kNN classifier on the cleaned, scaled obs (k=7, p=1, distance) (M5)."""
    from rareflag.operators.models.knn import knn_stages
    out, _ = _scored(spark, sf_dir, lambda tr: knn_stages(n_neighbors=7, weights="distance", p=1))
    return _out(out)


def q_review_probabilities(spark, sf_dir):
    """Forest test-set probabilities, highest first, for review."""
    from rareflag.operators.models.forest import forest_stages
    out, _ = _scored(spark, sf_dir, lambda tr: forest_stages(**FOREST))
    return _out(out.where(F.col("split") == "test")).orderBy(F.desc("p1"), "id")
