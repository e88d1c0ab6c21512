"""Named queries: one per operator of the inventory, each ``(spark, sf_dir)
-> DataFrame`` over the driver's tables (or tables Spark derives from them).

Float results are rounded to 6 places so that engines that add in a
different order compare equal; the oracle SQL rounds the same way.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareflag.functions.columns import byte_flag, colour_index, label_equals, null_indicator, r6, sig
from rareflag.operators import explore as X
from rareflag.operators import metrics as M
from rareflag.operators.clean import OneHotColumns, clean, cleaned_feature_names
from rareflag.operators.split import stratified_folds, train_test_split
from rareflag.plans.pipeline import preprocessing_stages
from rareflag.sources import obs as O
from rareflag.sources.tables import read_table

# Fixed values of the closed-form score used by the metric queries.
RULE_QTY_SCALE, RULE_DISC_SCALE, RULE_THRESHOLD = 500.0, 4.0, 0.15
SWEEP_THRESHOLDS = [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5]


def obs(spark, sf_dir) -> DataFrame:
    return O.observations(spark, sf_dir)


def _round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.simpleString() in ("double", "float")
                       else F.col(f.name) for f in df.schema.fields])


# ------------------------------------------------------------- projections

def q_null_inventory(spark, sf_dir):
    d = obs(spark, sf_dir)
    return X.null_inventory(d, [c for c in d.columns if c != O.ID])


def q_profile_columns(spark, sf_dir):
    return X.profile(obs(spark, sf_dir))


def q_null_indicators(spark, sf_dir):
    d = obs(spark, sf_dir)
    return d.select(O.ID, *[null_indicator(c).alias(f"{c}_isnan") for c in O.VARIABLES])


def _clean(spark, sf_dir, strategy):
    d = obs(spark, sf_dir)
    return clean(d, O.VARIABLES, flag_cols=O.FLAG_COLS, binary_cols=O.BINARY_COLS, pass_cols=[O.ID],
                 strategy=strategy)


def q_median_impute(spark, sf_dir):
    return _round_doubles(_clean(spark, sf_dir, "median"))


def q_mean_impute(spark, sf_dir):
    return _round_doubles(_clean(spark, sf_dir, "mean"))


def q_sentinel_fill(spark, sf_dir):
    d = obs(spark, sf_dir)
    return d.select(O.ID, F.coalesce(F.col("eflag"), F.lit(-1.0)).alias("eflag"))


def q_drop_null_rows(spark, sf_dir):
    d = obs(spark, sf_dir)
    return _round_doubles(d.select(O.ID, *O.FEATURES).na.drop("any", subset=O.FEATURES))


def q_binary_text_flag(spark, sf_dir):
    d = obs(spark, sf_dir)
    return d.select(O.ID, byte_flag("new_src").alias("new_src"), byte_flag("dmag_cat").alias("dmag_cat"))


def q_label_equals(spark, sf_dir):
    d = obs(spark, sf_dir)
    return d.select(O.ID, label_equals(O.CASE_COL, "1-URGENT").alias("is_urgent"))


def q_color_index(spark, sf_dir):
    d = obs(spark, sf_dir)
    return _round_doubles(d.select(O.ID, colour_index("price_max", "total_price").alias("price_gap"),
                                   colour_index("disc_avg", "tax_avg").alias("disc_tax")))


def q_bright_filter(spark, sf_dir):
    d = obs(spark, sf_dir)
    return d.where(F.col("qty_sum") > 150).select(O.ID, "qty_sum")


def q_large_quantities(spark, sf_dir):
    """Range filter on a float column that reaches the parquet reader."""
    return read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"],
                      where=[("l_quantity", ">", 30.0)])


def q_one_hot_case(spark, sf_dir):
    d = train_test_split(obs(spark, sf_dir))
    model = OneHotColumns(inputCols=[O.CASE_COL]).fit(d.where(F.col("split") == "train"))
    return model.transform(d.select(O.ID, O.CASE_COL))


def q_zscore_l2(spark, sf_dir):
    d = obs(spark, sf_dir)
    stages = preprocessing_stages(O.VARIABLES, flag_cols=O.FLAG_COLS, binary_cols=O.BINARY_COLS,
                                  pass_cols=[O.ID])
    out = Pipeline(stages=stages).fit(d).transform(d)
    arr = vector_to_array("features")
    names = cleaned_feature_names(O.VARIABLES)
    return out.select(O.ID, *[r6(arr.getItem(i)).alias(f"f_{n}") for i, n in enumerate(names)])


# ------------------------------------------------------------- split / folds

def q_train_test_split(spark, sf_dir):
    return train_test_split(obs(spark, sf_dir).select(O.ID)).select(O.ID, "split")


def q_class_balance(spark, sf_dir):
    d = train_test_split(obs(spark, sf_dir).select(O.ID, O.LABEL))
    return d.groupBy("split", O.LABEL).agg(F.count(F.lit(1)).alias("n"))


def q_stratified_folds(spark, sf_dir):
    d = obs(spark, sf_dir).select(O.ID, O.LABEL)
    return stratified_folds(d, k=5, label_col=O.LABEL).select(O.ID, "fold")


# ------------------------------------------------------------- aggregations

def q_value_counts(spark, sf_dir):
    return X.value_counts(obs(spark, sf_dir), O.CASE_COL)


def q_case_class_counts(spark, sf_dir):
    return X.group_class_counts(obs(spark, sf_dir), O.CASE_COL, O.LABEL, O.FEATURES)


def q_distinct_classes(spark, sf_dir):
    return obs(spark, sf_dir).select(O.LABEL).distinct()


def q_class_weights(spark, sf_dir):
    return _round_doubles(X.class_weights(obs(spark, sf_dir), O.LABEL))


def q_corr_matrix(spark, sf_dir):
    return _round_doubles(X.corr_pairs(obs(spark, sf_dir), O.FEATURES))


def q_corr_by_case(spark, sf_dir):
    return _round_doubles(X.corr_pairs(obs(spark, sf_dir), O.FEATURES, by=[O.CASE_COL]))


def q_flag_histogram(spark, sf_dir):
    return X.max_bins_histogram(obs(spark, sf_dir), "eflag")


def q_flag_histogram_by_class(spark, sf_dir):
    return X.max_bins_histogram(obs(spark, sf_dir), "eflag", by=[O.LABEL])


def q_density_grid(spark, sf_dir):
    return _round_doubles(X.density_grid(obs(spark, sf_dir), "qty_sum", "disc_avg", O.LABEL))


def q_covariance_matrix(spark, sf_dir):
    c = X.covariance_pairs(_clean(spark, sf_dir, "median"), O.FEATURES)
    return c.select("col_a", "col_b", sig("cov").alias("cov"))


# ------------------------------------------------------------- metrics on a closed-form score

def rule_p1():
    return F.round(F.coalesce(F.col("qty_sum"), F.lit(0.0)) / RULE_QTY_SCALE
                   - F.coalesce(F.col("disc_avg"), F.lit(0.0)) * RULE_DISC_SCALE, 3)


def rule_prediction():
    return (rule_p1() > RULE_THRESHOLD).cast("int")


def rule_scored(spark, sf_dir) -> DataFrame:
    return obs(spark, sf_dir).select(O.ID, F.col(O.LABEL).alias("label"), rule_p1().alias("p1"),
                                     rule_prediction().alias("prediction"))


def q_confusion(spark, sf_dir):
    return M.confusion(rule_scored(spark, sf_dir))


def q_confusion_percent(spark, sf_dir):
    return _round_doubles(M.confusion_percent(rule_scored(spark, sf_dir)))


def q_class_report(spark, sf_dir):
    return _round_doubles(M.class_report(rule_scored(spark, sf_dir)))


def q_class_prediction_error(spark, sf_dir):
    return M.class_prediction_error(rule_scored(spark, sf_dir))


def q_error_metrics(spark, sf_dir):
    return _round_doubles(M.error_metrics(rule_scored(spark, sf_dir)))


def q_prediction_tally(spark, sf_dir):
    return M.prediction_tally(rule_scored(spark, sf_dir))


def q_threshold_sweep(spark, sf_dir):
    return _round_doubles(M.threshold_sweep(rule_scored(spark, sf_dir), SWEEP_THRESHOLDS))


def q_roc_curve(spark, sf_dir):
    return _round_doubles(M.roc_curve(rule_scored(spark, sf_dir)))


def q_pr_curve(spark, sf_dir):
    return _round_doubles(M.pr_curve(rule_scored(spark, sf_dir)))


def q_roc_auc(spark, sf_dir):
    return _round_doubles(M.roc_auc_ap(rule_scored(spark, sf_dir)).select("auc"))


def q_average_precision(spark, sf_dir):
    return _round_doubles(M.roc_auc_ap(rule_scored(spark, sf_dir)).select("average_precision"))


# ------------------------------------------------------------- small projections, joins, sources

HEAD_N = 5


def q_head_rows(spark, sf_dir):
    """First rows in id order (S2, T2, P15: a limit is the feature)."""
    d = obs(spark, sf_dir)
    return _round_doubles(d.select(O.ID, *O.FEATURES).orderBy(O.ID).limit(HEAD_N))


def q_features_join_label(spark, sf_dir):
    """Features left-joined with the label on the row id."""
    d = obs(spark, sf_dir)
    x = d.select(O.ID, "qty_sum", "disc_avg")
    y = d.where(F.col(O.LABEL) == 1).select(O.ID, F.col(O.LABEL).alias("label"))
    return _round_doubles(x.join(y, O.ID, "left"))


def q_class_filter(spark, sf_dir):
    """Class mask and its complement, counted per case."""
    d = obs(spark, sf_dir)
    pos = d.where(F.col(O.LABEL) == 1).groupBy(O.CASE_COL).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("part", F.lit("positive"))
    neg = d.where(~(F.col(O.LABEL) == 1)).groupBy(O.CASE_COL).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("part", F.lit("negative"))
    return pos.unionByName(neg)


def q_feature_pair_by_class(spark, sf_dir):
    """Two features and the target, non-null pairs (P14; the data behind a scatter)."""
    d = obs(spark, sf_dir)
    return _round_doubles(d.where(F.col("qty_sum").isNotNull() & F.col("disc_avg").isNotNull())
                          .select(O.ID, "qty_sum", "disc_avg", O.LABEL))


def q_csv_roundtrip(spark, sf_dir):
    """CSV sink with a header, then CSV scan with inferred types."""
    import uuid
    from rareflag.session import scratch_path
    from rareflag.sources.store import write_csv
    from rareflag.sources.tables import read_csv
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    write_csv(obs(spark, sf_dir).select(O.ID, O.CASE_COL, "eflag", O.LABEL), path)
    back = read_csv(spark, path)
    return back.groupBy(O.CASE_COL, O.LABEL).agg(F.count(F.lit(1)).alias("n"),
                                                 F.sum("eflag").alias("eflag_sum"))


def q_stacked_sources(spark, sf_dir):
    """Two input files (faint / bright sets) scanned together with the file of
    each row, and a union with a source column (S3, U2)."""
    import uuid
    from rareflag.session import scratch_path
    from rareflag.sources.tables import read_parquet, stack_tables
    base = scratch_path(spark, f"stack-{uuid.uuid4().hex}")
    d = obs(spark, sf_dir).select(O.ID, "qty_sum", O.LABEL)
    d.where(F.col(O.LABEL) == 0).write.parquet(f"{base}/faint")
    d.where(F.col(O.LABEL) == 1).write.parquet(f"{base}/bright")
    both = read_parquet(spark, f"{base}/faint", f"{base}/bright", with_source=True)
    both = both.withColumn("source", F.when(F.col("source_file").contains("/bright/"), "bright").otherwise("faint"))
    stacked = stack_tables({"faint": spark.read.parquet(f"{base}/faint"),
                            "bright": spark.read.parquet(f"{base}/bright")}, "source")
    a = both.groupBy("source").agg(F.count(F.lit(1)).alias("n_scan"))
    b = stacked.groupBy("source").agg(F.count(F.lit(1)).alias("n_union"))
    return a.join(b, "source")
