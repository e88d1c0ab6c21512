"""DuckDB oracle SQL for the named queries (tables pre-registered as views;
``obs`` enters as a CTE). Column names equal the Spark query's."""

from __future__ import annotations

from rareflag.functions.randomness import hash_u32_sql, hash_unit_sql
from rareflag.plans import queries as Q
from rareflag.sources import obs as O
from rareflag.sources.obs import OBS_SQL

W = f"with {OBS_SQL}"
FEAT = O.FEATURES
VARS = O.VARIABLES


def _r(e: str) -> str:
    return f"round({e}, 6)"


def _cleaned(strategy: str = "median") -> str:
    """CTE ``cl``: the batch cleaner over the whole obs."""
    agg = "median" if strategy == "median" else "avg"
    stats = ", ".join(f"{agg}({c}) m_{c}" for c in FEAT)
    vals = []
    for c in VARS:
        if c in O.BINARY_COLS:
            vals.append(f"coalesce(cast(length(decode({c})) > 0 as integer), 0) as {c}")
        elif c in O.FLAG_COLS:
            vals.append(f"coalesce(coalesce({c}, m_{c}), -1.0) as {c}")
        else:
            vals.append(f"coalesce({c}, m_{c}) as {c}")
    inds = [f"cast({c} is null as integer) as {c}_isnan" for c in VARS]
    notnull = " and ".join(f"{c} is not null" for c in FEAT)
    return (f"st as (select {stats} from obs),\n"
            f"cl0 as (select id, {', '.join(vals)}, {', '.join(inds)} from obs, st),\n"
            f"cl as (select * from cl0 where {notnull})")


def _round_cols(cols, doubles) -> str:
    return ", ".join(_r(c) + f" as {c}" if c in doubles else c for c in cols)


def tree_random_root():
    imp = "case when {w} > 0 then {w} - ({p} * {p} + ({w} - {p}) * ({w} - {p})) / {w} else 0.0 end"
    whole, left = imp.format(w="tn", p="tp"), imp.format(w="n", p="p")
    right = imp.format(w="(tn - n)", p="(tp - p)")
    u = hash_unit_sql(42, "1", "f")
    return f"""with x as (select vec_id, cast(label = 0 as double) y, unnest(range(len(embedding))) f,
  cast(unnest(embedding) as double) v from embeddings),
r as (select f, min(v) lo, max(v) hi from x group by f),
d as (select f, lo + {u} * (hi - lo) t from r where lo < hi),
c as (select x.f, t, cast(count(*) as double) n, sum(y) p from x join d on x.f = d.f and v <= t group by 1, 2),
w as (select cast(count(*) as double) tn, sum(cast(label = 0 as double)) tp from embeddings),
b as (select *, p / n p_left, (tp - p) / (tn - n) p_right from c, w where n < tn
  order by round(({whole} - {left} - {right}) / tn, 12) desc, f limit 1)
select vec_id, b.f as feature, round(t, 6) as threshold, v <= t as went_left,
  round(case when v <= t then p_left else p_right end, 6) as p1 from x join b on x.f = b.f"""


def kernel_map_error():
    return (f"{W} select kernel, (select count(*) from obs) as n, false as overstated, true as within "
            "from (values ('rbf'), ('poly')) t(kernel)")


def null_inventory():
    cols = [c for c in ["total_price", "qty_sum", "qty_std", "disc_avg", "tax_avg", "price_max", "eflag",
                        "new_src", "dmag_cat", "case_name", "is_pos", "is_rare"]]
    parts = " union all ".join(
        f"select '{c}' as column_name, count(*) filter (where {c} is null) as null_count from obs" for c in cols)
    return f"{W} select column_name, null_count, null_count > 0 as any_null from ({parts})"


def profile_columns():
    types = {"id": "bigint", "total_price": "double", "qty_sum": "double", "qty_std": "double",
             "disc_avg": "double", "tax_avg": "double", "price_max": "double", "eflag": "double",
             "new_src": "binary", "dmag_cat": "binary", "case_name": "string", "is_pos": "int", "is_rare": "int"}
    parts = " union all ".join(
        f"select '{c}' as column_name, '{t}' as data_type, count(*) as n_rows, count({c}) as n_non_null, "
        f"count(distinct {'round(' + c + ', 6)' if t == 'double' else c}) as n_distinct from obs"
        for c, t in types.items())
    return f"{W} {parts}"


def null_indicators():
    inds = ", ".join(f"cast({c} is null as integer) as {c}_isnan" for c in VARS)
    return f"{W} select id, {inds} from obs"


def median_impute():
    cols = ["id"] + VARS + [f"{c}_isnan" for c in VARS]
    return f"{W}, {_cleaned('median')} select {_round_cols(cols, FEAT)} from cl"


def mean_impute():
    cols = ["id"] + VARS + [f"{c}_isnan" for c in VARS]
    return f"{W}, {_cleaned('mean')} select {_round_cols(cols, FEAT)} from cl"


def zscore_l2():
    names = VARS + [f"{c}_isnan" for c in VARS]
    mom = ", ".join(f"avg({c}) a_{c}, stddev_samp({c}) s_{c}" for c in names)
    z = ", ".join(f"case when s_{c} = 0 or s_{c} is null then 0.0 else ({c} - a_{c}) / s_{c} end as z_{c}"
                  for c in names)
    norm = " + ".join(f"z_{c} * z_{c}" for c in names)
    outs = ", ".join(f"round(case when nrm = 0 then z_{c} else z_{c} / nrm end, 6) as f_{c}" for c in names)
    return (f"{W}, {_cleaned('median')}, mo as (select {mom} from cl), "
            f"z as (select id, {z} from cl, mo), zn as (select *, sqrt({norm}) nrm from z) "
            f"select id, {outs} from zn")


ORACLES: dict[str, str] = {}


def _build() -> dict[str, str]:
    q = {}
    q["null_inventory"] = null_inventory()
    q["profile_columns"] = profile_columns()
    q["null_indicators"] = null_indicators()
    q["median_impute"] = median_impute()
    q["tree_random_root"] = tree_random_root()
    q["kernel_map_error"] = kernel_map_error()
    q["mean_impute"] = mean_impute()
    q["sentinel_fill"] = f"{W} select id, coalesce(eflag, -1.0) as eflag from obs"
    q["drop_null_rows"] = (f"{W} select id, {_round_cols(FEAT, FEAT)} from obs where "
                           + " and ".join(f"{c} is not null" for c in FEAT))
    q["binary_text_flag"] = (f"{W} select id, coalesce(cast(length(decode(new_src)) > 0 as integer), 0) as new_src, "
                             f"coalesce(cast(length(decode(dmag_cat)) > 0 as integer), 0) as dmag_cat from obs")
    q["label_equals"] = f"{W} select id, cast(case_name = '1-URGENT' as integer) as is_urgent from obs"
    q["color_index"] = (f"{W} select id, round(price_max - total_price, 6) as price_gap, "
                        f"round(disc_avg - tax_avg, 6) as disc_tax from obs")
    q["bright_filter"] = f"{W} select id, qty_sum from obs where qty_sum > 150"
    split = (f"sp as (select id, case when row_number() over (order by md5(concat('123:', cast(id as varchar))), id) "
             f"<= ceil(0.2 * count(*) over ()) then 'test' else 'train' end as split from obs)")
    # the five priority values are data facts of the orders table
    q["one_hot_case"] = (f"{W} select id, " + ", ".join(
        f"cast(case_name = '{v}' as integer) as \"case_name_{v}\""
        for v in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]) + " from obs")
    q["zscore_l2"] = zscore_l2()
    q["train_test_split"] = f"{W}, {split} select id, split from sp"
    q["class_balance"] = f"{W}, {split} select split, is_pos, count(*) as n from obs join sp using (id) group by all"
    q["stratified_folds"] = f"""{W},
c as (select is_pos y, count(*) n from obs group by is_pos),
st as (select y, n, coalesce(sum(n) over (order by y rows between unbounded preceding and 1 preceding), 0) s0 from c),
i5 as (select unnest(range(5)) i),
f as (select y, i, floor((s0+n-1-i+5)/5.0) - floor((s0-1-i+5)/5.0) a from st cross join i5),
b as (select y, i, sum(a) over (partition by y order by i) hi, sum(a) over (partition by y order by i) - a lo from f),
r as (select id, is_pos y, row_number() over (partition by is_pos order by id) - 1 rk from obs)
select r.id, cast(b.i as integer) as fold from r join b on r.y = b.y and r.rk >= b.lo and r.rk < b.hi"""
    q["value_counts"] = f"{W} select case_name, count(*) as n from obs where case_name is not null group by 1"
    notnull = " and ".join(f"{c} is not null" for c in FEAT)
    q["case_class_counts"] = (f"{W} select case_name, is_pos, count(*) as n, count(*) filter (where {notnull}) "
                              f"as n_complete from obs group by all")
    q["distinct_classes"] = f"{W} select distinct is_pos from obs"
    q["class_weights"] = (f"{W}, c as (select is_pos, count(*) n from obs group by 1) "
                          f"select is_pos, n, round((select sum(n) from c) / ((select count(*) from c) * n), 6) "
                          f"as weight from c")
    pairs = [(a, b) for i, a in enumerate(FEAT) for b in FEAT[i + 1:]]
    corr_u = " union all ".join(f"select '{a}' as col_a, '{b}' as col_b, corr({a}, {b}) as corr from obs"
                                for a, b in pairs)
    q["corr_matrix"] = f"{W} select col_a, col_b, round(corr, 6) as corr, round(abs(corr), 6) as abs_corr from ({corr_u})"
    corr_g = " union all ".join(
        f"select case_name, '{a}' as col_a, '{b}' as col_b, corr({a}, {b}) as corr from obs group by case_name"
        for a, b in pairs)
    q["corr_by_case"] = (f"{W} select case_name, col_a, col_b, round(corr, 6) as corr, round(abs(corr), 6) "
                         f"as abs_corr from ({corr_g})")
    hist = ("least(cast(floor((eflag-mn)/(mx-mn)*mx) as integer), cast(mx as integer)-1)")
    q["flag_histogram"] = (f"{W} select {hist} as bin, count(*) as n from obs cross join "
                           f"(select min(eflag) mn, max(eflag) mx from obs) m where eflag is not null group by 1")
    q["flag_histogram_by_class"] = (f"{W} select is_pos, {hist} as bin, count(*) as n from obs cross join "
                                    f"(select min(eflag) mn, max(eflag) mx from obs) m where eflag is not null "
                                    f"group by all")
    q["density_grid"] = f"""{W},
m as (select min(qty_sum) x0, max(qty_sum) x1, min(disc_avg) y0, max(disc_avg) y1 from obs),
g as (select is_pos as class,
             least(cast(floor((qty_sum - x0) / (x1 - x0) * 20) as integer), 19) bx,
             least(cast(floor((disc_avg - y0) / (y1 - y0) * 20) as integer), 19) "by", count(*) n
      from obs, m where qty_sum is not null and disc_avg is not null group by all),
o as (select dx, dy, exp(-(dx*dx + dy*dy) / 2.0) w from (select unnest(range(-4, 5)) dx), (select unnest(range(-4, 5)) dy)),
e as (select class, ((bx + dx) % 40 + 40) % 40 as bx, (("by" + dy) % 40 + 40) % 40 as "by",
             n * w / (select sum(w) from o) as v from g, o),
r as (select class, least(bx, 39 - bx) as bx, least("by", 39 - "by") as "by", v from e)
select class, cast(bx as integer) as bx, cast("by" as integer) as "by", round(sum(v), 6) as density from r group by all"""
    q["large_quantities"] = "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 30"
    q["run_api_evaluation"] = (f"{W}, {split} select split, count(*) as n, cast(sum(is_pos) as bigint) as positives, "
                               "true as adds_up, true as f1_fits from obs join sp using (id) group by split")
    cov_pairs = [(a, b) for i, a in enumerate(FEAT) for b in FEAT[i:]]
    cov_u = " union all ".join(f"select '{a}' as col_a, '{b}' as col_b, covar_samp({a}, {b}) as cov from cl"
                               for a, b in cov_pairs)
    q["covariance_matrix"] = (f"{W}, {_cleaned('median')} select col_a, col_b, {sig_sql('cov')} as cov "
                              f"from ({cov_u})")
    corr_all = " union all ".join(f"select '{a}' as col_a, '{b}' as col_b, {'1.0' if a == b else f'corr({a}, {b})'} as corr"
                                  + ("" if a == b else " from cl") for a in FEAT for b in FEAT)
    q["pca_reconstruction"] = (f"{W}, {_cleaned('median')} select col_a, col_b, round(corr, 5) as corr from ({corr_all})")
    q["pca_projected_variances"] = (f"{W}, {_cleaned('median')} select round(sum(case when col_a = col_b then corr end), 5) "
                                    f"as trace, round(sum(corr * corr), 5) as squares, false as correlated "
                                    f"from ({corr_all})")
    rule = (f"rs as (select id, is_pos as label, round(coalesce(qty_sum, 0) / {Q.RULE_QTY_SCALE} - "
            f"coalesce(disc_avg, 0) * {Q.RULE_DISC_SCALE}, 3) as p1 from obs), "
            f"sc as (select *, cast(p1 > {Q.RULE_THRESHOLD} as integer) as prediction from rs)")
    cnt = ("count(*) as n, cast(sum(case when label = 0 and prediction = 0 then 1 else 0 end) as bigint) as tn, "
           "cast(sum(case when label = 0 and prediction = 1 then 1 else 0 end) as bigint) as fp, "
           "cast(sum(case when label = 1 and prediction = 0 then 1 else 0 end) as bigint) as fn, "
           "cast(sum(case when label = 1 and prediction = 1 then 1 else 0 end) as bigint) as tp")
    cm = f"cm as (select {cnt}, avg(abs(label - prediction)) mae, sqrt(avg(power(label - prediction, 2))) rmse, avg(cast(label = prediction as double)) accuracy from sc)"
    cells = ("cells as (select 0 as actual, 0 as predicted, tn as n from cm union all select 0, 1, fp from cm "
             "union all select 1, 0, fn from cm union all select 1, 1, tp from cm)")
    q["stream_rule_tally"] = f"{W}, {rule} select cast(sum(prediction) as bigint) as flagged, count(*) as total from sc"
    q["confusion"] = f"{W}, {rule}, {cm}, {cells} select actual, predicted, n from cells"
    q["confusion_percent"] = (f"{W}, {rule}, {cm}, {cells} select actual, predicted, n, round(case when "
                              f"sum(n) over (partition by actual) = 0 then 0.0 else 100.0 * n / "
                              f"sum(n) over (partition by actual) end, 6) as percent from cells")
    q["class_prediction_error"] = (f"{W}, {rule}, {cm} select 0 as actual, tn as predicted_0, fp as predicted_1 "
                                   f"from cm union all select 1, fn, tp from cm")
    q["error_metrics"] = (f"{W}, {rule}, {cm} select n, tn, fp, fn, tp, round(mae, 6) as mae, round(rmse, 6) as rmse, "
                          f"round(accuracy, 6) as accuracy, round(case when 2*tp+fp+fn = 0 then 0.0 else "
                          f"2.0*tp/(2*tp+fp+fn) end, 6) as f1 from cm")
    q["class_report"] = f"""{W}, {rule}, {cm},
r as (select case when tn+fn = 0 then 0.0 else tn/(tn+fn) end p0, case when tn+fp = 0 then 0.0 else tn/(tn+fp) end r0,
             case when tp+fp = 0 then 0.0 else tp/(tp+fp) end p1, case when tp+fn = 0 then 0.0 else tp/(tp+fn) end r1,
             cast(tn+fp as double) s0, cast(tp+fn as double) s1, accuracy, cast(n as double) n from cm),
f as (select *, case when p0+r0 = 0 then 0.0 else 2*p0*r0/(p0+r0) end f0,
                case when p1+r1 = 0 then 0.0 else 2*p1*r1/(p1+r1) end f1 from r),
u as (select '0' as class, p0 as precision, r0 as recall, f0 as f1, s0 as support from f
      union all select '1', p1, r1, f1, s1 from f
      union all select 'accuracy', accuracy, accuracy, accuracy, n from f
      union all select 'macro avg', (p0+p1)/2, (r0+r1)/2, (f0+f1)/2, n from f
      union all select 'weighted avg', (p0*s0+p1*s1)/n, (r0*s0+r1*s1)/n, (f0*s0+f1*s1)/n, n from f)
select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
       round(support, 6) as support from u"""
    q["prediction_tally"] = (f"{W}, {rule} select cast(sum(prediction) as bigint) as flagged, count(*) as total from sc")
    ths = " union all ".join(f"select {float(t)} as threshold" for t in Q.SWEEP_THRESHOLDS)
    q["threshold_sweep"] = f"""{W}, {rule}, t as ({ths}),
c as (select threshold,
        cast(sum(case when p1 <= threshold and label = 0 then 1 else 0 end) as bigint) as tn,
        cast(sum(case when p1 > threshold and label = 0 then 1 else 0 end) as bigint) as fp,
        cast(sum(case when p1 <= threshold and label = 1 then 1 else 0 end) as bigint) as fn,
        cast(sum(case when p1 > threshold and label = 1 then 1 else 0 end) as bigint) as tp
      from sc cross join t group by threshold)
select threshold, tn, fp, fn, tp, round(case when 2*tp+fp+fn = 0 then 0.0 else 2.0*tp/(2*tp+fp+fn) end, 6) as f1 from c"""
    curve = f"""{W}, {rule},
g as (select p1 as threshold, sum(label) t, sum(1-label) f from sc where p1 is not null group by 1),
c as (select threshold, sum(t) over (order by threshold desc) tp, sum(f) over (order by threshold desc) fp,
             sum(t) over () tt, sum(f) over () ff, t, f from g),
r as (select threshold, tp/tt tpr, fp/ff fpr, tp/(tp+fp) prec, (tp-t)/tt tpr0, (fp-f)/ff fpr0 from c)"""
    q["roc_curve"] = f"{curve} select round(threshold, 6) as threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr from r"
    q["pr_curve"] = (f"{curve} select round(threshold, 6) as threshold, round(prec, 6) as precision, "
                     f"round(tpr, 6) as recall from r")
    q["roc_auc"] = f"{curve} select round(sum((fpr-fpr0)*(tpr+tpr0)/2), 6) as auc from r"
    q["average_precision"] = f"{curve} select round(sum((tpr-tpr0)*prec), 6) as average_precision from r"
    q["knn_join_l2"] = knn_sql(L2)
    q["knn_join_l1"] = knn_sql(L1)
    q["knn_vote_uniform"] = knn_vote_sql("uniform")
    q["knn_vote_distance"] = knn_vote_sql("distance")
    q["sample_neighbors"] = f"""with e as (select vec_id, cast(embedding as double[]) v, label from embeddings),
one as (select * from e order by md5(concat('42:', cast(vec_id as varchar))), vec_id limit 1),
j as (select a.vec_id, b.vec_id as neighbor_id, b.label, {L2} as d,
             row_number() over (partition by a.vec_id order by {L2}, b.vec_id) rn
      from one a join e b on a.vec_id <> b.vec_id)
select vec_id, neighbor_id, cast(rn as bigint) as rank, round(d, 6) as distance, label from j where rn <= 5"""
    smote = lambda fill: f"""with e as (select vec_id, cast(embedding as double[]) v, label from embeddings),
c as (select label, count(*) n from e group by label),
mx as (select max(n) n_max from c),
maj as (select min(label) maj from c, mx where n = n_max),
pl as (select c.label, c.n, n_max - c.n m from c, mx, maj where c.label <> maj.maj and n_max - c.n > 0
       {fill}),
syn as (select label, n, unnest(range(m)) as synth_i from pl),
h as (select label, synth_i, {hash_u32_sql(42, "'b'", "label", "synth_i")} % n as base_rank,
             cast({hash_u32_sql(42, "'n'", "label", "synth_i")} % 5 + 1 as integer) as nn_rank,
             {hash_unit_sql(42, "'u'", "label", "synth_i")} as u from syn),
r as (select vec_id, label, v, row_number() over (partition by label order by vec_id) - 1 as base_rank from e),
nn as (select a.vec_id q, b.vec_id t,
              row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) rk
       from e a join e b on a.label = b.label and a.vec_id <> b.vec_id where a.label in (select label from pl)),
j as (select h.label, h.synth_i, r.vec_id base_id, nn.t neighbor_id, h.u, r.v x, e2.v xn
      from h join r on r.label = h.label and r.base_rank = h.base_rank
      join nn on nn.q = r.vec_id and nn.rk = h.nn_rank join e e2 on e2.vec_id = nn.t)"""
    smallest = "order by c.n, c.label limit 1"
    rows = (" select label, synth_i, base_id, neighbor_id, round(u, 6) as u, "
                       "round(x[1] + u * (xn[1] - x[1]), 6) as x0, "
                       "round(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] + u * (xn[i] - x[i]))), 6) "
                       "as xsum, round(list_sum(list_transform(range(1, len(x) + 1), "
                       "lambda i: i * (x[i] + u * (xn[i] - x[i])))), 6) as xplaces from j")
    q["smote_rows"] = smote(smallest) + rows
    q["smote_rows_all_classes"] = smote("") + rows
    q["smote_union_counts"] = (smote(smallest) + " select label, false as synthetic, count(*) as n from e group by label "
                               "union all select label, true, count(*) from j group by label")
    frozen_stats = ", ".join(f"median({c}) m_{c}" for c in FEAT)
    fvals = []
    for c in VARS:
        if c in O.BINARY_COLS:
            fvals.append(f"coalesce(cast(length(decode({c})) > 0 as integer), 0) as {c}")
        elif c in O.FLAG_COLS:
            fvals.append(f"round(coalesce(coalesce({c}, m_{c}), -1.0), 6) as {c}")
        else:
            fvals.append(f"round(coalesce({c}, m_{c}), 6) as {c}")
    finds = ", ".join(f"cast({c} is null as integer) as {c}_isnan" for c in VARS)
    q["stream_clean_frozen"] = (f"{W}, {split}, st as (select {frozen_stats} from obs join sp using (id) "
                                f"where split = 'train') select id, {', '.join(fvals)}, {finds} from obs, st where "
                                + " and ".join(f"coalesce({c}, m_{c}) is not null" for c in FEAT))
    q["head_rows"] = f"{W} select id, {_round_cols(FEAT, FEAT)} from obs order by id limit 5"
    q["features_join_label"] = (f"{W} select x.id, round(x.qty_sum, 6) as qty_sum, round(x.disc_avg, 6) as disc_avg, "
                                f"y.is_pos as label from obs x left join (select id, is_pos from obs where is_pos = 1) y "
                                f"on x.id = y.id")
    q["class_filter"] = (f"{W} select case_name, count(*) as n, 'positive' as part from obs where is_pos = 1 group by 1 "
                         f"union all select case_name, count(*), 'negative' from obs where not (is_pos = 1) group by 1")
    q["feature_pair_by_class"] = (f"{W} select id, round(qty_sum, 6) as qty_sum, round(disc_avg, 6) as disc_avg, "
                                  f"is_pos from obs where qty_sum is not null and disc_avg is not null")
    q["csv_roundtrip"] = (f"{W} select case_name, is_pos, count(*) as n, sum(eflag) as eflag_sum from obs "
                          f"group by all")
    q["stacked_sources"] = (f"{W} select case when is_pos = 1 then 'bright' else 'faint' end as source, "
                            f"count(*) as n_scan, count(*) as n_union from obs group by 1")
    return q


def knn_sql(dist: str, k: int = 5) -> str:
    return f"""with e as (select vec_id, cast(embedding as double[]) v, label from embeddings),
j as (select a.vec_id, b.vec_id as neighbor_id, {dist} as d,
             row_number() over (partition by a.vec_id order by {dist}, b.vec_id) rn
      from e a join e b on a.vec_id <> b.vec_id)
select vec_id, neighbor_id, cast(rn as bigint) as rank, round(d, 6) as distance from j where rn <= {k}"""


L2 = "list_distance(a.v, b.v)"
L1 = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: abs(a.v[i] - b.v[i])))"
SPLIT_E = ("es as (select *, case when row_number() over (order by md5(concat('123:', cast(vec_id as varchar))), "
           "vec_id) <= ceil(0.2 * count(*) over ()) then 'test' else 'train' end as split from e)")


def knn_vote_sql(weights: str, k: int = 5) -> str:
    w = ("1.0" if weights == "uniform" else
         "case when min(d) over (partition by q) = 0 then case when d = 0 then 1.0 else 0.0 end else 1.0 / d end")
    return f"""with e as (select vec_id, cast(embedding as double[]) v, label from embeddings), {SPLIT_E},
j as (select a.vec_id q, b.vec_id t, b.label, list_distance(a.v, b.v) d,
             row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) rn
      from es a join es b on a.split = 'test' and b.split = 'train'),
n as (select q, label, d from j where rn <= {k}),
nw as (select q, label, {w} as w from n),
g as (select q, label, sum(w) w from nw group by all),
s as (select *, w / sum(w) over (partition by q) share,
             row_number() over (partition by q order by w desc, label) r from g)
select s.q as vec_id, t.label, s.label as prediction, round(share, 6) as vote_share
from s join es t on t.vec_id = s.q where r = 1"""


def sig_sql(e: str, digits: int = 9) -> str:
    """Round to ``digits`` significant digits (same steps as the Spark side)."""
    p = f"power(10.0, floor(log10(abs({e}))))"
    return f"case when {e} = 0 or {e} is null then {e} else round({e} / {p}, {digits - 1}) * {p} end"


def positive_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``: DuckDB keeps the
    sign of a value rounded to zero, Spark does not."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                break
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = positive_zero(sql[j + 6:k])
        out.append(sql[i:j] + f"(round({inner}) + 0.0)")
        i = k + 1
    return "".join(out)


ORACLES = {k: positive_zero(v) for k, v in _build().items()}
