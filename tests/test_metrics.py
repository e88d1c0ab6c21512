import math

import pytest

from rareflag.operators import metrics as M


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, p1 double")


def test_identities(spark):
    rows = [(1, 1, .9)] * 30 + [(1, 0, .2)] * 7 + [(0, 1, .6)] * 5 + [(0, 0, .1)] * 958
    r = M.error_metrics(scored(spark, rows)).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (958, 5, 7, 30)
    assert r.mae == pytest.approx((5 + 7) / 1000)
    assert r.rmse == pytest.approx(math.sqrt(r.mae))
    assert r.f1 == pytest.approx(60 / 72)


def test_single_class_f1_is_zero(spark):
    r = M.error_metrics(scored(spark, [(0, 0, .1), (0, 0, .2)])).first()
    assert r.f1 == 0.0
    cells = {(c.actual, c.predicted): c.n for c in M.confusion(scored(spark, [(0, 0, .1)])).collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 0}


def test_roc_groups_ties(spark):
    rows = [(1, 1, .8), (0, 1, .8), (1, 0, .3), (0, 0, .1)]
    c = M.roc_curve(scored(spark, rows)).orderBy("threshold").collect()
    assert len(c) == 3
    auc = M.roc_auc_ap(scored(spark, rows)).first()
    # pairs: (.8,.8) tie = .5, (.8,.1) = 1, (.3,.8) = 0, (.3,.1) = 1 -> 2.5 / 4
    assert auc.auc == pytest.approx(0.625)


def test_threshold_sweep_matches_direct(spark):
    rows = [(1, 0, .35), (0, 0, .2), (1, 0, .6), (0, 0, .5)]
    s = {r.threshold: r for r in M.threshold_sweep(scored(spark, rows), [0.3, 0.5]).collect()}
    assert (s[0.3].tp, s[0.3].fp) == (2, 1)
    assert (s[0.5].tp, s[0.5].fp) == (1, 0)   # strict: 0.5 is not > 0.5
