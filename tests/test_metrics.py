"""Hand-computed cases for the metric algebra, curves and thresholds."""

import math

import pytest
from pyspark.sql import functions as F

from earlywarn.operators import curves, evaluate as ev, fairness, threshold as th


def frame(spark, rows, cols=("row_id", "y_true", "y_prob")):
    return spark.createDataFrame(rows, list(cols))


def test_confusion_fixed_order(spark):
    df = frame(spark, [(1, 0, 0.2), (2, 0, 0.7), (3, 1, 0.3), (4, 1, 0.9), (5, 1, 0.8)])
    r = ev.confusion(ev.apply_threshold(df, 0.5)).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (1, 1, 1, 2)


def test_metrics_one_class_present(spark):
    # all pass, all predicted pass: Macro-F1 over the classes present is 1.0
    df = frame(spark, [(i, 1, 0.9) for i in range(6)])
    r = ev.metrics_at(df, 0.5).first()
    assert r.macro_f1 == 1.0
    assert r.risk_recall == 0.0  # zero denominator -> 0 in the suite
    assert r.auc is None
    assert r.mcc == 0.0


def test_auc_ties_count_half(spark):
    # one positive and one negative share a score: AUC 0.5
    df = frame(spark, [(1, 1, 0.4), (2, 0, 0.4)])
    assert curves.roc_auc(df).first().auc == 0.5
    df2 = frame(spark, [(1, 1, 0.9), (2, 0, 0.4), (3, 1, 0.4), (4, 0, 0.1)])
    # pairs: (0.9>0.4)=1, (0.9>0.1)=1, (0.4=0.4)=0.5, (0.4>0.1)=1 -> 3.5/4
    assert curves.roc_auc(df2).first().auc == pytest.approx(0.875)


def test_average_precision_risk_class(spark):
    # risk = class 0 ranked by 1 - p
    df = frame(spark, [(1, 0, 0.1), (2, 1, 0.2), (3, 0, 0.3), (4, 1, 0.9)])
    # order by risk score: r1(risk), r2(pass), r3(risk), r4(pass)
    # AP = (1/1 + 2/3) / 2
    assert curves.average_precision(df).first().pr_auc_risk == pytest.approx((1 + 2 / 3) / 2)


def test_subgroup_null_rates_and_min_size(spark):
    rows = [(i, "A", 1, 0.9) for i in range(10)] + [(100 + i, "B", 0, 0.1) for i in range(3)] + [(200 + i, None, 0, 0.8) for i in range(10)]
    df = spark.createDataFrame(rows, ["row_id", "grp", "y_true", "y_prob"])
    out = {r.grp: r for r in fairness.subgroup_metrics(df, "grp").collect()}
    assert set(out) == {"A", "nan"}  # B below the minimum size, null group kept as 'nan'
    a = out["A"]
    assert a.risk_recall is None and a.risk_precision is None and a.missed_risk_rate is None
    assert a.f1_risk == 0.0 and a.macro_f1 == 1.0 and a.false_alarm_rate == 0.0
    assert out["nan"].risk_recall == 0.0 and out["nan"].missed_risk_rate == 1.0


def test_age_bands(spark):
    df = spark.createDataFrame([(14,), (16,), (17,), (30,), (31,), (None,)], "age int")
    got = [r.grp for r in fairness.band(df, "age").collect()]
    assert got == ["15–16", "15–16", "17–18", "21+", "nan", "nan"]


def test_threshold_grid_exact(spark):
    df = frame(spark, [(1, 0, 0.15), (2, 1, 0.15000000000000002), (3, 1, 0.95), (4, 0, 0.5)])
    c = {round(r.threshold, 2): r for r in th.threshold_cost(df).collect()}
    assert len(c) == 19
    # at t = 0.15 every row is predicted pass: both risk rows missed
    assert c[0.15].missed_risk_cases == 2 and c[0.15].false_alarms == 0
    # at t = 0.2 rows 1 and 2 are predicted risk: one risk caught, one pass flagged
    assert c[0.2].missed_risk_cases == 1 and c[0.2].false_alarms == 1
    assert c[0.2].weighted_cost == 6.0
    best = th.recommend_threshold(th.threshold_cost(df)).first()
    assert best.weighted_cost == min(r.weighted_cost for r in c.values())


def test_error_type(spark):
    df = frame(spark, [(1, 0, 0.7), (2, 1, 0.2), (3, 1, 0.8), (4, 0, 0.1)])
    got = {r.row_id: r.error_type for r in ev.error_type(df, 0.5).collect()}
    assert got == {1: "Missed risk", 2: "False alarm", 3: "Correct", 4: "Correct"}


def test_calibration_bins(spark):
    df = spark.createDataFrame([(i, i % 2, i / 100.0) for i in range(100)], ["row_id", "y_true", "y_prob"])
    from earlywarn.operators.calibration import calibration

    out = calibration(df, 4).orderBy("bin").collect()
    assert [r.n for r in out] == [25, 25, 25, 25]
    assert out[0].prob_pred == pytest.approx(0.12)
