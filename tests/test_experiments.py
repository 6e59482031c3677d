"""Experiment keys: two experiments in one job give the results of two jobs."""

import random

import pytest
from pyspark.sql import functions as F

from earlywarn.operators import stats as st
from earlywarn.operators import summary as sm


@pytest.fixture(scope="module")
def folds(spark):
    r = random.Random(2)
    names = ["Dummy Baseline", "KNN", "Random Forest", "SVM RBF"]
    metrics = sorted({*sm.LEADERBOARD_METRICS, *sm.RADAR_METRICS})
    rows = [(e, m, o + 1, f, *[round(r.random(), 3) for _ in metrics]) for e in ("a", "b") for o, m in enumerate(names) for f in range(5)]
    cols = "exp string, model string, model_order int, fold int, " + ", ".join(f"{m} double" for m in metrics)
    return spark.createDataFrame(rows, cols), metrics


def both_ways(df, fn):
    """``fn(table, exp)`` over both experiments and over each alone."""
    got = fn(df, ["exp"])
    for e in ("a", "b"):
        alone = fn(df.filter(F.col("exp") == e).drop("exp"), [])
        mine = got.filter(F.col("exp") == e).drop("exp").select(alone.columns)
        rows = [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.collect()) for t in (mine, alone)]
        assert rows[0] == rows[1] != []


@pytest.mark.parametrize("fn", [
    lambda s, x: sm.top_models(s, 3, exp=x), lambda s, x: sm.metric_comparison(s, "auc", x), lambda s, x: sm.multi_criteria(s, 3, x),
    lambda s, x: sm.uplift(s, exp=x), lambda s, x: sm.evidence_tier(s, exp=x), lambda s, x: sm.best_model(s, exp=x),
])
def test_summaries_by_experiment(folds, fn):
    df, metrics = folds
    both_ways(df, lambda t, x: fn(sm.summarize_folds(t, metrics, [*x, "model", "model_order"]), x))


@pytest.mark.parametrize("fn", [
    lambda s, x: st.paired_table(s, "KNN", "SVM RBF", x),
    lambda s, x: st.paired_test(st.wilcoxon_pairs(st.paired_scores(s, x), x), "SVM RBF", "KNN", x),
    lambda s, x: st.friedman(s, x),
])
def test_paired_tests_by_experiment(folds, fn):
    both_ways(folds[0].withColumn("score", F.col("macro_f1")), fn)
