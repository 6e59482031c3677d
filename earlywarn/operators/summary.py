"""Fold summaries, leaderboard and claims.

These read the fold-metrics table (models x folds), which is small by
construction; every function takes ``by`` keys so many experiments run in
one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.functions import metrics as M
from earlywarn.functions.frames import join_on

LOWER_IS_BETTER = ("missed_risk_rate", "false_alarm_rate")
LEADERBOARD_METRICS = ("macro_f1", "risk_recall", "f1_risk", "bal_acc", "auc", "mcc")
BASELINE = "Dummy Baseline"  # the model zoo's name
RADAR_METRICS = ("macro_f1", "risk_recall", "bal_acc", "auc", "pr_auc_risk")


def summarize_folds(fold_metrics: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("model", "model_order")) -> DataFrame:
    """Mean and sample std (0 with one fold) of each metric over folds."""
    by = list(by)
    long = fold_metrics.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    return long.groupBy(*by, "metric").agg(
        F.avg("v").alias("mean"),
        F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"),
    )


def _wide(summary: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    aggs = []
    for m in metrics:
        aggs += [F.max(F.when(F.col("metric") == m, F.col("mean"))).alias(f"mean_{m}"),
                 F.max(F.when(F.col("metric") == m, F.col("std"))).alias(f"std_{m}")]
    return summary.groupBy(*by).agg(*aggs)


def fmt_mean_std(mean: str, std: str):
    """P15: 'mean ± std' with three decimals."""
    return F.format_string("%.3f ± %.3f", F.col(mean), F.col(std))


def leaderboard(summary: DataFrame, metric: str = "macro_f1", exp: Sequence[str] = ()) -> DataFrame:
    """Position by mean of ``metric`` (desc), ties in model order; 'mean ± std' cells."""
    exp = list(exp)
    w = _wide(summary, LEADERBOARD_METRICS, [*exp, "model", "model_order"])
    win = (Window.partitionBy(*exp) if exp else Window.partitionBy(F.lit(0))).orderBy(F.col(f"mean_{metric}").desc(), "model_order")
    return w.select(
        *exp, F.row_number().over(win).alias("rank"), "model",
        *[fmt_mean_std(f"mean_{m}", f"std_{m}").alias(m) for m in LEADERBOARD_METRICS],
    )


def top_models(summary: DataFrame, k: int = 5, metric: str = "macro_f1", exp: Sequence[str] = ()) -> DataFrame:
    """First ``k`` leaderboard rows (a top-k report)."""
    return leaderboard(summary, metric, exp).filter(F.col("rank") <= k)


def best_model(summary: DataFrame, metric: str = "macro_f1", exp: Sequence[str] = ()) -> DataFrame:
    """Highest mean ``metric``, first in model order on ties; the baseline is eligible."""
    s = summary.filter(F.col("metric") == metric)
    return s.groupBy(*exp).agg(
        F.max_by("model", F.struct(F.col("mean").alias("a"), (-F.col("model_order")).alias("b"))).alias("best_model"),
        F.max("mean").alias("best_mean"),
    )


def metric_comparison(summary: DataFrame, metric: str, exp: Sequence[str] = ()) -> DataFrame:
    """Models by one metric, best first (lower is better for the two error rates)."""
    s = summary.filter(F.col("metric") == metric)
    key = F.col("mean") if metric in LOWER_IS_BETTER else -F.col("mean")
    w = Window.partitionBy(*(list(exp) or [F.lit(0)])).orderBy(key, "model_order")
    return s.select(*exp, F.row_number().over(w).alias("position"), "model", "metric", "mean", "std")


def multi_criteria(summary: DataFrame, k: int = 3, exp: Sequence[str] = ()) -> DataFrame:
    """The top ``k`` leaderboard models x five balanced / risk metrics."""
    top = leaderboard(summary, exp=exp).filter(F.col("rank") <= k).select(*exp, "rank", "model")
    w = _wide(summary, RADAR_METRICS, [*exp, "model"])
    return join_on(top, w, [*exp, "model"]).select(*exp, "rank", "model", *[F.col(f"mean_{m}").alias(m) for m in RADAR_METRICS])


def uplift(summary: DataFrame, metric: str = "macro_f1", baseline: str = BASELINE, exp: Sequence[str] = ()) -> DataFrame:
    """H6: each model's mean minus the baseline's mean."""
    s = summary.filter(F.col("metric") == metric)
    b = s.filter(F.col("model") == baseline).select(*exp, F.col("mean").alias("_base"))
    return join_on(s, b, exp).select(*exp, "model", "metric", "mean", (F.col("mean") - F.col("_base")).alias("uplift"))


def evidence_tier(summary: DataFrame, baseline: str = BASELINE, exp: Sequence[str] = ()) -> DataFrame:
    """H5: Strong if Macro-F1 >= .75, risk recall >= .70 and uplift >= .10;
    Moderate if Macro-F1 >= .60 and uplift >= .05; else Limited."""
    best = best_model(summary, exp=exp)
    w = _wide(summary, ("macro_f1", "risk_recall", "auc"), [*exp, "model"])
    bw = join_on(best, w.withColumnRenamed("model", "best_model"), [*exp, "best_model"])
    base = w.filter(F.col("model") == baseline).select(*exp, F.col("mean_macro_f1").alias("_base"))
    j = join_on(bw, base, exp)
    up = F.col("mean_macro_f1") - F.col("_base")
    tier = (F.when((F.col("mean_macro_f1") >= 0.75) & (F.col("mean_risk_recall") >= 0.70) & (up >= 0.10), "Strong prototype evidence")
            .when((F.col("mean_macro_f1") >= 0.60) & (up >= 0.05), "Moderate predictive evidence")
            .otherwise("Limited predictive evidence"))
    return j.select(*exp, "best_model", F.col("mean_macro_f1").alias("macro_f1"), F.col("mean_risk_recall").alias("risk_recall"),
                    F.col("_base").alias("baseline_macro_f1"), up.alias("uplift"), tier.alias("tier"))


def class_weights(df: DataFrame, y: str = "target") -> DataFrame:
    """Balanced class weights n / (2 * n_class)."""
    c = df.groupBy(F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n_class"))
    t = c.agg(F.sum("n_class").alias("_n"))
    return join_on(c, t, []).select("class", "n_class", (F.col("_n") / (F.lit(2.0) * F.col("n_class"))).alias("weight"))
