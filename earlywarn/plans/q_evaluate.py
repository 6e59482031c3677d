"""OOF evaluation queries over F2 (one model) and F3 (three models x five folds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from earlywarn.operators import curves, evaluate as ev, summary as sm
from earlywarn.operators.evaluate import AT_THRESHOLD, SUITE
from earlywarn.plans.catalog import query
from earlywarn.plans.oracle_sql import (LEARNERS, OOF, SCORED, ap_sql, auc_sql, counts_sql, metric_sql, r6,
                                        suite_sql, with_ctes)
from earlywarn.sources import fixtures as fx

T = 0.5
MBY = ["model", "model_order"]


@query("apply_threshold", with_ctes(SCORED) + "SELECT row_id, CAST(y_prob >= 0.5e0 AS INTEGER) AS y_pred FROM scored")
def apply_threshold(spark, d):
    """P8"""
    return ev.apply_threshold(fx.scored(spark, d), T).select("row_id", "y_pred")


@query("with_risk", r6(with_ctes(SCORED) + "SELECT row_id, CAST(1 - y_true AS INTEGER) AS risk_true, 1e0 - y_prob AS risk_prob FROM scored", "risk_prob"))
def with_risk(spark, d):
    """P9"""
    return ev.with_risk(fx.scored(spark, d)).select("row_id", "risk_true", "risk_prob")


_ET = """SELECT row_id, CASE WHEN y_true = 0 THEN 'At risk' ELSE 'Pass' END AS actual,
  CASE WHEN y_prob >= 0.5e0 THEN 'Pass' ELSE 'At risk' END AS prediction,
  y_prob AS pass_probability, 1e0 - y_prob AS risk_probability,
  CASE WHEN y_true = 0 AND y_prob >= 0.5e0 THEN 'Missed risk' WHEN y_true = 1 AND y_prob < 0.5e0 THEN 'False alarm'
       WHEN y_true = CAST(y_prob >= 0.5e0 AS INTEGER) THEN 'Correct' ELSE 'Unknown' END AS error_type
FROM scored"""


@query("error_type", r6(with_ctes(SCORED) + _ET, "pass_probability", "risk_probability"))
def error_type(spark, d):
    """P10"""
    return ev.error_type(fx.scored(spark, d), T).select("row_id", "actual", "prediction", "pass_probability", "risk_probability", "error_type")


@query("confusion", with_ctes(OOF) + f"SELECT model, {counts_sql()} FROM oof GROUP BY model")
def confusion(spark, d):
    """A12 per model on the model's own predictions."""
    return ev.confusion(fx.oof(spark, d), ["model"])


_FOLD_SQL = with_ctes(OOF) + suite_sql("oof", ["model", "model_order", "fold"])


@query("classification_metrics", r6(_FOLD_SQL, *SUITE))
def classification_metrics(spark, d):
    """The 14-metric suite per model and outer fold."""
    return ev.classification_metrics(fx.oof(spark, d), ["model", "model_order", "fold"])


_AT_SQL = with_ctes(OOF, "oof_t AS (SELECT model, y_true, y_prob, CAST(y_prob >= 0.5e0 AS INTEGER) AS y_pred_t FROM oof)") + \
    suite_sql("oof_t", ["model"], AT_THRESHOLD, pred="y_pred_t")


@query("metrics_at", r6(_AT_SQL, *AT_THRESHOLD))
def metrics_at(spark, d):
    """Nine metrics on pooled OOF at threshold 0.5, per model."""
    return ev.metrics_at(fx.oof(spark, d), T, ["model"])


@query("roc_auc", r6(with_ctes(OOF) + "SELECT * FROM " + auc_sql("oof", ["model"]) + " q", "auc"))
def roc_auc(spark, d):
    """A14"""
    return curves.roc_auc(fx.oof(spark, d), ["model"])


@query("roc_auc_null", r6(with_ctes(OOF) + "SELECT nullif(model, 'alpha') AS model, auc FROM " + auc_sql("oof", ["model"]) + " q", "auc"))
def roc_auc_null(spark, d):
    """A14 with a null group."""
    return curves.roc_auc(fx.oof(spark, d).withColumn("model", F.expr("nullif(model, 'alpha')")), ["model"])


@query("roc_auc_fold", r6(with_ctes(OOF) + "SELECT * FROM " + auc_sql("oof", ["model", "fold"]) + " q", "auc"))
def roc_auc_fold(spark, d):
    """A14 per model and fold."""
    return curves.roc_auc(fx.oof(spark, d), ["model", "fold"])


@query("average_precision", r6(with_ctes(OOF) + "SELECT * FROM " + ap_sql("oof", ["model"]) + " q", "pr_auc_risk"))
def average_precision(spark, d):
    """A15"""
    return curves.average_precision(fx.oof(spark, d), ["model"])


@query("brier", r6(with_ctes(OOF) + "SELECT model, avg(pow(y_prob - y_true, 2)) AS brier, avg(y_prob) AS mean_pass_probability FROM oof GROUP BY model",
                   "brier", "mean_pass_probability"))
def brier(spark, d):
    """A21"""
    return ev.brier(fx.oof(spark, d), ["model"])


@query("prevalence", r6(with_ctes(OOF) + "SELECT model, avg(CAST(1 - y_true AS DOUBLE)) AS risk_prevalence FROM oof GROUP BY model", "risk_prevalence"))
def prevalence(spark, d):
    """A23"""
    return ev.prevalence(fx.oof(spark, d), ["model"])


_OC = with_ctes(SCORED, f"et AS ({_ET})") + """
SELECT o.outcome, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM (VALUES ('Correct'), ('Missed risk'), ('False alarm')) o(outcome)
LEFT JOIN (SELECT error_type, count(*) AS n FROM et GROUP BY error_type) c ON c.error_type = o.outcome"""


@query("outcome_counts", _OC)
def outcome_counts(spark, d):
    """Zero-filled outcome counts at threshold 0.5."""
    return ev.outcome_counts(fx.scored(spark, d), T)


_OC_NULL = with_ctes(OOF) + """SELECT nullif(m.model, 'alpha') AS model, o.outcome, CAST(count(e.outcome) AS BIGINT) AS count
FROM (SELECT DISTINCT model FROM oof) m CROSS JOIN (VALUES ('Correct'), ('Missed risk'), ('False alarm')) o(outcome)
LEFT JOIN (SELECT model, CASE WHEN y_true = CAST(y_prob >= 0.5e0 AS INTEGER) THEN 'Correct' WHEN y_true = 0 THEN 'Missed risk' ELSE 'False alarm' END AS outcome
  FROM oof) e ON e.model = m.model AND e.outcome = o.outcome GROUP BY m.model, o.outcome"""


@query("outcome_counts_null", _OC_NULL)
def outcome_counts_null(spark, d):
    """A25/J2 per model, with a null group."""
    df = fx.oof(spark, d).withColumn("model", F.expr("nullif(model, 'alpha')"))
    return ev.outcome_counts(df, T, by=["model"])


_ROC = with_ctes(OOF, """
h AS (SELECT model, y_prob AS score, CAST(sum(y_true) AS BIGINT) AS pos, CAST(sum(1 - y_true) AS BIGINT) AS neg FROM oof GROUP BY model, y_prob),
c AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, row_number() OVER w AS rk,
             lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg,
             count(*) OVER (PARTITION BY model) AS m, sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N
      FROM h WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""") + """
SELECT model, CAST(rk AS BIGINT) AS rk, score AS threshold,
       CASE WHEN N > 0 THEN CAST(fps AS DOUBLE) / N END AS fpr, CASE WHEN P > 0 THEN CAST(tps AS DOUBLE) / P END AS tpr
FROM c WHERE rk = 1 OR rk = m OR npos <> pos OR nneg <> neg
UNION ALL
SELECT model, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CASE WHEN sum(neg) > 0 THEN 0e0 END, CASE WHEN sum(pos) > 0 THEN 0e0 END FROM h GROUP BY model"""


@query("roc_curve", r6(_ROC, "threshold", "fpr", "tpr"))
def roc_curve(spark, d):
    """W2"""
    return curves.roc_curve(fx.oof(spark, d), ["model"])


_PR = with_ctes(OOF, """
h AS (SELECT model, 1e0 - y_prob AS score, CAST(sum(1 - y_true) AS BIGINT) AS pos, CAST(sum(y_true) AS BIGINT) AS neg FROM oof GROUP BY model, 1e0 - y_prob),
c AS (SELECT *, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp, row_number() OVER w AS rk, sum(pos) OVER (PARTITION BY model) AS P
      FROM h WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""") + """
SELECT model, CAST(rk AS BIGINT) AS rk, score AS threshold,
       CASE WHEN P > 0 THEN CAST(ctp AS DOUBLE) / P ELSE 1e0 END AS recall, CAST(ctp AS DOUBLE) / (ctp + cfp) AS precision
FROM c
UNION ALL
SELECT DISTINCT model, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), 0e0, 1e0 FROM h"""


@query("pr_curve", r6(_PR, "threshold", "recall", "precision"))
def pr_curve(spark, d):
    """W3"""
    return curves.pr_curve(fx.oof(spark, d), ["model"])


# ---- fold summaries over the 14-metric fold table -------------------------------------------

def _summary_sql(select: str) -> str:
    unp = " UNION ALL ".join(f"SELECT model, model_order, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM fm" for m in SUITE)
    return (f"WITH fm AS (SELECT * FROM ({_FOLD_SQL}) x), long AS ({unp}),\n"
            "summary AS (SELECT model, model_order, metric, avg(v) AS mean, COALESCE(stddev_samp(v), 0e0) AS std FROM long GROUP BY model, model_order, metric)\n"
            + select)


def _fold_summary(spark, d):
    fm = ev.classification_metrics(fx.oof(spark, d), ["model", "model_order", "fold"])
    return sm.summarize_folds(fm, SUITE)


@query("summarize_folds", r6(_summary_sql("SELECT * FROM summary"), "mean", "std"))
def summarize_folds(spark, d):
    """Mean and sample std over folds of each metric."""
    return _fold_summary(spark, d)


_LB_COLS = ", ".join(f"printf('%.3f ± %.3f', max(CASE WHEN metric = '{m}' THEN mean END), max(CASE WHEN metric = '{m}' THEN std END)) AS {m}"
                     for m in sm.LEADERBOARD_METRICS)
_LB = _summary_sql(f""", wide AS (SELECT model, model_order, max(CASE WHEN metric = 'macro_f1' THEN mean END) AS key, {_LB_COLS}
  FROM summary GROUP BY model, model_order)
SELECT CAST(row_number() OVER (ORDER BY key DESC, model_order) AS INTEGER) AS rank, model, {', '.join(sm.LEADERBOARD_METRICS)} FROM wide""")


@query("leaderboard", _LB)
def leaderboard(spark, d):
    """W1/P15"""
    return sm.leaderboard(_fold_summary(spark, d))


@query("top_models", f"SELECT * FROM ({_LB}) lb WHERE rank <= 2")
def top_models(spark, d):
    """T2 (k = 2 of three models)"""
    return sm.top_models(_fold_summary(spark, d), 2)


@query("best_model", r6(_summary_sql("SELECT model AS best_model, mean AS best_mean FROM "
                                     "(SELECT model, mean, model_order, row_number() OVER (ORDER BY mean DESC, model_order) AS r FROM summary WHERE metric = 'macro_f1') s WHERE r = 1"),
                        "best_mean"))
def best_model(spark, d):
    """T7"""
    return sm.best_model(_fold_summary(spark, d))


@query("metric_comparison", r6(_summary_sql("SELECT CAST(row_number() OVER (ORDER BY mean, model_order) AS INTEGER) AS position, model, metric, mean, std FROM summary WHERE metric = 'missed_risk_rate'"),
                               "mean", "std"))
def metric_comparison(spark, d):
    """A28 on a lower-is-better metric."""
    return sm.metric_comparison(_fold_summary(spark, d), "missed_risk_rate")


_MC_COLS = ", ".join(f"max(CASE WHEN s.metric = '{m}' THEN s.mean END) AS {m}" for m in sm.RADAR_METRICS)
_MC = _summary_sql(f""", lb AS (SELECT model, CAST(row_number() OVER (ORDER BY mean DESC, model_order) AS INTEGER) AS rank FROM summary WHERE metric = 'macro_f1')
SELECT lb.rank, lb.model, {_MC_COLS} FROM lb JOIN summary s ON s.model = lb.model WHERE lb.rank <= 3 GROUP BY lb.rank, lb.model""")


@query("multi_criteria", r6(_MC, *sm.RADAR_METRICS))
def multi_criteria(spark, d):
    """A29"""
    return sm.multi_criteria(_fold_summary(spark, d), 3)


_UP = _summary_sql("SELECT model, metric, mean, mean - (SELECT mean FROM summary WHERE metric = 'macro_f1' AND model = 'baseline') AS uplift "
                   "FROM summary WHERE metric = 'macro_f1'")


@query("uplift", r6(_UP, "mean", "uplift"))
def uplift(spark, d):
    """H6"""
    return sm.uplift(_fold_summary(spark, d), baseline="baseline")


_TIER = _summary_sql("""
, w AS (SELECT model, model_order, max(CASE WHEN metric = 'macro_f1' THEN mean END) AS mf, max(CASE WHEN metric = 'risk_recall' THEN mean END) AS rr FROM summary GROUP BY model, model_order),
b AS (SELECT * FROM w ORDER BY mf DESC, model_order LIMIT 1),
base AS (SELECT mf AS base FROM w WHERE model = 'baseline')
SELECT b.model AS best_model, mf AS macro_f1, rr AS risk_recall, base AS baseline_macro_f1, mf - base AS uplift,
  CASE WHEN mf >= 0.75e0 AND rr >= 0.70e0 AND mf - base >= 0.10e0 THEN 'Strong prototype evidence'
       WHEN mf >= 0.60e0 AND mf - base >= 0.05e0 THEN 'Moderate predictive evidence' ELSE 'Limited predictive evidence' END AS tier
FROM b CROSS JOIN base""")


@query("evidence_tier", r6(_TIER, "macro_f1", "risk_recall", "baseline_macro_f1", "uplift"))
def evidence_tier(spark, d):
    """H5"""
    return sm.evidence_tier(_fold_summary(spark, d), "baseline")


_J1 = with_ctes(LEARNERS, SCORED) + "SELECT l.row_id, l.school, l.failures, s.y_true, s.y_prob FROM learners l JOIN scored s ON s.row_id = l.row_id"


@query("attach_predictions", r6(_J1, "y_prob"))
def attach_predictions(spark, d):
    """Learners joined 1:1 with one model's predictions."""
    j = ev.attach_predictions(fx.learners(spark, d).select("row_id", "school", "failures"), fx.scored(spark, d))
    return j.select("row_id", "school", "failures", "y_true", "y_prob")


@query("oof_table", r6(with_ctes(OOF) + "SELECT row_id, y_true, y_pred, y_prob AS pass_probability, 1e0 - y_prob AS risk_probability FROM oof WHERE model = 'alpha'",
                       "pass_probability", "risk_probability"))
def oof_table(spark, d):
    """S7"""
    return ev.oof_table(fx.oof(spark, d), "alpha")


_MISSED = with_ctes(LEARNERS, SCORED) + """
SELECT l.row_id, l.school, l.sex, l.age, l.studytime, l.failures, l.absences, s.y_prob AS pass_probability, 1e0 - s.y_prob AS risk_probability
FROM learners l JOIN scored s ON s.row_id = l.row_id
WHERE s.y_true = 0 AND s.y_prob >= 0.5e0 ORDER BY s.y_prob DESC, l.row_id LIMIT 30"""


@query("missed_cases", r6(_MISSED, "pass_probability", "risk_probability"))
def missed_cases(spark, d):
    """The 30 missed-risk cases with the highest pass probability."""
    j = ev.attach_predictions(fx.learners(spark, d), fx.scored(spark, d))
    return ev.missed_cases(j, T, 30, ["school", "sex", "age", "studytime", "failures", "absences"])
