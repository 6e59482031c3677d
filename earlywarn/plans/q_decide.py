"""Decision analytics queries: subgroups, disparity, thresholds, bootstrap, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from earlywarn.operators import bootstrap as bs, calibration as cal, fairness, threshold as th
from earlywarn.functions.hashing import GOLDEN
from earlywarn.plans.catalog import query
from earlywarn.plans.oracle_sql import draw_sql, key_hash_sql, LEARNERS, OOF, SCORED, auc_sql, counts_sql, metric_sql, r6, with_ctes
from earlywarn.sources import fixtures as fx

SUB_METRICS = ["actual_risk_rate", "predicted_risk_rate", "risk_recall", "risk_precision",
               "f1_risk", "macro_f1", "missed_risk_rate", "false_alarm_rate"]


def _sub_sql(src_cte: str, src: str, group_expr: str) -> str:
    return with_ctes(*src_cte, f"""
cm AS (
  SELECT {group_expr} AS grp, count(*) AS n,
         {counts_sql('y_true', 'CAST(y_prob >= 0.5e0 AS INTEGER)')}
  FROM {src} GROUP BY 1 HAVING count(*) >= 10
)""") + f"""
SELECT grp, n,
       CAST(tn + fp AS DOUBLE) / n AS actual_risk_rate,
       CAST(tn + fn AS DOUBLE) / n AS predicted_risk_rate,
       {metric_sql('risk_recall', True)} AS risk_recall,
       {metric_sql('precision_risk', True)} AS risk_precision,
       {metric_sql('f1_risk')} AS f1_risk,
       {metric_sql('macro_f1')} AS macro_f1,
       {metric_sql('missed_risk_rate', True)} AS missed_risk_rate,
       {metric_sql('false_alarm_rate', True)} AS false_alarm_rate
FROM cm"""


_SUB_SQL = _sub_sql([SCORED], "scored", "COALESCE(CAST(grp AS VARCHAR), 'nan')")

_AGE_BAND = """CASE WHEN age >= 14 AND age <= 16 THEN '15–16' WHEN age > 16 AND age <= 18 THEN '17–18'
  WHEN age > 18 AND age <= 20 THEN '19–20' WHEN age > 20 AND age <= 30 THEN '21+' ELSE 'nan' END"""
_LS = "ls AS (SELECT l.age, l.school, s.y_true, s.y_prob FROM learners l JOIN scored s ON s.row_id = l.row_id)"
_SUB_AGE_SQL = _sub_sql([LEARNERS, SCORED, _LS], "ls", _AGE_BAND)


@query("subgroup_metrics", r6(_SUB_SQL, *SUB_METRICS))
def subgroup_metrics(spark, sf_dir):
    """A17 on F2: subgroups by order status at threshold 0.5, min size 10."""
    return fairness.subgroup_metrics(fx.scored(spark, sf_dir), "grp", t=0.5, min_n=10)


def _age_scored(spark, d):
    from earlywarn.operators.evaluate import attach_predictions

    j = attach_predictions(fx.learners(spark, d).select("row_id", "age", "school"), fx.scored(spark, d))
    return fairness.band(j.drop("grp"), "age", out="age_band")


@query("subgroup_metrics_age", r6(_SUB_AGE_SQL, *SUB_METRICS))
def subgroup_metrics_age(spark, d):
    """A17 + P11: subgroups by the reference's age bands."""
    return fairness.subgroup_metrics(_age_scored(spark, d), "age_band", t=0.5, min_n=10)


@query("band", with_ctes(LEARNERS) + f"SELECT {_AGE_BAND} AS age_band, CAST(count(*) AS BIGINT) AS n FROM learners GROUP BY 1")
def band(spark, d):
    """Age bands over F1."""
    b = fairness.band(fx.learners(spark, d).select("age"), "age", out="age_band")
    return b.groupBy("age_band").agg(F.count(F.lit(1)).alias("n"))


def _disp_sql(metric: str, sub_sql: str) -> str:
    m = f"max({metric}) - min({metric})"
    return r6(f"""SELECT '{metric}' AS metric, {m} AS spread,
  CASE WHEN {m} >= 0.15e0 THEN 'material' WHEN {m} >= 0.08e0 THEN 'moderate' ELSE 'small' END AS level,
  CAST(count(*) AS BIGINT) AS groups, arg_min(grp, struct_pack(a := -n, b := grp)) AS reference_group
FROM ({sub_sql}) s""", "spread")


@query("disparity", _disp_sql("macro_f1", _SUB_AGE_SQL))
def disparity(spark, d):
    """Macro-F1 spread over age bands, its level and the reference group."""
    sub = fairness.subgroup_metrics(_age_scored(spark, d), "age_band", t=0.5, min_n=10)
    return fairness.disparity(sub, "macro_f1")


@query("disparity_risk_recall", _disp_sql("risk_recall", _SUB_SQL))
def disparity_risk_recall(spark, d):
    """A18 on risk recall over order-status groups."""
    return fairness.disparity(fairness.subgroup_metrics(fx.scored(spark, d), "grp"), "risk_recall")


@query("reference_group", f"SELECT arg_min(grp, struct_pack(a := -n, b := grp)) AS reference_group, max(n) AS n FROM ({_SUB_AGE_SQL}) s")
def reference_group(spark, d):
    """The largest subgroup."""
    sub = fairness.subgroup_metrics(_age_scored(spark, d), "age_band", t=0.5, min_n=10)
    return fairness.reference_group(sub)


def _cost_sql(by: list[str]) -> str:
    g = ", ".join(by)
    gp = g + ", " if by else ""
    return with_ctes(OOF, f"""
grid AS (SELECT i, i / 20e0 AS t FROM range(1, 20) r(i)),
cm AS (
  SELECT {gp}grid.i, grid.t, count(*) AS n,
         {counts_sql('y_true', 'CAST(y_prob >= grid.t AS INTEGER)')}
  FROM oof CROSS JOIN grid GROUP BY {gp}grid.i, grid.t
)""") + f"""
SELECT {gp}t AS threshold, fp AS missed_risk_cases, fn AS false_alarms,
  fp * 5e0 + fn * 1e0 AS weighted_cost, (fp * 5e0 + fn * 1e0) / n AS cost_per_student,
  {metric_sql('macro_f1')} AS macro_f1, {metric_sql('risk_recall')} AS risk_recall
FROM cm"""


_COST = _cost_sql(["model"])


@query("threshold_cost", r6(_COST, "threshold", "weighted_cost", "cost_per_student", "macro_f1", "risk_recall"))
def threshold_cost(spark, d):
    """19 thresholds x cost (5 per missed risk, 1 per false alarm), per model."""
    return th.threshold_cost(fx.oof(spark, d), 5.0, 1.0, 20, by=["model"])


@query("recommend_threshold", r6(f"""SELECT model, arg_min(threshold, struct_pack(a := weighted_cost, b := threshold)) AS threshold,
  min(weighted_cost) AS weighted_cost, arg_min(risk_recall, struct_pack(a := weighted_cost, b := threshold)) AS risk_recall,
  arg_min(missed_risk_cases, struct_pack(a := weighted_cost, b := threshold)) AS missed_risk_cases,
  arg_min(false_alarms, struct_pack(a := weighted_cost, b := threshold)) AS false_alarms
FROM ({_COST}) c GROUP BY model""", "threshold", "weighted_cost", "risk_recall"))
def recommend_threshold(spark, d):
    """Cheapest threshold per model, lowest on ties."""
    return th.recommend_threshold(th.threshold_cost(fx.oof(spark, d), 5.0, 1.0, 20, by=["model"]), by=["model"])


# the group of one model is the null group: the results of that group must not change

def _null_model(spark, d):
    return fx.oof(spark, d).withColumn("model", F.expr("nullif(model, 'alpha')"))


@query("threshold_cost_null", r6(f"SELECT * REPLACE (nullif(model, 'alpha') AS model) FROM ({_COST}) c", "threshold", "weighted_cost", "cost_per_student", "macro_f1", "risk_recall"))
def threshold_cost_null(spark, d):
    """A19 with a null group."""
    return th.threshold_cost(_null_model(spark, d), 5.0, 1.0, 20, by=["model"])


_CAL = with_ctes(OOF, """
e AS (SELECT model, quantile_cont(y_prob, [0.125e0, 0.25e0, 0.375e0, 0.5e0, 0.625e0, 0.75e0, 0.875e0]) AS edges FROM oof GROUP BY model)""") + """
SELECT o.model, CAST(len(list_filter(e.edges, lambda x: x < o.y_prob)) AS INTEGER) AS bin, count(*) AS n,
  avg(CAST(o.y_true AS DOUBLE)) AS prob_true, avg(o.y_prob) AS prob_pred
FROM oof o JOIN e USING (model) GROUP BY 1, 2"""


@query("calibration", r6(_CAL, "prob_true", "prob_pred"))
def calibration(spark, d):
    """8 quantile bins per model."""
    return cal.calibration(fx.oof(spark, d), 8, by=["model"])


@query("calibration_null", r6(f"SELECT * REPLACE (nullif(model, 'alpha') AS model) FROM ({_CAL}) c", "prob_true", "prob_pred"))
def calibration_null(spark, d):
    """A22 with a null group."""
    return cal.calibration(_null_model(spark, d), 8, by=["model"])


_POIS = " + ".join(f"CAST(u >= {c!r}e0 AS INTEGER)" for c in bs.poisson_cutoffs())
_TRACKED = ", ".join(f"'{m}'" for m in bs.TRACKED)


def _boot_sql(iterations: int) -> str:
    conf = ", ".join(f"{metric_sql(m)} AS {m}" for m in bs.TRACKED if m != "auc")
    est = f"""est AS (SELECT {conf}, (SELECT auc FROM {auc_sql('scored', [])} a) AS auc
  FROM (SELECT {counts_sql('y_true', 'CAST(y_prob >= 0.5e0 AS INTEGER)')} FROM scored) c)"""
    return with_ctes(SCORED, f"""
hs AS ({key_hash_sql("scored", "row_id, y_true, y_prob", "row_id")}),
states AS (SELECT b, (CAST(b + {42 * iterations} AS BIGINT) * {GOLDEN}) & 4294967295 AS st FROM range(1, {iterations + 1}) r(b)),
draws AS (
  SELECT b, row_id, y_true, y_prob, {_POIS} AS w FROM (
    {draw_sql("hs CROSS JOIN states", "b, row_id, y_true, y_prob", "st", "kh")}) x),
cmb AS (SELECT b, {counts_sql('y_true', 'CAST(y_prob >= 0.5e0 AS INTEGER)', 'w')} FROM draws GROUP BY b),
ok AS (SELECT * FROM cmb WHERE tn + fp > 0 AND fn + tp > 0),
h AS (SELECT b, y_prob AS score, CAST(sum(w * y_true) AS DOUBLE) AS pos, CAST(sum(w * (1 - y_true)) AS DOUBLE) AS neg FROM draws GROUP BY b, y_prob),
hc AS (SELECT *, sum(neg) OVER (PARTITION BY b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM h),
aucb AS (SELECT b, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (cum_neg - neg + neg / 2e0)) / (sum(pos) * sum(neg)) END AS auc FROM hc GROUP BY b),
perb AS (SELECT ok.b, {', '.join(f'{metric_sql(m)} AS {m}' for m in bs.TRACKED if m != 'auc')}, aucb.auc FROM ok LEFT JOIN aucb USING (b)),
lng AS (UNPIVOT perb ON {', '.join(bs.TRACKED)} INTO NAME metric VALUE v),
ci AS (SELECT metric, quantile_cont(v, 0.025e0) AS ci_lower, quantile_cont(v, 0.975e0) AS ci_upper FROM lng GROUP BY metric),
{est},
el AS (UNPIVOT est ON {', '.join(bs.TRACKED)} INTO NAME metric VALUE estimate)""") + f"""
SELECT el.metric, CAST(list_position([{_TRACKED}], el.metric) AS INTEGER) AS position, el.estimate, ci.ci_lower, ci.ci_upper
FROM el LEFT JOIN ci USING (metric)"""


@query("bootstrap_ci", r6(_boot_sql(500), "estimate", "ci_lower", "ci_upper"))
def bootstrap_ci(spark, d):
    """500 Poisson-bootstrap resamples of F2 at threshold 0.5, seed 42."""
    return bs.bootstrap_ci(fx.scored(spark, d), 0.5, 500, seed=42)


@query("round_cols", "SELECT grp, n, " + ", ".join(f"round({c}, 3) AS {c}" for c in SUB_METRICS) + f" FROM ({_SUB_SQL}) s")
def round_cols(spark, d):
    """The subgroup table rounded to three decimals for display."""
    from earlywarn.operators.shape import round_cols as rc

    return rc(fairness.subgroup_metrics(fx.scored(spark, d), "grp"), SUB_METRICS, 3)
