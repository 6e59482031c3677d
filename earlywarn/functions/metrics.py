"""Metric algebra on confusion counts.

Class 1 = pass, class 0 = at risk.  With ``tn`` = (true 0, predicted 0),
``fp`` = (true 0, predicted 1) = a missed risk, ``fn`` = (true 1, predicted 0)
= a false alarm, ``tp`` = (true 1, predicted 1).

Zero-denominator rule of the reference: 0.0 (``strict=False``) or null
(``strict=True``, the subgroup table).  Macro-F1 and balanced accuracy
average over the classes present (labels seen in y_true or y_pred for F1,
in y_true for recall), like the library defaults the reference relies on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, strict: bool = False) -> Column:
    out = F.when(den != 0, num.cast("double") / den.cast("double"))
    return out if strict else out.otherwise(F.lit(0.0))


def counts_from(y_true: Column, y_pred: Column, weight: Column | None = None) -> list[Column]:
    """Aggregate expressions producing tn, fp, fn, tp (bigint, or double when weighted)."""
    w = weight if weight is not None else F.lit(1)
    cell = lambda t, p: F.sum(F.when((y_true == t) & (y_pred == p), w).otherwise(F.lit(0)))
    cast = "double" if weight is not None else "bigint"
    return [
        cell(0, 0).cast(cast).alias("tn"),
        cell(0, 1).cast(cast).alias("fp"),
        cell(1, 0).cast(cast).alias("fn"),
        cell(1, 1).cast(cast).alias("tp"),
    ]


def _c(name):
    return F.col(name).cast("double")


def accuracy() -> Column:
    tn, fp, fn, tp = map(_c, ("tn", "fp", "fn", "tp"))
    return ratio(tn + tp, tn + fp + fn + tp)


def risk_recall(strict: bool = False) -> Column:
    return ratio(_c("tn"), _c("tn") + _c("fp"), strict)


def missed_risk_rate(strict: bool = False) -> Column:
    return ratio(_c("fp"), _c("tn") + _c("fp"), strict)


def false_alarm_rate(strict: bool = False) -> Column:
    return ratio(_c("fn"), _c("fn") + _c("tp"), strict)


def precision_risk(strict: bool = False) -> Column:
    return ratio(_c("tn"), _c("tn") + _c("fn"), strict)


def precision_pass() -> Column:
    return ratio(_c("tp"), _c("tp") + _c("fp"))


def recall_pass() -> Column:
    return ratio(_c("tp"), _c("tp") + _c("fn"))


def f1_risk() -> Column:
    return ratio(2 * _c("tn"), 2 * _c("tn") + _c("fp") + _c("fn"))


def f1_pass() -> Column:
    return ratio(2 * _c("tp"), 2 * _c("tp") + _c("fp") + _c("fn"))


def macro_f1() -> Column:
    tn, fp, fn, tp = map(_c, ("tn", "fp", "fn", "tp"))
    has0 = (tn + fp + fn) > 0
    has1 = (tp + fp + fn) > 0
    num = F.when(has0, f1_risk()).otherwise(0.0) + F.when(has1, f1_pass()).otherwise(0.0)
    den = has0.cast("int") + has1.cast("int")
    return ratio(num, den)


def balanced_accuracy() -> Column:
    tn, fp, fn, tp = map(_c, ("tn", "fp", "fn", "tp"))
    has0 = (tn + fp) > 0
    has1 = (tp + fn) > 0
    num = F.when(has0, tn / (tn + fp)).otherwise(0.0) + F.when(has1, tp / (tp + fn)).otherwise(0.0)
    den = has0.cast("int") + has1.cast("int")
    return ratio(num, den)


def mcc() -> Column:
    tn, fp, fn, tp = map(_c, ("tn", "fp", "fn", "tp"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return ratio(tp * tn - fp * fn, den)


# Metric display names of the reference and our column names,
# in the reference's order.
METRIC_NAMES = {
    "accuracy": "Accuracy",
    "bal_acc": "Balanced Accuracy",
    "macro_f1": "Macro-F1",
    "f1_pass": "F1-Pass",
    "f1_risk": "F1-Risk",
    "precision_pass": "Precision-Pass",
    "recall_pass": "Recall-Pass",
    "precision_risk": "Precision-Risk",
    "risk_recall": "Risk Recall",
    "missed_risk_rate": "Missed Risk Rate",
    "false_alarm_rate": "False Alarm Rate",
    "auc": "AUC-ROC",
    "pr_auc_risk": "PR-AUC-Risk",
    "mcc": "MCC",
}

CONFUSION_METRICS = {
    "accuracy": accuracy,
    "bal_acc": balanced_accuracy,
    "macro_f1": macro_f1,
    "f1_pass": f1_pass,
    "f1_risk": f1_risk,
    "precision_pass": precision_pass,
    "recall_pass": recall_pass,
    "precision_risk": precision_risk,
    "risk_recall": risk_recall,
    "missed_risk_rate": missed_risk_rate,
    "false_alarm_rate": false_alarm_rate,
    "mcc": mcc,
}
