"""OOF evaluation core."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.functions import metrics as M
from earlywarn.functions.frames import join_on
from earlywarn.operators.curves import ranking_metrics


def apply_threshold(df: DataFrame, t: float, prob: str = "y_prob", out: str = "y_pred") -> DataFrame:
    """Class 1 (pass) when the pass probability is at least ``t``."""
    return df.withColumn(out, (F.col(prob) >= F.lit(float(t))).cast("int"))


def with_risk(df: DataFrame, y_true: str = "y_true", prob: str = "y_prob") -> DataFrame:
    """Risk label and risk probability as complements."""
    return df.withColumn("risk_true", (1 - F.col(y_true)).cast("int")).withColumn("risk_prob", F.lit(1.0) - F.col(prob))


def error_type(df: DataFrame, t: float, y_true: str = "y_true", prob: str = "y_prob") -> DataFrame:
    """P10: outcome label, actual/prediction text and both probabilities at threshold ``t``."""
    pred = (F.col(prob) >= F.lit(float(t))).cast("int")
    yt = F.col(y_true)
    return df.select(
        "*",
        F.when(yt == 0, "At risk").otherwise("Pass").alias("actual"),
        F.when(pred == 0, "At risk").otherwise("Pass").alias("prediction"),
        F.col(prob).alias("pass_probability"),
        (F.lit(1.0) - F.col(prob)).alias("risk_probability"),
        F.when((yt == 0) & (pred == 1), "Missed risk")
        .when((yt == 1) & (pred == 0), "False alarm")
        .when(yt == pred, "Correct")
        .otherwise("Unknown")
        .alias("error_type"),
    )


def confusion(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Tn, fp, fn, tp in the fixed label order [0, 1]; one partial aggregation."""
    return df.groupBy(*by).agg(*M.counts_from(F.col(y_true), F.col(y_pred)))


def _with_confusion_metrics(cm: DataFrame, names: Sequence[str], strict: bool = False) -> DataFrame:
    cols = []
    for n in names:
        fn = M.CONFUSION_METRICS[n]
        cols.append((fn(strict) if n in ("risk_recall", "missed_risk_rate", "false_alarm_rate", "precision_risk") else fn()).alias(n))
    return cm.select("*", *cols)


SUITE = ("accuracy", "bal_acc", "macro_f1", "f1_pass", "f1_risk", "precision_pass", "recall_pass",
         "precision_risk", "risk_recall", "missed_risk_rate", "false_alarm_rate", "auc", "pr_auc_risk", "mcc")


def classification_metrics(df: DataFrame, by: Sequence[str] = (), with_ranking: bool = True,
                           y_true: str = "y_true", y_pred: str = "y_pred", prob: str = "y_prob") -> DataFrame:
    """The 14-metric suite per group, on the model's own ``y_pred``."""
    by = list(by)
    cm = confusion(df, by, y_true, y_pred)
    names = [n for n in SUITE if n in M.CONFUSION_METRICS]
    out = _with_confusion_metrics(cm, names)
    if with_ranking:
        out = join_on(out, ranking_metrics(df, by, y_true, prob), by, "left")
        return out.select(*by, *SUITE)
    return out.select(*by, *names)


AT_THRESHOLD = ("macro_f1", "bal_acc", "risk_recall", "f1_risk", "missed_risk_rate", "false_alarm_rate", "auc", "pr_auc_risk", "mcc")


def metrics_at(df: DataFrame, t: float, by: Sequence[str] = (), y_true: str = "y_true", prob: str = "y_prob") -> DataFrame:
    """Nine metrics on pooled OOF at a free threshold ``t``."""
    by = list(by)
    d = apply_threshold(df, t, prob, "_pred")
    cm = confusion(d, by, y_true, "_pred")
    out = _with_confusion_metrics(cm, [n for n in AT_THRESHOLD if n in M.CONFUSION_METRICS])
    out = join_on(out, ranking_metrics(df, by, y_true, prob), by, "left")
    return out.select(*by, *AT_THRESHOLD)


def brier(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", prob: str = "y_prob") -> DataFrame:
    """Brier score and mean predicted pass probability."""
    return df.groupBy(*by).agg(
        F.avg(F.pow(F.col(prob) - F.col(y_true), 2)).alias("brier"),
        F.avg(F.col(prob)).alias("mean_pass_probability"),
    )


def prevalence(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true") -> DataFrame:
    """Share of risk rows."""
    return df.groupBy(*by).agg(F.avg((1 - F.col(y_true)).cast("double")).alias("risk_prevalence"))


OUTCOMES = ("Correct", "Missed risk", "False alarm")


def outcome_counts(df: DataFrame, t: float, by: Sequence[str] = ()) -> DataFrame:
    """Correct / Missed risk / False alarm counts, zero-filled over that domain."""
    from earlywarn.operators.audit import complete_counts

    return complete_counts(error_type(df, t), "error_type", OUTCOMES, by=by).withColumnRenamed("error_type", "outcome")


def attach_predictions(features: DataFrame, oof: DataFrame, model: str | None = None, key: str = "row_id") -> DataFrame:
    """Features joined 1:1 with one model's OOF rows on the row key.

    A key that is null, on one side only or on more than one row of either
    side is an error at run time.
    """
    o = oof if model is None else oof.filter(F.col("model") == F.lit(model))
    once = Window.partitionBy(key)  # in the partitions of the join
    left = features.withColumn("__features", F.count(F.lit(1)).over(once))
    right = o.withColumn("__predictions", F.count(F.lit(1)).over(once))
    j = left.join(right, on=key, how="full_outer")
    paired = (F.coalesce("__features", F.lit(0)) == 1) & (F.coalesce("__predictions", F.lit(0)) == 1)
    says = F.concat(F.lit(f"not one row of features and one prediction for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return j.filter(F.when(paired, F.lit(True)).otherwise(F.raise_error(says).cast("boolean"))).drop("__features", "__predictions")


def oof_table(oof: DataFrame, model: str) -> DataFrame:
    """OOF predictions of one model with both probabilities (partition pruning on ``model``)."""
    return oof.filter(F.col("model") == F.lit(model)).select(
        "row_id", "y_true", "y_pred",
        F.col("y_prob").alias("pass_probability"),
        (F.lit(1.0) - F.col("y_prob")).alias("risk_probability"),
    )


def missed_cases(df: DataFrame, t: float, n: int | None = 30, cols: Sequence[str] = (), prob: str = "y_prob", key: str = "row_id") -> DataFrame:
    """Missed-risk rows by pass probability, highest first: a top-n report, or all of them with ``n=None``."""
    e = error_type(df, t, prob=prob).filter(F.col("error_type") == "Missed risk")
    e = e.orderBy(F.col(prob).desc(), F.col(key))
    return (e if n is None else e.limit(n)).select(key, *cols, "pass_probability", "risk_probability")
