"""Ranking metrics and curves on score histograms.

Rows are first grouped by (group, score), so the work after the scan is
proportional to the number of distinct scores.  Running totals over the
score order come from ``running_totals`` (range-partitioned), never from a
one-task window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.functions.frames import join_on, null_safe_join
from earlywarn.functions.ranking import running_totals


def score_histogram(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", score: str = "y_prob") -> DataFrame:
    """(by..., score, pos, neg): counts of pass (1) and risk (0) rows per score."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(y_true).cast("bigint")).alias("pos"),
        F.sum((1 - F.col(y_true)).cast("bigint")).alias("neg"),
    )


def roc_auc(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", score: str = "y_prob") -> DataFrame:
    """ROC AUC of the pass probability, ties counted one half; null with one class."""
    by = list(by)
    h = score_histogram(df, by, y_true, score)
    c = running_totals(h, by, ["score"], {"cum_neg": F.col("neg")})
    below = F.col("cum_neg") - F.col("neg")  # negatives with a strictly lower score
    agg = c.groupBy(*by).agg(
        F.sum(F.col("pos") * (below.cast("double") + F.col("neg") / F.lit(2.0))).alias("_u"),
        F.sum("pos").cast("double").alias("_p"),
        F.sum("neg").cast("double").alias("_n"),
    )
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n")))
    return agg.select(*by, auc.alias("auc"))


def average_precision(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Average precision of the risk class ranked by 1 - p (step-wise, no interpolation)."""
    by = list(by)
    risk = df.select(*by, (1 - F.col(y_true)).alias("_rt"), (F.lit(1.0) - F.col(score)).alias("_rs"))
    h = score_histogram(risk, by, "_rt", "_rs")  # pos = risk rows
    c = running_totals(h, by, ["-score"], {"ctp": F.col("pos"), "cfp": F.col("neg")})
    prec = F.col("ctp").cast("double") / (F.col("ctp") + F.col("cfp")).cast("double")
    agg = c.groupBy(*by).agg(F.sum(F.col("pos") * prec).alias("_s"), F.sum("pos").cast("double").alias("_p"))
    ap = F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")).otherwise(F.lit(0.0))
    return agg.select(*by, ap.alias("pr_auc_risk"))


def roc_curve(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", score: str = "y_prob") -> DataFrame:
    """ROC points (fpr, tpr) per distinct threshold, descending, plus the (0, 0) start.

    Intermediate points are dropped like the common library default: a point
    is kept when the next step differs from the current step in either count.
    """
    by = list(by)
    h = score_histogram(df, by, y_true, score)
    c = running_totals(h, by, ["-score"], {"tps": F.col("pos"), "fps": F.col("neg"), "rk": F.lit(1)})
    nxt = c.select(*by, (F.col("rk") - 1).alias("rk"), F.col("pos").alias("_npos"), F.col("neg").alias("_nneg"))
    tot = h.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"), F.count(F.lit(1)).alias("_m"))
    j = join_on(null_safe_join(c, nxt, [*by, "rk"], "left"), tot, by)
    keep = (F.col("rk") == 1) | (F.col("rk") == F.col("_m")) | (F.col("_npos") != F.col("pos")) | (F.col("_nneg") != F.col("neg"))
    pts = j.filter(keep).select(
        *by,
        F.col("rk").cast("bigint").alias("rk"),
        F.col("score").alias("threshold"),
        F.when(F.col("_N") > 0, F.col("fps") / F.col("_N").cast("double")).alias("fpr"),
        F.when(F.col("_P") > 0, F.col("tps") / F.col("_P").cast("double")).alias("tpr"),
    )
    start = tot.select(*by, F.lit(0).cast("bigint").alias("rk"), F.lit(None).cast("double").alias("threshold"),
                       F.when(F.col("_N") > 0, F.lit(0.0)).alias("fpr"), F.when(F.col("_P") > 0, F.lit(0.0)).alias("tpr"))
    return start.unionByName(pts)


def pr_curve(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Precision-recall points of the risk class (score 1 - p) plus the (recall 0, precision 1) end."""
    by = list(by)
    risk = df.select(*by, (1 - F.col(y_true)).alias("_rt"), (F.lit(1.0) - F.col(score)).alias("_rs"))
    h = score_histogram(risk, by, "_rt", "_rs")
    c = running_totals(h, by, ["-score"], {"ctp": F.col("pos"), "cfp": F.col("neg"), "rk": F.lit(1)})
    tot = h.groupBy(*by).agg(F.sum("pos").alias("_P"))
    j = join_on(c, tot, by)
    pts = j.select(
        *by,
        F.col("rk").cast("bigint").alias("rk"),
        F.col("score").alias("threshold"),
        F.when(F.col("_P") > 0, F.col("ctp") / F.col("_P").cast("double")).otherwise(F.lit(1.0)).alias("recall"),
        (F.col("ctp") / (F.col("ctp") + F.col("cfp")).cast("double")).alias("precision"),
    )
    end = tot.select(*by, F.lit(0).cast("bigint").alias("rk"), F.lit(None).cast("double").alias("threshold"),
                     F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return pts.unionByName(end)


def ranking_metrics(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", score: str = "y_prob") -> DataFrame:
    """AUC-ROC and PR-AUC of the risk class from one score histogram and one running-total pass.

    Ranking risk by 1 - p descending is ranking by p ascending, so the
    cumulative counts in ascending score order serve both: the AUC needs the
    risk rows strictly below a score, the average precision the risk and pass
    rows at or below it.
    """
    by = list(by)
    h = score_histogram(df, by, y_true, score)
    c = running_totals(h, by, ["score"], {"cum_neg": F.col("neg"), "cum_pos": F.col("pos")})
    below = F.col("cum_neg") - F.col("neg")
    prec = F.col("cum_neg").cast("double") / (F.col("cum_neg") + F.col("cum_pos")).cast("double")
    agg = c.groupBy(*by).agg(
        F.sum(F.col("pos") * (below.cast("double") + F.col("neg") / F.lit(2.0))).alias("_u"),
        F.sum(F.when(F.col("neg") > 0, F.col("neg") * prec).otherwise(F.lit(0.0))).alias("_s"),
        F.sum("pos").cast("double").alias("_p"),
        F.sum("neg").cast("double").alias("_n"),
    )
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n")))
    ap = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.lit(0.0))
    return agg.select(*by, auc.alias("auc"), ap.alias("pr_auc_risk"))
