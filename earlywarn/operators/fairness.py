"""Subgroup diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.functions import metrics as M

# The reference's age bands (edges 14, 16, 18, 20, 30; the
# first band closed on the left) and their labels.
AGE_EDGES = (14, 16, 18, 20, 30)
AGE_LABELS = ("15–16", "17–18", "19–20", "21+")


def band_expr(x: Column, edges: Sequence[float] = AGE_EDGES, labels: Sequence[str] = AGE_LABELS,
              include_lowest: bool = True, missing: str = "nan") -> Column:
    """Right-closed bins (a, b]; the first bin also holds its left edge."""
    v = x.cast("double")
    expr = None
    for i, (lo, hi, lab) in enumerate(zip(edges[:-1], edges[1:], labels)):
        cond = ((v >= lo) if (i == 0 and include_lowest) else (v > lo)) & (v <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(missing))


def band(df: DataFrame, col: str, edges: Sequence[float] = AGE_EDGES, labels: Sequence[str] = AGE_LABELS,
         out: str = "grp", include_lowest: bool = True) -> DataFrame:
    return df.withColumn(out, band_expr(F.col(col), edges, labels, include_lowest))


def group_text(col: str) -> Column:
    """Any group column as text; a null group becomes 'nan'."""
    return F.coalesce(F.col(col).cast("string"), F.lit("nan"))


def subgroup_metrics(df: DataFrame, group: str, t: float = 0.5, min_n: int = 10, by: Sequence[str] = (),
                     y_true: str = "y_true", prob: str = "y_prob") -> DataFrame:
    """Per group N, actual/predicted risk rate, risk recall and precision,
    F1-Risk, Macro-F1, missed-risk and false-alarm rate; groups below
    ``min_n`` dropped; rates null on a zero denominator (F1s 0).

    One partial aggregation: a hot group is combined map-side, so skew costs
    one extra row per task, not a straggler.
    """
    by = list(by)
    pred = (F.col(prob) >= F.lit(float(t))).cast("int")
    d = df.select(*by, group_text(group).alias("grp"), F.col(y_true).alias("_yt"), pred.alias("_yp"))
    cm = d.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("n"), *M.counts_from(F.col("_yt"), F.col("_yp")))
    cm = cm.filter(F.col("n") >= min_n)
    n = F.col("n").cast("double")
    return cm.select(
        *by,
        "grp",
        "n",
        ((F.col("tn") + F.col("fp")) / n).alias("actual_risk_rate"),
        ((F.col("tn") + F.col("fn")) / n).alias("predicted_risk_rate"),
        M.risk_recall(strict=True).alias("risk_recall"),
        M.precision_risk(strict=True).alias("risk_precision"),
        M.f1_risk().alias("f1_risk"),
        M.macro_f1().alias("macro_f1"),
        M.missed_risk_rate(strict=True).alias("missed_risk_rate"),
        M.false_alarm_rate(strict=True).alias("false_alarm_rate"),
    )


def disparity(sub: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Spread (max - min) of one metric over groups, its level
    (>= 0.15 material, >= 0.08 moderate, else small), group count and the
    largest (reference) group, ties to the smaller name."""
    by = list(by)
    agg = sub.groupBy(*by).agg(
        (F.max(metric) - F.min(metric)).alias("spread"),
        F.count(F.lit(1)).alias("groups"),
        F.min_by("grp", F.struct((-F.col("n")).alias("a"), F.col("grp").alias("b"))).alias("reference_group"),
    )
    level = F.when(F.col("spread") >= 0.15, "material").when(F.col("spread") >= 0.08, "moderate").otherwise("small")
    return agg.select(*by, F.lit(metric).alias("metric"), "spread", level.alias("level"), "groups", "reference_group")


def reference_group(sub: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The largest group (ties to the smaller name)."""
    return sub.groupBy(*by).agg(F.min_by("grp", F.struct((-F.col("n")).alias("a"), F.col("grp").alias("b"))).alias("reference_group"),
                                F.max("n").alias("n"))
