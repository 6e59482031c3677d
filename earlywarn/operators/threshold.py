"""Threshold-cost analysis.

Instead of pairing every row with every grid threshold, each row is placed in
the grid bucket ``k`` = number of thresholds it clears; counts per
(group, k, label) are tiny, and the counts at threshold ``i`` are the sums
over ``k >= i``.  Grid thresholds are ``i / steps`` (i = 1 .. steps-1).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.functions import metrics as M
from earlywarn.functions.frames import null_safe_join


def grid_bucket(p: Column, steps: int = 20) -> Column:
    """Largest i in [0, steps-1] with i/steps <= p (exact on the double grid)."""
    k1 = F.least(F.lit(steps - 1), F.greatest(F.lit(0), F.floor(p * F.lit(float(steps))).cast("int")))
    up = ((k1 < steps - 1) & ((k1 + 1) / F.lit(float(steps)) <= p)).cast("int")
    down = ((k1 >= 1) & (k1 / F.lit(float(steps)) > p)).cast("int")
    return k1 + up - down


def threshold_cost(df: DataFrame, c_miss: float = 5.0, c_alarm: float = 1.0, steps: int = 20, by: Sequence[str] = (),
                   y_true: str = "y_true", prob: str = "y_prob") -> DataFrame:
    """Per grid threshold the missed-risk cases, false alarms, weighted
    cost ``missed * c_miss + alarms * c_alarm``, cost per row, Macro-F1 and risk recall."""
    by = list(by)
    b = df.select(*by, grid_bucket(F.col(prob), steps).alias("k"), F.col(y_true).alias("_y"))
    cnt = b.groupBy(*by, "k").agg(F.sum("_y").cast("bigint").alias("pos"), F.sum(1 - F.col("_y")).cast("bigint").alias("neg"))
    tot = cnt.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    keys = tot.select(*by, "P", "N")
    grid = keys.select(*by, "P", "N", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))).alias("i"))
    # counts at or above each bucket: a window over at most `steps` rows per group
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    above = cnt.select(*by, "k", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"))
    j = null_safe_join(grid, above.withColumnRenamed("k", "i"), [*by, "i"], "left")
    # buckets without rows take the counts of the next non-empty bucket above
    w2 = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    j = j.select(*by, "i", "P", "N",
                 F.coalesce(F.first("tp", ignorenulls=True).over(w2), F.lit(0)).alias("tp"),
                 F.coalesce(F.first("fp", ignorenulls=True).over(w2), F.lit(0)).alias("fp"))
    j = j.withColumn("tn", F.col("N") - F.col("fp")).withColumn("fn", F.col("P") - F.col("tp"))
    cost = F.col("fp") * F.lit(float(c_miss)) + F.col("fn") * F.lit(float(c_alarm))
    return j.select(
        *by,
        (F.col("i") / F.lit(float(steps))).alias("threshold"),
        F.col("fp").cast("bigint").alias("missed_risk_cases"),
        F.col("fn").cast("bigint").alias("false_alarms"),
        cost.alias("weighted_cost"),
        (cost / (F.col("P") + F.col("N")).cast("double")).alias("cost_per_student"),
        M.macro_f1().alias("macro_f1"),
        M.risk_recall().alias("risk_recall"),
    )


def recommend_threshold(cost: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The cheapest threshold, the lowest one on ties."""
    by = list(by)
    best = F.min_by(F.struct("threshold", "weighted_cost", "risk_recall", "missed_risk_cases", "false_alarms"),
                    F.struct("weighted_cost", "threshold"))
    return cost.groupBy(*by).agg(best.alias("r")).select(*by, "r.*")


