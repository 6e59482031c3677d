"""Calibration curve with quantile bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.functions.frames import join_group_stats
from earlywarn.functions.ranking import exact_quantiles


FIXED = 2.0**53


def _fixed(p):
    """A score as a whole number of 2^-53: such sums do not depend on the order of the rows."""
    return F.round(p.cast("double") * F.lit(FIXED)).cast("decimal(38,0)")


def calibration(df: DataFrame, n_bins: int = 8, by: Sequence[str] = (), y_true: str = "y_true", prob: str = "y_prob") -> DataFrame:
    """Bin edges are exact linear-interpolated quantiles of the predictions;
    a row's bin is the number of inner edges strictly below it; empty bins
    are absent.  Returns (by..., bin, n, prob_true, prob_pred)."""
    by = list(by)
    qs = [i / n_bins for i in range(1, n_bins)]
    q = exact_quantiles(df.select(*by, prob), by, prob, qs)
    edges = q.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("q_index", "value"))).alias("_e"))
    edges = edges.select(*by, F.transform("_e", lambda s: s["value"]).alias("_edges"))
    # bin the distinct scores, not the rows
    hist = df.groupBy(*by, prob).agg(
        F.count(F.lit(1)).alias("_n"), F.count(y_true).alias("_ny"), F.sum(F.col(y_true).cast("double")).alias("_y"))
    j = join_group_stats(hist, edges, by)
    binned = j.withColumn("bin", F.size(F.filter("_edges", lambda e: e < F.col(prob))))
    return binned.groupBy(*by, "bin").agg(
        F.sum("_n").alias("n"),
        F.try_divide(F.sum("_y"), F.sum("_ny")).alias("prob_true"),
        F.try_divide(F.sum(_fixed(F.col(prob)) * F.col("_n")).cast("double") / F.lit(FIXED),
                     F.sum(F.when(F.col(prob).isNotNull(), F.col("_n")))).alias("prob_pred"),
    )
