"""Search history and trial report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.functions.frames import join_on
from earlywarn.functions.ranking import running_max


def search_history(trials: DataFrame, trial: str = "trial", value: str = "value") -> DataFrame:
    """Each trial with the best value so far (trial order)."""
    return running_max(trials, [], [trial], value, "best_so_far")


def best_trial(trials: DataFrame, trial: str = "trial", value: str = "value") -> DataFrame:
    """The best trial (first on ties)."""
    return trials.agg(F.min_by(F.struct(*[F.col(c) for c in trials.columns]), F.struct((-F.col(value)).alias("a"), F.col(trial).alias("b"))).alias("r")).select("r.*")


def parameter_importance(trials: DataFrame, params: dict[str, str], bins: int = 5, value: str = "value") -> DataFrame:
    """M21, re-aimed from fANOVA: share of the score variance explained by each
    parameter's bins (between-bin sum of squares / total sum of squares).

    ``params`` maps a column to 'log' (equal-width bins of log10), 'linear'
    (equal-width bins) or 'choice' (one bin per value).
    """
    parts = []
    for p, kind in params.items():
        x = F.log10(F.col(p)) if kind == "log" else F.col(p).cast("double")
        d = trials.select(x.alias("_x"), F.col(value).alias("_v"))
        if kind == "choice":
            binned = d.withColumn("_b", F.col("_x").cast("string"))
        else:
            r = d.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
            j = join_on(d, r, [])
            w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
            b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_lo")) / w).cast("int")))
            binned = j.withColumn("_b", b.cast("string"))
        tot = binned.agg(F.avg("_v").alias("_m"))
        bb = join_on(binned, tot, [])
        per_bin = bb.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_bm"), F.first("_m").alias("_m"))
        between = per_bin.agg(F.sum(F.col("_n") * F.pow(F.col("_bm") - F.col("_m"), 2)).alias("_ssb"))
        total = bb.agg(F.sum(F.pow(F.col("_v") - F.col("_m"), 2)).alias("_sst"))
        parts.append(join_on(between, total, []).select(F.lit(p).alias("parameter"),
                                                         F.when(F.col("_sst") > 0, F.col("_ssb") / F.col("_sst")).otherwise(F.lit(0.0)).alias("importance")))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out
