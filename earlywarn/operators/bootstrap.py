"""Bootstrap confidence intervals (A20, J7), re-aimed as a Poisson bootstrap.

Resampling rows by position needs the whole table in one place.  The Poisson
bootstrap gives each (row, iteration) an independent Poisson(1) weight drawn
from an integer hash of (seed, iteration, row id), so any task can draw the
weights of its own rows for every iteration; rows move through one shuffle
(into score slices) and only per-(slice, iteration) totals move after it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.functions import metrics as M
from earlywarn.functions.frames import null_safe_join
from earlywarn.functions.hashing import GOLDEN, MASK32, MIX_MUL, TWO_POW_32, with_key_hash
from earlywarn.functions.ranking import bounds_below
from earlywarn.operators.evaluate import metrics_at


def poisson_cutoffs(k_max: int = 6) -> list[float]:
    """CDF of Poisson(1) at 0..k_max: e^-1 * sum_{i<=k} 1/i!."""
    out, acc = [], 0.0
    for k in range(k_max + 1):
        acc += 1.0 / math.factorial(k)
        out.append(math.exp(-1.0) * acc)
    return out


def poisson_weight(u: Column) -> Column:
    """Inverse-CDF draw of Poisson(1) from a uniform in [0, 1); the tail maps to 7."""
    w = F.lit(0)
    for c in poisson_cutoffs():
        w = w + (u >= F.lit(c)).cast("int")
    return w


SLICE_ROWS = 1 << 18  # rows of a score slice, on average, at most: a task holds one

TRACKED = ("macro_f1", "bal_acc", "risk_recall", "f1_risk", "auc", "mcc")


def _np_mix(x):
    import numpy as np

    m = np.uint64(MASK32)
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX_MUL)) & m
    return x ^ (x >> np.uint64(16))


def _slice_stats_fn(by: list[str], iterations: int, seed: int, t: float, cutoffs: list[float], chunk_cells: int = 4_000_000):
    """Per (group, slice, part): for every iteration the weighted pass / risk
    totals, the totals at or above ``t`` and the within-part Mann-Whitney sum."""
    import numpy as np

    b_all = np.arange(1, iterations + 1, dtype=np.uint64)
    states = ((b_all + np.uint64(int(seed) * iterations)) * np.uint64(GOLDEN)) & np.uint64(MASK32)
    cut = np.asarray(cutoffs, dtype=np.float64)

    def fn(pdf):
        import pandas as pd

        pdf = pdf.sort_values("_p", kind="stable")
        p = pdf["_p"].to_numpy(dtype=np.float64)
        y = pdf["_y"].to_numpy(dtype=np.float64)
        kh = pdf["_kh"].to_numpy(dtype=np.int64).astype(np.uint64)
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        above = p >= t
        m = len(p)
        step = max(1, chunk_cells // max(1, m))
        out = {k: np.empty(iterations) for k in ("pos", "neg", "pos_above", "neg_above", "u_in")}
        for lo in range(0, iterations, step):
            st = states[lo:lo + step]
            x = _np_mix(st[None, :] ^ kh[:, None])
            u = x.astype(np.float64) / TWO_POW_32
            w = np.searchsorted(cut, u, side="right").astype(np.float64)  # cutoffs at or below u
            pw, nw = w * y[:, None], w * (1.0 - y[:, None])
            POS, NEG = np.add.reduceat(pw, starts, axis=0), np.add.reduceat(nw, starts, axis=0)
            below = np.cumsum(NEG, axis=0) - NEG
            sl = slice(lo, lo + len(st))
            out["u_in"][sl] = (POS * (below + NEG / 2.0)).sum(axis=0)
            out["pos"][sl], out["neg"][sl] = POS.sum(axis=0), NEG.sum(axis=0)
            out["pos_above"][sl], out["neg_above"][sl] = pw[above].sum(axis=0), nw[above].sum(axis=0)
        res = pd.DataFrame({"b": np.arange(1, iterations + 1, dtype=np.int64), **out})
        first = pdf.iloc[0]
        for c in [*by, "_slice", "_point"]:
            res[c] = first[c]
        return res[[*by, "_slice", "_point", "b", "pos", "neg", "pos_above", "neg_above", "u_in"]]

    return fn


def bootstrap_ci(df: DataFrame, t: float = 0.5, iterations: int = 500, by: Sequence[str] = (), seed: int = 42,
                 key: str = "row_id", y_true: str = "y_true", prob: str = "y_prob", slices: int | None = None) -> DataFrame:
    """(by..., metric, position, estimate, ci_lower, ci_upper) for the six tracked metrics.

    Every row is shuffled once, into a slice of the score order (approximate
    quantile bounds computed in the plan).  A task holds one slice and draws
    the weights of all iterations for its rows with numpy (the same integer
    hash as the SQL twin), so what leaves it is one row per iteration: the
    weighted class totals, the totals at or above ``t`` and the within-slice
    Mann-Whitney sum.  A score equal to a bound - where a heavy value lands -
    gets its own point slice, split by key hash into as many parts as
    quantile probes landed on it, so a score shared by a third of the rows
    is spread over about S/3 tasks; within a point
    slice every pair is a tie, worth half the product of the totals.  Across
    slices the AUC adds pass totals times the risk totals of lower slices.
    Resamples with one class are skipped; the interval is the 2.5 / 97.5
    percentile (linear interpolation) of the remaining iterations.
    """
    by = list(by)
    spark = df.sparkSession
    base = with_key_hash(df.select(*by, key, F.col(y_true).cast("int").alias("_y"), F.col(prob).cast("double").alias("_p")), key, "_kh")
    # enough slices for the shuffle, and none of more than SLICE_ROWS rows on average
    S = slices or max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-base.count() // SLICE_ROWS))
    probs = [i / S for i in range(1, S)]
    raw = F.array_sort(F.percentile_approx("_p", probs, 4 * S))
    bounds = base.select(raw.alias("_raw")).withColumn("_bounds", F.array_distinct("_raw"))
    # a value met by j quantile probes holds about j/S of the rows: split its point slice j ways
    below = lambda c, x, eq: bounds_below(c, F.col(x), eq)
    probes = below("_raw", "_p", True) - below("_raw", "_p", False)
    tagged = (
        base.crossJoin(F.broadcast(bounds))  # one row
        .withColumn("_low", below("_bounds", "_p", False))
        .withColumn("_point", F.coalesce(F.get("_bounds", F.col("_low")) == F.col("_p"), F.lit(False)))
        .withColumn("_slice", F.lit(2) * F.col("_low") + F.col("_point").cast("int"))
        .withColumn("_part", F.when(F.col("_point"), F.pmod(F.col("_kh"), F.greatest(F.lit(1), probes).cast("long"))).otherwise(F.lit(0)))
        .drop("_bounds", "_raw", "_low")
    )
    by_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in by)
    schema = (by_schema + ", " if by_schema else "") + \
        "_slice int, _point boolean, b long, pos double, neg double, pos_above double, neg_above double, u_in double"
    stats = tagged.groupBy(*by, "_slice", "_part").applyInPandas(
        _slice_stats_fn(by, iterations, seed, float(t), poisson_cutoffs()), schema)
    g = stats.groupBy(*by, "_slice", "b").agg(
        *[F.sum(c).alias(c) for c in ("pos", "neg", "pos_above", "neg_above", "u_in")], F.max("_point").alias("_point"))
    w = Window.partitionBy(*by, "b").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_neg_below", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
    u_slice = F.when(F.col("_point"), F.col("pos") * F.col("neg") / F.lit(2.0)).otherwise(F.col("u_in"))
    cm = g.groupBy(*by, "b").agg(
        F.sum(u_slice + F.col("pos") * F.col("_neg_below")).alias("_u"),
        F.sum("pos").alias("_P"), F.sum("neg").alias("_N"),
        F.sum("pos_above").alias("tp"), F.sum("neg_above").alias("fp"),
    ).withColumn("fn", F.col("_P") - F.col("tp")).withColumn("tn", F.col("_N") - F.col("fp"))
    cm = cm.filter((F.col("_N") > 0) & (F.col("_P") > 0))
    per_b = cm.select(*by, "b", *[M.CONFUSION_METRICS[m]().alias(m) for m in TRACKED if m != "auc"],
                      (F.col("_u") / (F.col("_P") * F.col("_N"))).alias("auc"))
    long = per_b.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in TRACKED])))
    ci = long.groupBy(*by, "metric").agg(F.percentile(F.col("v"), F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"))
    est = metrics_at(df, t, by, y_true, prob)
    est_long = est.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("estimate")) for m in TRACKED])))
    order = F.array(*[F.lit(m) for m in TRACKED])
    return null_safe_join(est_long, ci, [*by, "metric"], "left").select(
        *by, "metric", (F.array_position(order, F.col("metric"))).cast("int").alias("position"), "estimate",
        F.col("_ci")[0].alias("ci_lower"), F.col("_ci")[1].alias("ci_upper"),
    )
