"""Paired significance tests on fold scores.

Input is the long fold-score table ``(exp..., model, model_order, fold, score)``.
Wilcoxon p-values are exact for n <= 50 non-zero differences, by counting the
sign patterns of every rank sum (a fold over the doubled ranks); beyond that
the normal approximation with tie correction is used, as the library does.  The chi-square tail of the
Friedman test is closed form for even degrees of freedom and uses erfc for
odd ones.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.functions.frames import join_on

EXACT_MAX_N = 50
ZERO_TOL = 1e-8  # |difference| treated as zero (close-to-zero test)


def paired_scores(fs: DataFrame, exp: Sequence[str] = ()) -> DataFrame:
    """Every unordered model pair (list order) matched by fold: a, b, fold, score_a, score_b, diff."""
    exp = list(exp)
    a = fs.select(*exp, "fold", F.col("model").alias("model_a"), F.col("model_order").alias("order_a"), F.col("score").alias("score_a"))
    b = fs.select(*exp, "fold", F.col("model").alias("model_b"), F.col("model_order").alias("order_b"), F.col("score").alias("score_b"))
    j = a.join(b, on=[*exp, "fold"], how="inner").filter(F.col("order_a") < F.col("order_b"))
    return j.withColumn("diff", F.col("score_a") - F.col("score_b"))


def paired_table(fs: DataFrame, model_a: str, model_b: str, exp: Sequence[str] = ()) -> DataFrame:
    """Fold, A, B and A - B for one chosen pair (1-based fold)."""
    p = paired_scores(fs.filter(F.col("model").isin(model_a, model_b)), exp)
    sign = F.when(F.col("model_a") == model_a, F.lit(1.0)).otherwise(F.lit(-1.0))
    return p.select(*exp, (F.col("fold") + 1).alias("outer_fold"),
                    F.when(F.col("model_a") == model_a, F.col("score_a")).otherwise(F.col("score_b")).alias("score_a"),
                    F.when(F.col("model_a") == model_a, F.col("score_b")).otherwise(F.col("score_a")).alias("score_b"),
                    (sign * F.col("diff")).alias("difference"))


PAIR = ["model_a", "model_b", "order_a", "order_b"]


def signed_ranks(paired: DataFrame, exp: Sequence[str] = ()) -> DataFrame:
    """Average ranks of |diff| among the non-zero differences of each pair."""
    keys = [*exp, *PAIR]
    nz = paired.filter(F.abs("diff") > ZERO_TOL).withColumn("absd", F.abs("diff"))
    w = Window.partitionBy(*keys).orderBy("absd")
    tie = Window.partitionBy(*keys, "absd")
    return nz.withColumn("rank", F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / F.lit(2.0))


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal via erfc (Chebyshev fit, |rel err| < 1.2e-7)."""
    x = z / F.lit(math.sqrt(2.0))
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * ax)
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = poly * t + F.lit(c)
    erfc_ax = t * F.exp(-ax * ax + poly)
    erfc_x = F.when(x >= 0, erfc_ax).otherwise(F.lit(2.0) - erfc_ax)
    return erfc_x / F.lit(2.0)


def wilcoxon_pairs(paired: DataFrame, exp: Sequence[str] = ()) -> DataFrame:
    """H1: per pair the mean difference, statistic min(W+, W-) and two-sided p.
    All differences ~ 0 gives (0, 1)."""
    exp = list(exp)
    keys = [*exp, *PAIR]
    base = paired.groupBy(*keys).agg(F.avg("diff").alias("mean_difference"))
    r = signed_ranks(paired, exp)
    per = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("diff") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("diff") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"),
        F.sort_array(F.collect_list("rank")).alias("ranks"),  # at most n folds per pair
        F.sum(F.lit(0.0)).alias("_z"),
    )
    tie = r.groupBy(*keys, "absd").agg(F.count(F.lit(1)).alias("t")).groupBy(*keys).agg(
        F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("tie_term"))
    per = per.join(tie, on=keys, how="left").withColumn("stat", F.least("w_plus", "w_minus"))
    # exact: patterns by their sum of doubled ranks, which are whole numbers also with ties
    doubled = F.transform("ranks", lambda x: (x * 2).cast("int"))
    sums = F.transform(F.sequence(F.lit(0), (F.col("n") * (F.col("n") + 1)).cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(doubled, sums, lambda acc, r: F.transform(
        acc, lambda v, i: v + F.when(i >= r, F.element_at(acc, F.greatest(i - r, F.lit(0)) + 1)).otherwise(0.0)))
    upto = F.floor(F.col("stat") * 2 + F.lit(1e-9)).cast("int") + 1
    below = F.aggregate(F.slice(counts, F.lit(1), upto), F.lit(0.0), lambda acc, x: acc + x)
    exact = per.filter(F.col("n") <= EXACT_MAX_N).select(*keys, (below / F.pow(F.lit(2.0), F.col("n"))).alias("_cdf"))
    exact = exact.select(*keys, F.least(F.lit(1.0), F.lit(2.0) * F.col("_cdf")).alias("_p_exact"))
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tie_term") / 48.0
    z = (F.col("stat") - mean) / F.sqrt(var)
    approx = per.select(*keys, "n", "stat", F.when(var > 0, F.least(F.lit(1.0), F.lit(2.0) * normal_sf(F.abs(z)))).otherwise(F.lit(1.0)).alias("_p_norm"))
    res = base.join(approx, on=keys, how="left").join(exact, on=keys, how="left")
    nz = F.coalesce(F.col("n"), F.lit(0))
    return res.select(
        *keys, "mean_difference",
        F.when(nz == 0, F.lit(0.0)).otherwise(F.col("stat")).alias("statistic"),
        F.when(nz == 0, F.lit(1.0)).when(nz <= EXACT_MAX_N, F.col("_p_exact")).otherwise(F.col("_p_norm")).alias("p_value"),
    )


def holm(df: DataFrame, p_col: str = "p_value", order: Sequence[str] = ("order_a", "order_b"), exp: Sequence[str] = ()) -> DataFrame:
    """Holm step-down adjusted p (running max of min((m - rank) p, 1)) and the 0.05 flag."""
    exp = list(exp)
    part = Window.partitionBy(*exp) if exp else Window.partitionBy(F.lit(0))
    w = part.orderBy(F.col(p_col), *order)
    d = df.withColumn("_rk", F.row_number().over(w) - 1).withColumn("_m", F.count(F.lit(1)).over(part))
    d = d.withColumn("_c", F.least(F.lit(1.0), (F.col("_m") - F.col("_rk")) * F.col(p_col)))
    d = d.withColumn("holm_p", F.max("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("significant", F.col("holm_p") < F.lit(0.05)).drop("_rk", "_m", "_c")


def block_ranks(fs: DataFrame, exp: Sequence[str] = ()) -> DataFrame:
    """Average rank of each model's score within its fold (ascending)."""
    exp = list(exp)
    w = Window.partitionBy(*exp, "fold").orderBy("score")
    tie = Window.partitionBy(*exp, "fold", "score")
    return fs.withColumn("rank", F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / F.lit(2.0))


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of chi-square with integer ``df`` degrees of freedom (closed form)."""
    h = x / F.lit(2.0)
    if df % 2 == 0:
        s, term = F.lit(0.0), F.lit(1.0)
        for i in range(df // 2):
            if i > 0:
                term = term * h / F.lit(float(i))
            s = s + term
        return F.exp(-h) * s
    # odd df: 2 * Q_normal(sqrt(x)) + e^{-x/2} * sum_{i=1}^{(df-1)/2} x^{i-1/2} / (1*3*...*(2i-1)) * sqrt(2/pi)
    s = F.lit(2.0) * normal_sf(F.sqrt(x))
    acc = F.lit(0.0)
    term = F.sqrt(x) * F.lit(math.sqrt(2.0 / math.pi))
    for i in range(1, (df - 1) // 2 + 1):
        if i > 1:
            term = term * x / F.lit(float(2 * i - 1))
        acc = acc + term
    return s + F.exp(-h) * acc


def chi2_sf_by(x: Column, df: Column) -> Column:
    """``chi2_sf`` with the degrees of freedom (1 or more) of a column: the same sums, term by term."""
    h = x / F.lit(2.0)
    odd = df % 2 == 1
    m = F.when(odd, (df - 1) / 2).otherwise(df / 2 - 1).cast("int")  # terms after the first of either sum
    places = F.when(m >= 1, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    state = lambda acc, term: F.struct(acc.alias("acc"), term.alias("term"))

    def even_step(s, i):
        term = s["term"] * h / i.cast("double")
        return state(s["acc"] + term, term)

    def odd_step(s, i):
        term = F.when(i == 1, s["term"]).otherwise(s["term"] * x / (2 * i - 1).cast("double"))
        return state(s["acc"] + term, term)

    even = F.exp(-h) * F.aggregate(places, state(F.lit(1.0), F.lit(1.0)), even_step, lambda s: s["acc"])
    first = F.sqrt(x) * F.lit(math.sqrt(2.0 / math.pi))
    tail = F.aggregate(places, state(F.lit(0.0), first), odd_step, lambda s: s["acc"])
    return F.when(odd, F.lit(2.0) * normal_sf(F.sqrt(x)) + F.exp(-h) * tail).otherwise(even)


def friedman(fs: DataFrame, exp: Sequence[str] = ()) -> DataFrame:
    """H3: tie-corrected Friedman statistic over folds (blocks) and models; p with
    df = k - 1 for the k models counted in the experiment (null for a single one)."""
    exp = list(exp)
    r = block_ranks(fs, exp)
    ties = r.groupBy(*exp, "fold", "score").agg(F.count(F.lit(1)).alias("t")).groupBy(*exp).agg(
        F.sum(F.col("t") * (F.col("t") * F.col("t") - 1)).cast("double").alias("_ties"))
    rs = r.groupBy(*exp, "model").agg(F.sum("rank").alias("R"))
    ss = rs.groupBy(*exp).agg(F.sum(F.col("R") * F.col("R")).alias("_ss"), F.count(F.lit(1)).alias("k"))
    nb = fs.groupBy(*exp).agg(F.countDistinct("fold").alias("n"))
    j = join_on(join_on(ss, nb, exp), ties, exp)
    kk, n = F.col("k").cast("double"), F.col("n").cast("double")
    c = F.lit(1.0) - F.try_divide(F.col("_ties"), kk * (kk * kk - 1) * n)
    # without any difference between the models the statistic is 0 (p = 1)
    stat = F.coalesce(F.try_divide(F.lit(12.0) / (kk * n * (kk + 1)) * F.col("_ss") - 3 * n * (kk + 1), c), F.lit(0.0))
    return j.select(*exp, "k", "n", stat.alias("statistic")).withColumn(
        "p_value", F.when(F.col("k") > 1, chi2_sf_by(F.col("statistic"), F.col("k") - 1)))


def paired_test(wilcoxon: DataFrame, model_a: str, model_b: str, exp: Sequence[str] = ()) -> DataFrame:
    """H4: the Wilcoxon row of one chosen pair, oriented as (A, B)."""
    fwd = (F.col("model_a") == model_a) & (F.col("model_b") == model_b)
    rev = (F.col("model_a") == model_b) & (F.col("model_b") == model_a)
    return wilcoxon.filter(fwd | rev).select(
        *exp, F.lit(model_a).alias("model_a"), F.lit(model_b).alias("model_b"), "statistic", "p_value",
        F.when(fwd, F.col("mean_difference")).otherwise(-F.col("mean_difference")).alias("mean_difference"),
        (F.col("p_value") < 0.05).alias("significant"))
