"""Significance and claims over the fold-score table F4."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from earlywarn.operators import stats as st
from earlywarn.plans.catalog import query
from earlywarn.plans.oracle_sql import OOF, counts_sql, metric_sql, r6, with_ctes
from earlywarn.sources import fixtures as fx

FS = with_ctes(OOF, f"""
fs AS (SELECT model, model_order, fold, {metric_sql('macro_f1')} AS score
       FROM (SELECT model, model_order, fold, {counts_sql()} FROM oof GROUP BY model, model_order, fold) c)""")

PAIRS = """,
pairs AS (SELECT a.model AS model_a, b.model AS model_b, a.model_order AS order_a, b.model_order AS order_b, a.fold,
                 a.score AS score_a, b.score AS score_b, a.score - b.score AS diff
          FROM fs a JOIN fs b ON a.fold = b.fold AND a.model_order < b.model_order)"""

K = "model_a, model_b, order_a, order_b"

RANKS = PAIRS + f""",
nz AS (SELECT *, abs(diff) AS absd FROM pairs WHERE abs(diff) > {st.ZERO_TOL!r}),
rk AS (SELECT *, rank() OVER (PARTITION BY {K} ORDER BY absd) + (count(*) OVER (PARTITION BY {K}, absd) - 1) / 2e0 AS rank FROM nz)"""

WILCOXON = RANKS + f""",
per AS (SELECT {K}, count(*) AS n, sum(CASE WHEN diff > 0 THEN rank ELSE 0e0 END) AS w_plus,
               sum(CASE WHEN diff < 0 THEN rank ELSE 0e0 END) AS w_minus, list(rank ORDER BY rank) AS ranks
        FROM rk GROUP BY {K}),
ex AS (SELECT {K}, n, least(w_plus, w_minus) AS stat, ranks, unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS mask FROM per WHERE n <= {st.EXACT_MAX_N}),
exw AS (SELECT {K}, stat, list_sum(list_transform(range(0, n), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN ranks[i + 1] ELSE 0e0 END)) AS wp FROM ex),
exact AS (SELECT {K}, least(1e0, 2e0 * avg(CAST(wp <= stat + 1e-9 AS DOUBLE))) AS p FROM exw GROUP BY {K}),
base AS (SELECT {K}, avg(diff) AS mean_difference FROM pairs GROUP BY {K}),
wx AS (SELECT b.model_a, b.model_b, b.order_a, b.order_b, b.mean_difference,
              CASE WHEN COALESCE(p.n, 0) = 0 THEN 0e0 ELSE least(p.w_plus, p.w_minus) END AS statistic,
              CASE WHEN COALESCE(p.n, 0) = 0 THEN 1e0 ELSE e.p END AS p_value
       FROM base b LEFT JOIN per p USING ({K}) LEFT JOIN exact e USING ({K}))"""


def _fs(spark, d):
    return fx.fold_scores(spark, d)


@query("fold_scores", r6(FS + "SELECT * FROM fs", "score"))
def fold_scores(spark, d):
    """Macro-F1 per model and outer fold."""
    return _fs(spark, d)


@query("paired_scores", r6(FS + PAIRS + " SELECT * FROM pairs", "score_a", "score_b", "diff"))
def paired_scores(spark, d):
    """All unordered model pairs matched by fold."""
    return st.paired_scores(_fs(spark, d))


@query("paired_table", r6(FS + PAIRS + """ SELECT fold + 1 AS outer_fold, score_a, score_b, diff AS difference FROM pairs
  WHERE model_a = 'alpha' AND model_b = 'beta'""", "score_a", "score_b", "difference"))
def paired_table(spark, d):
    """Alpha vs beta per fold."""
    return st.paired_table(_fs(spark, d), "alpha", "beta")


@query("signed_ranks", r6(FS + RANKS + f" SELECT {K}, fold, diff, absd, rank FROM rk", "diff", "absd", "rank"))
def signed_ranks(spark, d):
    """Average ranks of |difference| per pair."""
    return st.signed_ranks(st.paired_scores(_fs(spark, d))).select(*st.PAIR, "fold", "diff", "absd", "rank")


@query("wilcoxon_pairs", r6(FS + WILCOXON + " SELECT * FROM wx", "mean_difference", "statistic", "p_value"))
def wilcoxon_pairs(spark, d):
    """H1: Wilcoxon signed-rank per pair (exact p for n <= 12)."""
    return st.wilcoxon_pairs(st.paired_scores(_fs(spark, d)))


_HOLM = FS + WILCOXON + f""",
h AS (SELECT *, row_number() OVER (ORDER BY p_value, order_a, order_b) - 1 AS rk, count(*) OVER () AS m FROM wx)
SELECT {K}, mean_difference, statistic, p_value,
  max(least(1e0, (m - rk) * p_value)) OVER (ORDER BY p_value, order_a, order_b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS holm_p,
  max(least(1e0, (m - rk) * p_value)) OVER (ORDER BY p_value, order_a, order_b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 0.05e0 AS significant
FROM h"""


@query("holm", r6(_HOLM, "mean_difference", "statistic", "p_value", "holm_p"))
def holm(spark, d):
    """Holm step-down over the pairwise p-values."""
    return st.holm(st.wilcoxon_pairs(st.paired_scores(_fs(spark, d))))


@query("block_ranks", r6(FS + """ SELECT model, model_order, fold, score,
  rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2e0 AS rank FROM fs""",
                         "score", "rank"))
def block_ranks(spark, d):
    """Ranks of models within each fold."""
    return st.block_ranks(_fs(spark, d))


def chi2_sf_sql(x: str, df: int) -> str:
    assert df % 2 == 0, "oracle written for even degrees of freedom"
    terms = []
    for i in range(df // 2):
        terms.append(f"pow({x} / 2e0, {i}) / {math.factorial(i)}e0")
    return f"exp(-({x}) / 2e0) * ({' + '.join(terms)})"


_FRIED = FS + """,
r AS (SELECT model, fold, score, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2e0 AS rank FROM fs),
ties AS (SELECT sum(CAST(t AS DOUBLE) * (t * t - 1)) AS ties FROM (SELECT fold, score, count(*) AS t FROM fs GROUP BY fold, score) x),
rs AS (SELECT model, sum(rank) AS R FROM r GROUP BY model),
ss AS (SELECT sum(R * R) AS ss, count(*) AS k FROM rs),
nb AS (SELECT count(DISTINCT fold) AS n FROM fs),
s AS (SELECT k, n, (12e0 / (k * n * (k + 1)) * ss - 3 * n * (k + 1)) / (1e0 - ties / (CAST(k AS DOUBLE) * (k * k - 1) * n)) AS statistic
      FROM ss, nb, ties)
SELECT k, n, statistic, """ + chi2_sf_sql("statistic", 2) + " AS p_value FROM s"


@query("friedman", r6(_FRIED, "statistic", "p_value"))
def friedman(spark, d):
    """H3: tie-corrected Friedman test over 3 models x 5 folds (df = 2)."""
    return st.friedman(_fs(spark, d))


@query("friedman_ties", FS + "SELECT count(DISTINCT model) AS k, count(DISTINCT fold) AS n, 0e0 AS statistic, 1e0 AS p_value FROM fs")
def friedman_ties(spark, d):
    """H3 where no model differs from another: statistic 0, p 1."""
    return st.friedman(_fs(spark, d).withColumn("score", F.lit(0.5)))


@query("paired_test", r6(FS + WILCOXON + """ SELECT 'beta' AS model_a, 'alpha' AS model_b, statistic, p_value,
  -mean_difference AS mean_difference, p_value < 0.05e0 AS significant FROM wx WHERE model_a = 'alpha' AND model_b = 'beta'""",
                         "statistic", "p_value", "mean_difference"))
def paired_test(spark, d):
    """H4: one chosen pair, oriented (beta, alpha)."""
    return st.paired_test(st.wilcoxon_pairs(st.paired_scores(_fs(spark, d))), "beta", "alpha")
