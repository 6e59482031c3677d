"""Significance tests on hand cases."""

import pytest

from earlywarn.operators import stats as st


def fs_frame(spark, scores):
    rows = []
    for order, (model, vals) in enumerate(scores.items(), start=1):
        for fold, v in enumerate(vals):
            rows.append((model, order, fold, float(v)))
    return spark.createDataFrame(rows, ["model", "model_order", "fold", "score"])


def test_holm_reference_example(spark):
    df = spark.createDataFrame([(i, 0, p) for i, p in enumerate([0.04, 0.01, 0.03, 0.5])], ["order_a", "order_b", "p_value"])
    got = {r.order_a: r.holm_p for r in st.holm(df).collect()}
    assert [round(got[i], 10) for i in range(4)] == [0.09, 0.04, 0.09, 0.5]


def test_wilcoxon_exact_n5(spark):
    # differences 0.1, 0.2, 0.3, 0.4, -0.05 -> ranks 2,3,4,5 positive, 1 negative: W = 1, p = 2 * 2/32
    a = [0.5, 0.6, 0.7, 0.8, 0.5]
    b = [0.4, 0.4, 0.4, 0.4, 0.55]
    w = st.wilcoxon_pairs(st.paired_scores(fs_frame(spark, {"a": a, "b": b}))).first()
    assert w.statistic == 1.0
    assert w.p_value == pytest.approx(0.125)


def test_wilcoxon_minimum_p(spark):
    for n, pmin in ((3, 0.25), (5, 0.0625)):
        a = [0.9] * n
        b = [0.1 * (i + 1) for i in range(n)]
        w = st.wilcoxon_pairs(st.paired_scores(fs_frame(spark, {"a": a, "b": b}))).first()
        assert w.p_value == pytest.approx(pmin)


def test_wilcoxon_all_zero(spark):
    w = st.wilcoxon_pairs(st.paired_scores(fs_frame(spark, {"a": [0.5] * 5, "b": [0.5] * 5}))).first()
    assert (w.statistic, w.p_value) == (0.0, 1.0)


def test_wilcoxon_tied_abs_differences(spark):
    # |d| = 0.1 twice (one +, one -), 0.2, 0.3: ranks 1.5, 1.5, 3, 4
    a = [0.6, 0.4, 0.7, 0.8]
    b = [0.5, 0.5, 0.5, 0.5]
    r = st.signed_ranks(st.paired_scores(fs_frame(spark, {"a": a, "b": b}))).orderBy("fold").collect()
    assert [x["rank"] for x in r] == [1.5, 1.5, 3.0, 4.0]


def test_friedman_chi2_tail(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(st.chi2_sf(F.lit(12.0), 6).alias("p"), st.chi2_sf(F.lit(3.0), 1).alias("q"))
    r = df.first()
    assert r.p == pytest.approx(0.061968804416658, rel=1e-9)
    assert r.q == pytest.approx(0.083264516663550, rel=1e-5)


def test_wilcoxon_exact_counts_equal_enumeration(spark):
    """n = 13 and more (with ties) against all sign patterns."""
    import itertools
    import random

    r = random.Random(6)
    rows, want = [], {}
    for e, n in enumerate([3, 13, 14]):
        diffs = [r.choice([-3, -2, -1, 1, 2, 4]) / 8 for _ in range(n)]
        size = sorted(map(abs, diffs))
        ranks = [(size.index(abs(x)) + 1 + n - size[::-1].index(abs(x))) / 2 for x in diffs]
        plus = sum(k for k, x in zip(ranks, diffs) if x > 0)
        stat = min(plus, sum(ranks) - plus)
        sums = [sum(itertools.compress(ranks, pat)) for pat in itertools.product((0, 1), repeat=n)]
        want[e] = (stat, min(1.0, 2 * sum(s <= stat + 1e-9 for s in sums) / 2**n))
        rows += [(e, m, o, f, (x if m == "a" else 0.0)) for f, x in enumerate(diffs) for o, m in enumerate("ab")]
    fs = spark.createDataFrame(rows, "exp int, model string, model_order int, fold int, score double")
    got = st.wilcoxon_pairs(st.paired_scores(fs, ["exp"]), ["exp"]).collect()
    assert {x.exp: (x.statistic, pytest.approx(x.p_value)) for x in got} == want
