"""Poisson bootstrap against a direct per-row computation, with groups and a heavy score value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earlywarn.functions.hashing import GOLDEN, MASK32, mix32_int
from earlywarn.operators.bootstrap import bootstrap_ci, poisson_cutoffs


def key_hash(k: int) -> int:
    x = mix32_int(k & MASK32)
    return mix32_int(x ^ ((k >> 32) & MASK32))


def brute(rows, t, B, seed):
    cut = poisson_cutoffs()
    out = {m: [] for m in ("macro_f1", "risk_recall", "auc")}
    for b in range(1, B + 1):
        st = ((b + seed * B) * GOLDEN) & MASK32
        w = np.array([sum(mix32_int(st ^ key_hash(k)) / 4294967296.0 >= c for c in cut) for k, _, _ in rows], dtype=float)
        y = np.array([r[1] for r in rows], dtype=float)
        p = np.array([r[2] for r in rows])
        P, N = (w * y).sum(), (w * (1 - y)).sum()
        if P == 0 or N == 0:
            continue
        pred = p >= t
        tp, fp = (w * y * pred).sum(), (w * (1 - y) * pred).sum()
        fn, tn = P - tp, N - fp
        f1r = 2 * tn / (2 * tn + fp + fn) if 2 * tn + fp + fn else 0.0
        f1p = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
        has0, has1 = int(tn + fp + fn > 0), int(tp + fp + fn > 0)
        out["macro_f1"].append((f1r * has0 + f1p * has1) / (has0 + has1))
        out["risk_recall"].append(tn / (tn + fp))
        u = 0.0
        for i in range(len(rows)):
            if y[i] == 1:
                u += w[i] * ((w * (1 - y) * (p < p[i])).sum() + 0.5 * (w * (1 - y) * (p == p[i])).sum())
        out["auc"].append(u / (P * N))
    return {m: (np.percentile(v, 2.5), np.percentile(v, 97.5)) for m, v in out.items()}


def test_bootstrap_matches_direct_computation(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        g = "hot" if i % 2 else "spread"
        y = int(rng.random() < 0.6)
        # the 'hot' group shares one score (a point slice), the other is continuous
        p = 0.7 if g == "hot" else float(np.round(0.4 * y + 0.6 * rng.random(), 4))
        rows.append((i * 7919 + (1 << 33), g, y, p))
    df = spark.createDataFrame(rows, "row_id long, grp string, y_true int, y_prob double")
    got = bootstrap_ci(df, 0.5, 40, by=["grp"], seed=42, slices=4).collect()
    for g in ("hot", "spread"):
        exp = brute([(k, y, p) for k, gg, y, p in rows if gg == g], 0.5, 40, 42)
        for r in (r for r in got if r.grp == g):
            if r.metric in exp:
                assert r.ci_lower == pytest.approx(exp[r.metric][0], abs=1e-9), (g, r.metric)
                assert r.ci_upper == pytest.approx(exp[r.metric][1], abs=1e-9), (g, r.metric)
