"""Fits that read equal rows as one with their counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earlywarn.operators import task_fits
from earlywarn.operators import validate as va
from earlywarn.operators.splits import unpacked


@pytest.fixture(scope="module")
def enc(spark):
    """600 rows of few kinds, with missing numbers and categories, in three splits."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        a, b, c = float(rng.integers(0, 4)), float(rng.integers(0, 3)), ["u", "v", "w"][rng.integers(0, 3)]
        y = int(a + b + (c == "u") + rng.normal(scale=1.2) > 3)
        rows.append((i, y, None if i % 11 == 0 else a, float("nan") if i % 13 == 0 else b, None if i % 17 == 0 else c))
    df = spark.createDataFrame(rows, "row_id long, target int, a double, b double, c string")
    df = va.materialize(va.assign_folds(df, 3, 42))
    return va._encode(df, [(F.col("fold") != f, F.col("fold") == f) for f in range(3)], "target", "row_id", ("fold",))


def test_groups_hold_every_row_once(enc):
    rows = enc.table.collect()
    want = {}
    for r in rows:
        key = (tuple(r.codes), tuple("gap" if np.isnan(x) else x for x in r.nums))
        for s, role in enumerate(r.role):
            want.setdefault(key, np.zeros((3, 4), dtype=int))[s, (role - 1) * 2 + r.y] += 1
    got = {}
    for batch in enc.groups.toArrow().to_batches():
        for g in unpacked(batch, enc.plan):
            for codes, nums, n in zip(g.codes, g.nums, g.n):
                key = (tuple(codes.tolist()), tuple("gap" if np.isnan(x) else x for x in nums))
                assert key not in got
                got[key] = n
    assert got.keys() == want.keys() and len(got) == enc.kinds < len(rows) / 3
    assert all(np.array_equal(got[k], want[k]) for k in want)


TREES = [("Decision Tree", {"max_depth": 3, "min_samples_leaf": 2}), ("Decision Tree", {"max_depth": None, "min_samples_leaf": 1}),
         ("Gradient Boosting", {"n_estimators": 10, "learning_rate": 0.1, "max_depth": 2}),
         ("Gradient Boosting", {"n_estimators": 20, "learning_rate": 0.1, "max_depth": 2})]


def test_trees_of_a_larger_table_are_the_trees_of_its_rows(enc, monkeypatch):
    """Beyond the rows of a task no single fits are run: groups give the same trees."""
    tasks = [(f, m, p) for m, p in TREES for f in range(3)]
    rows = {(r.problem, r.key): r for r in va.fit_many(enc, tasks).collect()}
    scores = va.score_many(enc, tasks)
    monkeypatch.setattr(task_fits, "fits_in_a_task", lambda e: False)
    monkeypatch.setattr(va, "_distributed", None)
    groups = {(r.problem, r.key): r for r in va.fit_many(enc, tasks).collect()}
    assert rows.keys() == groups.keys()
    assert all(groups[k].y_prob == pytest.approx(rows[k].y_prob, abs=1e-9) and groups[k].y_true == rows[k].y_true for k in rows)
    assert va.score_many(enc, tasks) == pytest.approx(scores, abs=1e-9)


def test_forests_on_groups(enc, monkeypatch):
    """A forest dealt by its trees is the undealt one, and close to the forest of the rows."""
    grid = [{"n_estimators": n, "max_depth": d, "min_samples_leaf": 1} for n in (40, 80) for d in (3, None)]
    tasks = [(f, "Random Forest", p) for p in grid for f in range(3)]
    rows = {(r.problem, r.key): r.y_prob for r in va.fit_many(enc, tasks).collect()}
    monkeypatch.setattr(task_fits, "fits_in_a_task", lambda e: False)
    monkeypatch.setattr(va, "_distributed", None)
    dealt = {(r.problem, r.key): r.y_prob for r in va.fit_many(enc, tasks).collect()}
    alone = {}
    for f in range(3):  # many units a core: a forest in one piece
        monkeypatch.setattr(task_fits, "SEED", 42)
        alone |= {(r.problem * 3 + f, r.key): r.y_prob for r in va.fit_many(enc, [(f, "Random Forest", p) for p in grid]).collect()}
    assert rows.keys() == dealt.keys() == alone.keys()
    assert all(dealt[k] == pytest.approx(alone[k], abs=1e-9) for k in dealt)
    assert np.mean([abs(dealt[k] - rows[k]) for k in rows]) < 0.05


def test_logistic_passes_read_groups(enc, monkeypatch):
    """A pass reads each kind of row once; the counts of outcomes are those of the predictions."""
    from earlywarn.operators import linear_fits

    tasks = [(f, "Logistic Regression", {"C": c, "l1_ratio": 0.0}) for c in (0.1, 10.0) for f in range(3)]
    seen = []
    design = type(enc.plan).design
    problems = linear_fits.fit(enc, va._problems(tasks))
    monkeypatch.setattr(type(enc.plan), "design", lambda self, s, codes, nums: seen.append(len(codes)) or design(self, s, codes, nums))
    passer = linear_fits._passer(enc.plan, [(0, problems[0])], {0: problems[0].beta})
    list(passer(iter(enc.groups.toArrow().to_batches())))
    assert 0 < sum(seen) <= enc.kinds
    monkeypatch.undo()
    pred = va.fit_many(enc, tasks)
    assert va.score_many(enc, tasks) == pytest.approx([va._macro_f1(pred.filter(F.col("problem") == i)) for i in range(6)], abs=1e-12)


def test_lasso_steps_end_on_alike_columns():
    """One-hot slots add up to the intercept's column: a weak l1 penalty still has its exact minimum at once."""
    from earlywarn.operators import linear_fits

    rng = np.random.default_rng(3)
    slots = [np.eye(n)[rng.integers(0, n, 4000)] for n in (2, 5, 3)]
    x = np.concatenate([*slots, rng.normal(size=(4000, 3)), np.ones((4000, 1))], axis=1)
    y = (x[:, 10] - x[:, 3] + rng.normal(size=4000) > 0).astype(float)
    state = linear_fits._State(linear_fits.Problem(0, 100.0, 1.0), 4000.0 * 200, x.shape[1] - 1)  # each row 200 times
    passes = 0
    while not state.done and passes < 30:
        p = 1 / (1 + np.exp(-x @ state.trial))
        loss = float((np.logaddexp(0, x @ state.trial) - y * (x @ state.trial)).sum())
        state.take(200 * np.concatenate([[loss], x.T @ (p - y), (x.T @ (x * (p * (1 - p))[:, None])).ravel()]))
        passes += 1
    assert state.done and passes < 30
    slope = x.T @ (1 / (1 + np.exp(-x @ state.best)) - y) / 4000
    b = state.best[:-1]
    assert abs(slope[-1]) < 1e-7
    assert np.allclose(slope[:-1][b != 0], -state.l1 * np.sign(b[b != 0]), rtol=0, atol=1e-10) and np.all(np.abs(slope[:-1]) <= state.l1 + 1e-10)


KNN = [("KNN", {"n_neighbors": k, "weights": w}) for k in (3, 15) for w in ("uniform", "distance")]


def test_neighbours_of_a_larger_table_are_those_of_its_rows(enc, monkeypatch):
    """Beyond the rows of a task k-NN is no join of rows: groups with their voters give the same votes, ties by key included."""
    tasks = [(f, m, p) for m, p in KNN for f in range(3)]
    rows = {(r.problem, r.key): (r.y_true, round(r.y_prob, 12)) for r in va.fit_many(enc, tasks).collect()}
    scores = va.score_many(enc, tasks)
    monkeypatch.setattr(task_fits, "fits_in_a_task", lambda e: False)
    monkeypatch.setattr(va, "_distributed", None)
    assert {(r.problem, r.key): (r.y_true, round(r.y_prob, 12)) for r in va.fit_many(enc, tasks).collect()} == rows
    assert va.score_many(enc, tasks) == pytest.approx(scores, abs=1e-12)


def test_nearest_skips_far_cells_only(monkeypatch):
    """Every row within the k-th distance is found, and few of the others are compared."""
    from earlywarn.operators import forest

    rng = np.random.default_rng(5)
    x = np.concatenate([np.eye(6)[rng.integers(0, 6, 9000)], rng.integers(0, 9, (9000, 3)) * 0.3], axis=1)
    b, q = x[:8000], x[8000:]
    want = np.round(((q[:, None] - b[None]) ** 2).sum(2), 9)
    want = want <= np.sort(want, axis=1)[:, 6:7]
    compared = []
    whole = np.round
    monkeypatch.setattr(forest.np, "round", lambda d, digits: compared.append(d.size) or whole(d, digits))
    got = np.zeros(want.shape, dtype=bool)
    for at, row, col, _ in forest.nearest(b, q, 7):
        got[at[row], col] = True
    assert np.array_equal(got, want) and sum(compared) < want.size / 3


def test_learning_curve_of_a_larger_table(spark, monkeypatch):
    """Beyond a few rows the trees of all sizes and folds are grown on groups: the same curve."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(900):
        a, b, c = int(rng.integers(0, 4)), int(rng.integers(0, 3)), ["u", "v", "w"][rng.integers(0, 3)]
        rows.append((i, int(a + b + (c == "u") + rng.normal(scale=1.2) > 3), a, b, None if i % 17 == 0 else c))
    df = spark.createDataFrame(rows, "row_id long, target int, a int, b int, c string")
    want = sorted(map(tuple, va.learning_curve(df, "Decision Tree", {"max_depth": 3}, (0.5, 1.0), 2).collect()))
    monkeypatch.setattr(va, "FEW_ROWS", 0)
    monkeypatch.setattr(va, "fit_pipeline", None)
    got = sorted(map(tuple, va.learning_curve(df, "Decision Tree", {"max_depth": 3}, (0.5, 1.0), 2).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], rtol=0, atol=1e-12)
