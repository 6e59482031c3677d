"""Fits of larger tables: wide logistic fits, forests in whole numbers, boosting on kinds of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earlywarn.operators import forest, linear_fits, task_fits
from earlywarn.operators import validate as va
from earlywarn.operators.splits import Groups, unpacked


@pytest.fixture(scope="module")
def learners(spark):
    """600 rows of few kinds, with missing numbers and categories, in three folds."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        a, b, c = float(rng.integers(0, 4)), float(rng.integers(0, 3)), ["u", "v", "w"][rng.integers(0, 3)]
        y = int(a + b + (c == "u") + rng.normal(scale=1.2) > 3)
        rows.append((i, y, None if i % 11 == 0 else a, float("nan") if i % 13 == 0 else b, None if i % 17 == 0 else c))
    df = spark.createDataFrame(rows, "row_id long, target int, a double, b double, c string")
    return va.materialize(va.assign_folds(df, 3, 42))


def encoded(learners):
    return va._encode(learners, [(F.col("fold") != f, F.col("fold") == f) for f in range(3)], "target", "row_id", ("fold",))


def test_wide_fits_start_where_another_split_ended(learners, monkeypatch):
    """Of many wide problems few passes bring Hessians, and each ends where it would alone."""
    enc = encoded(learners)
    grid = [{"C": c, "gamma": g, "n_components": 70} for c in (0.1, 10.0) for g in ("scale", "auto")]
    tasks = [(f, "SVM RBF", p) for p in grid for f in range(3)]
    alone = [linear_fits.fit(enc, va._problems([t]))[0].beta for t in tasks]
    passes = []
    passer = linear_fits._passer
    monkeypatch.setattr(linear_fits, "_passer", lambda plan, some, beta, bent: passes.append((len(some), len(bent))) or passer(plan, some, beta, bent))
    together = linear_fits.fit(enc, va._problems(tasks))
    assert all(np.allclose(p.beta, b, rtol=0, atol=1e-5) for p, b in zip(together, alone))
    first = [x for x in passes if x[0] <= len(grid)]
    assert sum(b for _, b in passes) < sum(n for n, _ in passes) and len(first) > 1
    passes.clear()
    linear_fits.fit(enc, va._problems([(f, "Logistic Regression", {"C": 1.0}) for f in range(3)]))
    assert passes and all(n == b for n, b in passes)  # narrow ones as before


def test_whole_number_trees():
    """Counts added up as digits of one number, or apart where they do not fit, give the trees of ``grow``."""
    rng = np.random.default_rng(4)
    z = np.stack([rng.integers(0, 5, 400), rng.integers(0, 9, 400), rng.integers(0, 7, 400)], axis=1)
    bins = forest.Bins(z, [5, 9, 7], 1)
    zeros, ones = rng.integers(0, 6, 400), rng.integers(0, 6, 400)
    drawn = np.minimum(zeros, rng.integers(1, 4, 400)), np.minimum(ones, rng.integers(1, 4, 400))  # rows of each class
    rows = np.flatnonzero(zeros + ones)
    twice = forest.Bins(np.concatenate([z, z]), bins.sizes, 1)
    w, y, count = np.concatenate([0.5 * zeros, 1.5 * ones]), np.repeat([0.0, 1.0], 400), np.concatenate(drawn)
    for leaf in (1, 4):
        for tried in (None, 2):
            for depth in (3, None):
                want = forest.grow(twice, y, w, np.flatnonzero(count), depth, leaf, tried, 9, count=count)
                for big in (1, 1 << 30):  # times a large number the digits do not fit
                    got = forest.grow_counts(bins, zeros * big, ones * big, sum(drawn) * big, (0.5, 1.5), rows, depth, leaf * big, tried, 9)
                    assert np.array_equal(got.column, want.column) and np.array_equal(got.bin[got.column >= 0], want.bin[want.column >= 0])
                    assert np.allclose(got.value, want.value, rtol=0, atol=1e-12) and np.array_equal(got.left, want.left)


def test_more_than_a_few_rows_are_dealt_by_trees(learners, monkeypatch):
    """A forest of a table of some size is not one task: its trees are dealt to the cores, on groups of equal rows."""
    enc = encoded(learners)
    tasks = [(0, "Random Forest", {"n_estimators": 20, "max_depth": d, "min_samples_leaf": 1}) for d in (2, None)]
    assert va._fits(enc, tasks, "Random Forest") is task_fits.predict
    rows = {(r.problem, r.key): r.y_prob for r in va.fit_many(enc, tasks).collect()}
    monkeypatch.setattr(task_fits, "FEW_BYTES", 0)
    assert va._fits(enc, tasks, "Random Forest") is task_fits.predict_groups
    dealt = {(r.problem, r.key): r.y_prob for r in va.fit_many(enc, tasks).collect()}
    assert rows.keys() == dealt.keys() and np.mean([abs(dealt[k] - rows[k]) for k in rows]) < 0.08
    monkeypatch.setattr(task_fits, "groups_fit", lambda e: False)
    assert va._fits(enc, tasks, "Random Forest") is task_fits.predict


def test_boosting_on_kinds_of_rows(learners, monkeypatch):
    """Beyond a few rows a pass of boosting reads each kind of row once: the same model."""
    df = learners.drop("fold")
    params = {"n_estimators": 8, "learning_rate": 0.2, "max_depth": 2}

    def margins(model):
        return {r.row_id: r.p for r in model.transform(df).select("row_id", va.pass_probability(model.transform(df)).alias("p")).collect()}

    want = margins(va.fit_pipeline(df, "Gradient Boosting", params, exclude=()))
    read = []
    build = va.build_estimator

    def seen(*args, **kw):
        (est,) = build(*args, **kw)
        fit = est._fit
        est._fit = lambda d: read.append(d.count()) or fit(d)
        return [est]

    monkeypatch.setattr(va, "build_estimator", seen)
    monkeypatch.setattr(va, "FEW_ROWS", 0)
    got = margins(va.fit_pipeline(df, "Gradient Boosting", params, exclude=()))
    assert 0 < read[0] < 600 / 3
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    read.clear()
    va.fit_pipeline(df, "Gradient Boosting", params | {"min_samples_leaf": 5}, exclude=())
    assert read == [600]  # a leaf's rows are counted


def grouped(seed, sizes, cats, rows):
    """Distinct rows of bins with the training rows of each class; every third has none."""
    rng = np.random.default_rng(seed)
    z = np.unique(np.stack([rng.integers(0, n, rows) for n in sizes], axis=1), axis=0)
    zeros, ones = rng.integers(0, 6, len(z)), rng.integers(0, 6, len(z)) * (z[:, 0] > 1)
    zeros[::3] = ones[::3] = 0
    return forest.Bins(z, list(sizes), cats), zeros, ones


def test_boosting_adds_up_columns_together(monkeypatch):
    """The counts of a level are added up for several columns at once, and those of rows once for nodes that come
    again: the same boosting as on the rows, with far fewer sums than columns, levels and trees."""
    bins, zeros, ones = grouped(6, (5, 3, 9, 7, 4), 2, 700)
    train, test = np.flatnonzero(zeros + ones), np.arange(len(zeros))
    each = np.repeat(np.arange(len(zeros)), zeros + ones)
    y = np.concatenate([np.repeat([0, 1], [a, b]) for a, b in zip(zeros, ones)])
    rows = forest.Bins(np.concatenate([bins.z[each], bins.z]), bins.sizes, bins.cats)
    for depth, leaf in ((2, 1), (3, 4)):
        want = forest.boosted_probabilities(rows, np.concatenate([y, 0 * test]), np.arange(len(y)), len(y) + test, [8, 20], 0.1, depth, leaf)
        sums = []
        bincount = np.bincount
        monkeypatch.setattr(forest.np, "bincount", lambda *a: sums.append(len(a[0])) or bincount(*a))
        got = forest.boosted_groups(bins, zeros, ones, train, test, [8, 20], 0.1, depth, leaf)
        monkeypatch.undo()
        assert all(np.allclose(got[n], want[n], rtol=0, atol=1e-9) for n in (8, 20))
        assert len(sums) < 20 * depth * 2 * len(bins.sizes)


def test_forests_with_other_leaves_share_bags_and_first_levels(monkeypatch):
    """Trees of one bag grow as one until they split differently, and each is the tree that it is alone."""
    bins, zeros, ones = grouped(7, (5, 3, 9, 7), 2, 600)
    many, rows = zeros + ones, np.flatnonzero(zeros + ones)
    levels = []
    level = forest._Growth.level
    monkeypatch.setattr(forest._Growth, "level", lambda self, *a: levels.append(self.depth) or level(self, *a))
    for fill in (forest.FILL, 0):  # several columns together, or one by one
        monkeypatch.setattr(forest, "FILL", fill)
        for tried in (None, 3):
            alone = {m: forest.grow_counts(bins, zeros, ones, many, (0.5, 1.5), rows, None, m, tried, 3) for m in (1, 3, 9)}
            apart = len(levels)
            levels.clear()
            got = forest.grow_alike(bins, zeros, ones, many, (0.5, 1.5), rows, None, [1, 3, 9], tried, 3)
            assert len(levels) < apart
            levels.clear()
            for m, want in alone.items():
                for name in ("column", "bin", "left", "value", "depth"):
                    assert np.array_equal(getattr(got[m], name), getattr(want, name))
    drawn = []
    one = forest.grow_alike
    monkeypatch.setattr(forest, "grow_alike", lambda *a: drawn.append(a[7]) or one(*a))
    wanted = [(4, None, 1), (6, None, 3), (6, 2, 3)]
    got = forest.forest_sums(bins, zeros, ones, (0.5, 1.5), rows, rows, wanted, 42)
    assert drawn == [[1, 3]] * 4 + [[3]] * 2
    for w in wanted:
        assert np.array_equal(got[w], forest.forest_sums(bins, zeros, ones, (0.5, 1.5), rows, rows, [w], 42)[w])


def test_forests_of_a_split_are_one_unit(learners, monkeypatch):
    """Candidates that differ in the least rows of a leaf are grown in one task, from one bag a tree."""
    enc = encoded(learners)
    monkeypatch.setattr(task_fits, "FEW_BYTES", 0)
    seen = []
    fit = task_fits.forest.forest_sums
    monkeypatch.setattr(task_fits.forest, "forest_sums", lambda *a: seen.append(a[6]) or fit(*a))
    plan = enc.plan
    tasks = [(0, "Random Forest", {"n_estimators": 3, "max_depth": 2, "min_samples_leaf": m}) for m in (1, 3)]
    g = next(unpacked(enc.groups.toArrow().to_batches()[0], plan))
    g = Groups(g.codes, g.nums, g.n[:, :1])
    got = dict(task_fits._fit_groups(plan, (0, "Random Forest"), 0, 1, list(enumerate(tasks)), g))
    assert len(seen) == 1 and len(got) == 2
    scores = va.score_many(enc, tasks)
    assert len(scores) == 2 and None not in scores


def test_cosine_is_the_cosine():
    z = np.random.default_rng(1).normal(size=(300, 200)) * 20
    want = np.cos(z)
    assert np.abs(linear_fits.cosine(z) - want).max() < 1e-13


def test_logistic_fits_on_kinds_of_rows(learners, monkeypatch):
    """Beyond a few rows a logistic fit reads each kind of row once, with the weights of its rows: the same model."""
    df = learners.drop("fold")

    def margins(model):
        out = model.transform(df)
        return {r.row_id: r.p for r in out.select("row_id", va.pass_probability(out).alias("p")).collect()}

    for params in ({"C": 1.0, "l1_ratio": 0.0}, {"C": 0.1, "l1_ratio": 1.0}):
        want = margins(va.fit_pipeline(df, "Logistic Regression", params, exclude=()))
        read = []
        build = va.build_estimator

        def seen(*args, **kw):
            (est,) = build(*args, **kw)
            fit = est._fit
            est._fit = lambda d: read.append(d.count()) or fit(d)
            return [est]

        monkeypatch.setattr(va, "build_estimator", seen)
        monkeypatch.setattr(va, "FEW_ROWS", 0)
        got = margins(va.fit_pipeline(df, "Logistic Regression", params, exclude=()))
        monkeypatch.undo()
        assert 0 < read[0] < 600 / 3
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)


def test_roles_of_many_splits_are_not_one_method(learners):
    """The roles of a row in many splits, and an expression that keeps them out of one generated method."""
    from earlywarn.operators.splits import _role

    splits = [(F.col("fold") != f % 3, F.col("fold") == f % 3) for f in range(40)]
    out = learners.select("fold", _role(splits).alias("role"))
    assert out.schema["role"].dataType.simpleString() == "array<tinyint>"
    for r in out.distinct().collect():
        assert r.role == [2 if f % 3 == r.fold else 1 for f in range(40)]
    import re

    tree = out._jdf.queryExecution().executedPlan().toString()
    assert "transform(" in tree and not re.search(r"^\*.*role", tree, re.M)  # that projection is not code of a whole stage
