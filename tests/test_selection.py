"""Many fits together against single fits, brute force and SQL on the written OOF."""

import functools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from earlywarn.operators import forest, linear_fits, models, task_fits
from earlywarn.operators import validate as va
from earlywarn.operators.models import GRIDS


@pytest.fixture(scope="module")
def learners(spark):
    """600 rows with missing numbers, missing and rare categories."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        a, b, c = rng.normal(), float(rng.integers(0, 6)), ["u", "v", "w", "x"][rng.integers(0, 4)]
        y = int(a + 0.4 * b + (c == "u") + rng.normal(scale=0.8) > 1.3)
        rows.append((i, y, None if i % 11 == 0 else float(round(a, 2)), float("nan") if i % 13 == 0 else b,
                     None if i % 17 == 0 else "rare" if i == 40 else c, bool(i % 2)))
    df = spark.createDataFrame(rows, "row_id long, target int, a double, b double, c string, d boolean")
    return va.materialize(va.assign_folds(df, 3, 42))


def encoded(df, folds=3):
    return va._encode(df, [(F.col("fold") != f, F.col("fold") == f) for f in range(folds)], "target", "row_id", ("fold",))


def single(df, f, name, params):
    return va.fit_predict(df.filter(F.col("fold") != f), df.filter(F.col("fold") == f), name, params, exclude=("fold",))


def by_key(pred, key="row_id"):
    return {r[key]: (r.y_true, r.y_pred, r.y_prob) for r in pred.collect()}


def test_prepared_features_equal_the_pipeline(spark, learners):
    """Medians, deviations and fills of every split as the fitted stages have them."""
    enc = encoded(learners)
    from earlywarn.operators.prep import preprocessor

    for f in range(3):
        train = learners.filter(F.col("fold") != f)
        cat, num = va._features(train, "target", "row_id", ("fold",))
        stages = preprocessor(cat, num).fit(train).stages
        mode, median, scaler = stages[0].getStats(), stages[3].getStats(), stages[4].getStats()
        assert enc.plan.median[f].tolist() == [median[c] for c in num]
        assert np.allclose(enc.plan.mean[f], [scaler[c][0] for c in num]) and np.allclose(enc.plan.std[f], [scaler[c][1] for c in num])
        for i, c in enumerate(cat):
            assert enc.plan.values[i][enc.plan.fill_slot[f, i] - enc.plan.offset[i]] == mode[c]


@pytest.mark.parametrize("params", [g for g in GRIDS["Logistic Regression"] if g["C"] in (0.1, 10.0)])
def test_logistic_fits_equal_single_fits(spark, learners, monkeypatch, params):
    """Single fits run to the optimum here, not to the library's loose default."""
    monkeypatch.setattr(models, "TOL", 1e-9)
    enc = encoded(learners)
    many = {r.key: r for r in va.fit_many(enc, [(f, "Logistic Regression", params) for f in range(3)]).collect()}
    alone = functools.reduce(lambda a, b: a.unionByName(b), [single(learners, f, "Logistic Regression", params) for f in range(3)])
    alone = by_key(alone)
    assert many.keys() == alone.keys()
    # row 40 has a category that no training row has; under l1 the share of the
    # intercept in such a row is not unique
    same = [k for k in many if k != 40 or params["l1_ratio"] == 0.0]
    assert max(abs(many[k].y_prob - alone[k][2]) for k in same) < 1e-4
    assert sum(many[k].y_pred != alone[k][1] for k in same) == 0


def test_optimum_and_many_passes(spark, learners, monkeypatch):
    """The gradient of the objective vanishes, also when problems are dealt over several passes."""
    enc = encoded(learners)
    problems = [linear_fits.Problem(f, c, 0.0) for f in range(3) for c in (0.1, 10.0)]
    whole = [p.beta for p in linear_fits.fit(enc, problems)]
    monkeypatch.setattr(linear_fits, "PASS_BYTES", 1)
    parts = [p.beta for p in linear_fits.fit(enc, [linear_fits.Problem(p.split, p.c) for p in problems])]
    assert np.allclose(whole, parts, atol=1e-6)
    rows = task_fits.design_rows(enc, 1).filter("role = 1").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    w, beta = np.array([r.weight for r in rows]), whole[3]
    p = 1 / (1 + np.exp(-(x @ beta[:-1] + beta[-1])))
    g = x.T @ (w * (p - y)) / len(y) + beta[:-1] / (10.0 * len(y))
    assert np.abs(g).max() < 1e-7 and abs((w * (p - y)).sum()) / len(y) < 1e-7


def test_knn_equals_brute_force(spark, learners):
    """Votes of the nearest training rows, ties to the smaller key."""
    enc = encoded(learners)
    grid = [{"n_neighbors": 5, "weights": "uniform"}, {"n_neighbors": 9, "weights": "distance"}]
    many = {(r.problem, r.key): r.y_prob for r in va.fit_many(enc, [(1, "KNN", p) for p in grid]).collect()}
    rows = sorted(task_fits.design_rows(enc, 1).collect(), key=lambda r: r.key)
    train, test = [r for r in rows if r.role == 1], [r for r in rows if r.role == 2]
    x = np.array([r.x for r in train])
    assert len(many) == 2 * len(test)
    for r in test:
        d2 = np.round(((x - np.array(r.x)) ** 2).sum(1), 9)
        order = np.argsort(d2, kind="stable")
        for i, p in enumerate(grid):
            near = order[: p["n_neighbors"]]
            w = np.ones(len(near))
            if p["weights"] == "distance":
                w = (d2[near] == 0).astype(float) if (d2[near] == 0).any() else 1 / np.sqrt(d2[near])
            want = sum(w * np.array([train[j].y for j in near])) / w.sum()
            assert many[i, r.key] == pytest.approx(want, abs=1e-6)


def test_first_split_is_the_best_one():
    """Root split and child values against all candidate splits."""
    rng = np.random.default_rng(2)
    z = np.stack([rng.integers(0, 4, 300), rng.integers(0, 9, 300)], axis=1)
    y = ((z[:, 0] == 2) | (z[:, 1] > 6)).astype(int) ^ (rng.random(300) < 0.1)
    w = np.where(y == 1, 0.7, 1.9)
    bins = forest.Bins(z, [5, 9], 1)
    tree = forest.grow(bins, y, w, np.arange(300), None, 4)

    def gini(m):
        p = (w[m] * y[m]).sum() / w[m].sum()
        return w[m].sum() * 2 * p * (1 - p)

    cands = [(z[:, 0] == v) for v in range(4)] + [(z[:, 1] <= v) for v in range(8)]
    gains = [gini(np.ones(300, bool)) - gini(m) - gini(~m) if min(m.sum(), (~m).sum()) >= 4 else -1 for m in cands]
    best = int(np.argmax(gains))
    assert (tree.column[0], tree.bin[0]) == ((0, best) if best < 4 else (1, best - 4))
    leaf = tree.leaves(bins)
    for node in np.unique(leaf):
        m = leaf == node
        assert m.sum() >= 4 and math.isclose(tree.value[node], (w[m] * y[m]).sum() / w[m].sum())


def test_a_tree_cut_is_the_shallow_tree():
    rng = np.random.default_rng(3)
    z = rng.integers(0, 20, size=(500, 3))
    y = (rng.random(500) < 0.2 + 0.03 * z[:, 0]).astype(int)
    bins, one = forest.Bins(z, [20, 20, 20], 0), np.ones(500)
    deep = forest.grow(bins, y, one, np.arange(500), None, 1, 1, 9)
    for d in (0, 1, 3, 6):
        cut = forest.grow(bins, y, one, np.arange(500), d, 1, 1, 9)
        assert np.array_equal(deep.value[deep.leaves(bins, d)], cut.value[cut.leaves(bins)])


def test_boosting_lowers_the_loss_and_keeps_its_prefix():
    rng = np.random.default_rng(4)
    z = rng.integers(0, 10, size=(400, 2))
    y = ((z[:, 0] > 4) & (z[:, 1] > 2)).astype(int)
    bins, rows = forest.Bins(z, [10, 10], 0), np.arange(400)
    got = forest.boosted_probabilities(bins, y, rows, rows, [5, 40], 0.3, 2)
    short = forest.boosted_probabilities(bins, y, rows, rows, [5], 0.3, 2)
    loss = lambda p: -np.mean(np.log(np.where(y == 1, p, 1 - p)))
    assert np.array_equal(got[5], short[5]) and loss(got[40]) < 0.5 * loss(got[5]) < 0.5 * math.log(2) and ((got[40] > 0.5) == y).all()


def test_bags_are_poisson_and_fixed():
    tags = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 20000)
    n = forest.bag(tags, 3, 42)
    assert abs(n.mean() - 1) < 0.03 and abs(n.var() - 1) < 0.06
    assert np.array_equal(n[::2], forest.bag(tags[::2], 3, 42)) and not np.array_equal(n, forest.bag(tags, 4, 42))


@pytest.mark.parametrize("name", ["Decision Tree", "KNN", "Logistic Regression"])
def test_same_choice_as_single_fits(spark, learners, name):
    """The chosen candidate of a grid search is the first best of single fits."""
    grid = [g for g in GRIDS[name] if g.get("max_depth", 1) is not None][:4]
    params, table = va.grid_search(learners, name, grid)
    alone = []
    for g in grid:
        scores = [va._macro_f1(single(learners, f, name, g)) for f in range(3)]
        alone.append(sum(scores) / 3)
    assert all(abs(t["mean_macro_f1"] - a) < 0.02 for t, a in zip(table, alone))
    assert alone[grid.index(params)] > max(alone) - 0.01


def test_large_tables_take_distributed_fits(spark, learners, monkeypatch):
    """Beyond the size of a task, pyspark.ml fits the same splits."""
    enc = encoded(learners)
    tasks = [(f, m, p) for m, p in (("Decision Tree", {"max_depth": 3, "min_samples_leaf": 1}), ("KNN", {"n_neighbors": 5, "weights": "uniform"})) for f in range(3)]

    def counts():
        right = F.avg((F.col("y_true") == F.col("y_pred")).cast("int"))
        return {r.problem: (r.n, r.acc) for r in va.fit_many(enc, tasks).groupBy("problem").agg(F.count("*").alias("n"), right.alias("acc")).collect()}

    here = counts()
    monkeypatch.setattr(task_fits, "TASK_BYTES", 0)
    there = counts()
    assert sorted(here) == sorted(there) == list(range(6))
    assert all(here[i][0] == there[i][0] and abs(here[i][1] - there[i][1]) < 0.04 for i in here)


def test_nested_folds_are_those_of_the_training_rows(spark, learners):
    df = learners.drop("fold")
    d = va.nested_folds(df, 4, 3, 42).select("row_id", "target", "outer", "inner").collect()
    outer = {r.row_id: r.fold for r in va.assign_folds(df, 4, 42).collect()}
    assert {r.row_id: r.outer for r in d} == outer
    for f in range(4):
        train = df.filter(F.col("row_id").isin([k for k, v in outer.items() if v != f]))
        inner = {r.row_id: r.fold for r in va.assign_folds(train, 3, 42 + f).collect()}
        assert {r.row_id: r.inner[f] for r in d if f in r.inner} == inner


def test_metrics_recomputed_from_the_written_oof(spark, learners, tmp_path):
    """Fold metrics of nested CV by SQL on the OOF rows; the winner and its refit."""
    import duckdb

    specs = {m: GRIDS[m][:2] for m in GRIDS}
    specs["Random Forest"] = [{"n_estimators": 5, "max_depth": d, "min_samples_leaf": 1} for d in (3, None)]
    specs["Gradient Boosting"] = [{"n_estimators": n, "learning_rate": 0.1, "max_depth": 2} for n in (5, 10)]
    df = learners.drop("fold")
    oof, fm, chosen, winner, params, model = va.train_models(df, specs, outer=3, inner=2)
    assert chosen.count() == 21 and params in specs[winner]
    path = str(tmp_path / "oof")
    oof.write.parquet(path)
    sql = duckdb.sql(f"""WITH c AS (SELECT model, fold, count(*) FILTER (y_true = 0 AND y_pred = 0)::DOUBLE AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1)::DOUBLE AS fp,
        count(*) FILTER (y_true = 1 AND y_pred = 0)::DOUBLE AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1)::DOUBLE AS tp FROM '{path}/*.parquet' GROUP BY ALL),
        a AS (SELECT p.model, p.fold, avg(CASE WHEN p.y_prob > q.y_prob THEN 1.0 WHEN p.y_prob = q.y_prob THEN 0.5 ELSE 0 END) AS auc
            FROM '{path}/*.parquet' p JOIN '{path}/*.parquet' q ON p.model = q.model AND p.fold = q.fold AND p.y_true = 1 AND q.y_true = 0 GROUP BY ALL)
        SELECT model, fold, (2 * tn / (2 * tn + fp + fn) + 2 * tp / (2 * tp + fp + fn)) / 2, (tn + tp) / (tn + fp + fn + tp), auc FROM c JOIN a USING (model, fold)""").fetchall()
    got = {(r.model, r.fold): (r.macro_f1, r.accuracy, r.auc) for r in fm.collect()}
    assert len(sql) == len(got) == 21
    for m, f, *want in sql:
        assert got[m, f] == pytest.approx(want, abs=1e-9)
    mean = {m: sum(v[0] for (k, _), v in got.items() if k == m) / 3 for m in specs}
    assert winner == max(specs, key=lambda m: mean[m])
    assert model.transform(df).count() == 600


def test_bad_labels_and_models(spark, learners):
    bad = learners.withColumn("target", F.when(F.col("row_id") == 3, 2).otherwise(F.col("target")))
    with pytest.raises(Exception, match="neither 0 nor 1"):
        encoded(bad)
    with pytest.raises(ValueError, match="no estimator is known"):
        va.fit_many(encoded(learners), [(0, "Naive Bayes", {})])


def test_pool_stops_at_the_first_failure(spark):
    seen = []

    def run(i):
        seen.append(i)
        if i == 0:
            raise KeyError("stop")
        return spark.range(i).count()

    with pytest.raises(KeyError):
        va._pool_map(run, list(range(50)), 1)
    assert len(seen) < 50
