"""Preparation stages, k-NN, folds, scenarios, explanations and the streaming scorer."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from earlywarn.operators import knn, prep, score as sc, validate as va


def test_median_imputer_exact(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    m = prep.MedianImputer(inputCols=["x"]).fit(df)
    assert m.getStats()["x"] == 2.5
    assert sorted(r.x for r in m.transform(df).collect()) == [1.0, 2.0, 2.5, 3.0, 10.0]


def test_mode_imputer_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    m = prep.ModeImputer(inputCols=["s"]).fit(df)
    assert m.getStats()["s"] == "a"


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    out = prep.PopulationScaler(inputCols=["x"]).fit(df).transform(df).collect()
    assert [r.x for r in out] == [-1.0, 1.0]  # population std of {1, 3} is 1


def test_one_hot_unknown_all_zero(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    test = spark.createDataFrame([("b",), ("z",)], "c string")
    stages, ohe = prep.categorical_stage(["c"])
    m = Pipeline(stages=stages).fit(train)
    got = [list(r[0]) for r in m.transform(test).select(vector_to_array(F.col(ohe[0]))).collect()]
    assert got == [[0.0, 1.0], [0.0, 0.0]]


def test_knn_join_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(60, 5)).round(3)
    df = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(60)], "id long, v array<double>")
    got = knn.knn_join(df, df, 3, "id", "id", "v", "v", metric="euclidean", exclude_self=True, block_rows=17, digits=None)
    got = {(r.q_id, r["rank"]): r.n_id for r in got.collect()}
    for q in range(60):
        d = np.sqrt(((vecs - vecs[q]) ** 2).sum(1))
        d[q] = np.inf
        order = sorted(range(60), key=lambda j: (d[j], j))[:3]
        assert [got[(q, k + 1)] for k in range(3)] == order


def test_folds_stratified_balanced(spark):
    df = spark.range(103).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("target"))
    f = va.assign_folds(df, 5, 42)
    counts = f.groupBy("target", "fold").count().collect()
    by = {}
    for r in counts:
        by.setdefault(r.target, []).append(r["count"])
    for cls, cs in by.items():
        assert max(cs) - min(cs) <= 1
    assert f.count() == 103 and f.select("row_id").distinct().count() == 103


def test_training_prefixes_nested(spark):
    df = spark.range(50).select(F.col("id").alias("row_id"), F.lit(0).alias("fold"))
    p = va.training_prefixes(df, [0.2, 0.6, 1.0])
    sets = {s: {r.row_id for r in p.filter(F.col("size") == s).collect()} for s in (0.2, 0.6, 1.0)}
    assert len(sets[0.2]) == 10 and len(sets[0.6]) == 30 and len(sets[1.0]) == 50
    assert sets[0.2] <= sets[0.6] <= sets[1.0]


def test_scenario_edits(spark):
    df = spark.createDataFrame([(1, 7, 4, 2, "no", "no")], "row_id long, absences int, studytime int, failures int, famsup string, schoolsup string")
    scorer = sc.linear_scorer(0.0, {"absences": -0.1})
    got = {r.scenario: r for r in sc.score_scenarios(df, scorer).collect()}
    assert len(got) == 5
    # attendance support: 7 * 0.65 = 4.55 -> 4
    assert got["Attendance support"].pass_probability == pytest.approx(1 / (1 + math.exp(0.4)))
    # custom plan: 7 * 0.55 = 3.85 -> 3
    assert got["Custom adviser plan"].pass_probability == pytest.approx(1 / (1 + math.exp(0.3)))
    eff = sc.scenario_effect(sc.score_scenarios(df, scorer)).first()
    assert eff.best_scenario == "Custom adviser plan" and eff.promising


def test_linear_contributions_additive(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 0.0, 1.0), (3, 1.0, 3.0)], "row_id long, a double, b double")
    c = sc.linear_contributions(df, df, 0.5, {"a": 2.0, "b": -1.0})
    tot = {r.row_id: r.t for r in c.groupBy("row_id").agg((F.sum("phi") + F.first("base")).alias("t")).collect()}
    assert tot == {1: pytest.approx(0.5 + 4 - 5), 2: pytest.approx(0.5 - 1), 3: pytest.approx(0.5 + 2 - 3)}


def test_permutation_contributions_additive(spark):
    df = spark.createDataFrame([(i, float(i % 4), float(i % 3)) for i in range(20)], "row_id long, a double, b double")
    scorer = sc.linear_scorer(0.2, {"a": 0.7, "b": -0.4})
    c = sc.permutation_contributions(df, scorer, df.limit(5), ["a", "b"], n_perm=3)
    tot = c.groupBy("row_id").agg((F.sum("phi") + F.first("base")).alias("t"))
    z = df.select("row_id", (0.2 + 0.7 * F.col("a") - 0.4 * F.col("b")).alias("z"))
    err = tot.join(z, "row_id").agg(F.max(F.abs(F.col("t") - F.col("z")))).first()[0]
    assert err < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    from earlywarn.streaming.score_stream import read_sink, run_to_end, score_stream

    df = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 5).cast("int").alias("failures"))
    src = str(tmp_path / "src")
    df.repartition(3).write.parquet(src)
    scorer = sc.linear_scorer(1.0, {"failures": -0.8})
    q = score_stream(spark, src, df.schema, scorer, 0.5, str(tmp_path / "sink"), str(tmp_path / "ckpt"), max_files_per_trigger=1)
    run_to_end(q)
    s = read_sink(spark, str(tmp_path / "sink"))
    b = sc.score_batch(df, scorer, 0.5)
    assert s.count() == 40
    assert s.select(b.columns).exceptAll(b).count() == 0


def test_majority_class_and_fit(spark):
    from earlywarn.operators.models import MajorityClass

    df = spark.createDataFrame([(i, i % 3 != 0) for i in range(30)], "row_id long, t boolean").select("row_id", F.col("t").cast("int").alias("target"))
    m = MajorityClass(labelCol="target").fit(df)
    assert m.getOrDefault(m.majority) == 1
    out = m.transform(df).select(vector_to_array("probability")[1].alias("p")).first()
    assert out.p == 1.0 and m.getOrDefault(m.share) == pytest.approx(20 / 30)


def test_build_estimator_unknown_raises():
    from earlywarn.operators.models import GRIDS, build_estimator

    with pytest.raises(ValueError, match="no estimator is known"):
        build_estimator("Naive Bayes", {}, 100)
    assert sum(len(g) for g in GRIDS.values()) == 43


def test_random_search_sampler_seeded():
    import random

    from earlywarn.operators.validate import SPACES, sample_params

    a = [sample_params(SPACES["Random Forest"], random.Random(42)) for _ in range(3)]
    b = [sample_params(SPACES["Random Forest"], random.Random(42)) for _ in range(3)]
    assert a == b
    for p in a:
        assert 80 <= p["n_estimators"] <= 350 and (p["n_estimators"] - 80) % 10 == 0
        assert 3 <= p["max_depth"] <= 20 and 1 <= p["min_samples_leaf"] <= 10


def test_contributions_sort_no_coalitions(spark):
    """The changes of each feature by hand; no window over the coalitions."""
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3)) for i in range(40)], "row_id long, a double, b double")
    bg = spark.createDataFrame([(0, 2.0, 1.0)], "row_id long, a double, b double")
    c = sc.permutation_contributions(df, sc.linear_scorer(0.2, {"a": 0.3, "b": -0.4}), bg, ["a", "b"], n_perm=3)
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan  # the windows that are left number the background
    got = {(r.row_id, r.feature): (r.base, r.phi) for r in c.collect()}
    assert len(got) == 80
    for i in range(40):
        assert got[i, "a"] == pytest.approx((0.2 + 0.6 - 0.4, 0.3 * (i % 7 - 2.0)))
        assert got[i, "b"] == pytest.approx((0.2 + 0.6 - 0.4, -0.4 * (i % 3 - 1.0)))


def test_logistic_pipelines_score_by_expressions(spark):
    """The fills, slots, scaling and coefficients of a logistic pipeline as column expressions: the scores of its transform,
    missing values and unseen categories included, and no function of a vector in the plan."""
    from earlywarn.operators import score as sc
    from earlywarn.operators import validate as va
    from earlywarn.operators.models import pass_probability

    rows = [(i, i % 3 > 0 or i % 7 == 0, None if i % 11 == 0 else float(i % 5), None if i % 13 == 0 else i % 4,
             None if i % 17 == 0 else "uvw"[i % 3], i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame([(r[0], int(r[1]), *r[2:]) for r in rows], "row_id long, target int, a double, b int, c string, e boolean")
    new = df.unionByName(spark.createDataFrame([(900, 1, float("nan"), 2, "other", None), (901, 0, None, None, None, True)], df.schema)).drop("target")
    for name, params in (("Logistic Regression", {"C": 1.0, "l1_ratio": 0.0}), ("Logistic Regression", {"C": 0.05, "l1_ratio": 1.0})):
        model = va.fit_pipeline(df, name, params, exclude=())
        assert sc.linear_probability(model) is not None
        out = model.transform(new)
        want = {r.row_id: r for r in out.select(*new.columns, pass_probability(out).alias("y_prob")).collect()}
        scored = sc.model_scorer(model)(new)
        got = {r.row_id: r for r in scored.collect()}
        assert got.keys() == want.keys() and scored.columns == [*new.columns, "y_prob"]
        for k, w in want.items():
            assert got[k].y_prob == pytest.approx(w.y_prob, abs=1e-12)
            assert [got[k][c] for c in new.columns] == [w[c] for c in new.columns]
        assert "UDF" not in scored._jdf.queryExecution().executedPlan().toString()
    assert sc.linear_probability(va.fit_pipeline(df, "Decision Tree", {"max_depth": 2}, exclude=())) is None


def test_orders_of_features_by_comparison(spark, monkeypatch):
    """Comparing hashes with each other gives the orders of the sort."""
    from earlywarn.operators import score as sc

    names = list("abcd")
    df = spark.createDataFrame([(i, *[float((i * j) % 7) for j in (1, 2, 3, 5)]) for i in range(40)], "row_id long, a double, b double, c double, d double")
    scorer = sc.linear_scorer(0.1, {c: 0.1 * (j + 1) for j, c in enumerate(names)})
    got = {(r.row_id, r.feature): (r.base, r.phi) for r in sc.permutation_contributions(df, scorer, df.limit(9), names, n_perm=3).collect()}
    monkeypatch.setattr(sc, "MAX_COMPARED", 0)
    want = {(r.row_id, r.feature): (r.base, r.phi) for r in sc.permutation_contributions(df, scorer, df.limit(9), names, n_perm=3).collect()}
    assert got == want and len(got) == 160
