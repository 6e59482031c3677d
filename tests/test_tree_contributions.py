"""Contributions of tree ensembles against all coalitions, and of the background pairing."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from earlywarn.operators import score as sc, tree_contributions as tc, validate as va
from earlywarn.plans import q_models as qm

SF = "/root/testdata/sf0.001"


def _margin(nodes, x):
    total = 0.0
    for tree in sorted({t for t, _ in nodes}):
        n = nodes[tree, 0]
        while n["feature"] is not None:
            v = x[n["feature"]]
            left = v in n["left_categories"] if n["threshold"] is None else v <= n["threshold"]
            n = nodes[tree, n["left"] if left else n["right"]]
        total += n["weight"] * n["value"]
    return total


def _shapley(nodes, x, background):
    p = len(x)

    def value(s):
        return np.mean([_margin(nodes, [x[i] if i in s else z[i] for i in range(p)]) for z in background])

    v = {s: value(set(s)) for r in range(p + 1) for s in itertools.combinations(range(p), r)}
    phi = []
    for i in range(p):
        others = [j for j in range(p) if j != i]
        phi.append(sum(math.factorial(r) * math.factorial(p - r - 1) / math.factorial(p) * (v[tuple(sorted((*s, i)))] - v[s])
                       for r in range(p) for s in itertools.combinations(others, r)))
    return v[()], phi


def _rows(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i if i else None, *map(float, rng.integers(0, 5, 3)), float(rng.normal())) for i in range(n)]
    rows.append(rows[3])  # a repeated row
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double")
    return df.withColumn("target", F.when(F.col("a") * 2 - F.col("b") + F.col("d") > 2, 1).otherwise(0))


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_equal_to_all_coalitions(spark, depth):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(_rows(spark))
    model = GBTClassifier(labelCol="target", maxIter=4, maxDepth=depth, stepSize=0.3, seed=42).fit(df)
    table = tc.node_table(model)
    nodes = {(r["tree"], r["node"]): r for r in table.collect()}
    names = ["a", "b", "c", "d"]
    got = tc.tree_contributions(df, df.limit(9), table, vector_to_array("features"), names).collect()
    back = [list(r.features) for r in df.limit(9).collect()]
    rows = df.collect()
    assert len(got) == 4 * len(rows) and sum(r.row_id is None for r in got) == 4
    of = {}
    for r in got:
        of.setdefault((r.row_id, r.feature), []).append(r)
    for r in rows[:12]:
        base, phi = _shapley(nodes, list(r.features), back)
        for name, want in zip(names, phi):
            for g in of[r.row_id, name]:
                assert g.phi == pytest.approx(want, abs=1e-9) and g.base == pytest.approx(base, abs=1e-9)
                assert g.value == r[name]


def test_boosting_adds_up_to_the_log_odds(spark):
    """One-hot columns (categorical splits) and scaled numbers, every learner."""
    lr = qm._learners(spark, SF)
    model = va.fit_pipeline(lr, "Gradient Boosting", {"n_estimators": 15, "learning_rate": 0.3, "max_depth": 3}, "target", "row_id", ())
    c = tc.boosting_contributions(lr, model, lr)  # all learners as background
    per = c.groupBy("row_id").agg((F.sum("phi") + F.first("base")).alias("t"), F.first("margin").alias("m"), F.count("feature").alias("k"))
    out = model.transform(lr).select("row_id", vector_to_array("rawPrediction")[1].alias("raw"), F.size(vector_to_array("features")).alias("p"))
    r = per.join(out, "row_id").agg(F.count("*"), F.max(F.abs(F.col("t") - 2 * F.col("raw"))), F.max(F.abs(F.col("m") - F.col("t"))),
                                    F.max(F.abs(F.col("k") - F.col("p")))).first()
    assert r[0] == lr.count() and r[1] < 1e-6 and r[2] < 1e-6 and r[3] == 0
    assert abs(c.groupBy("row_id").agg(F.first("margin").alias("m"), F.first("base").alias("b")).agg(F.avg("m") - F.avg("b")).first()[0]) < 1e-6


def test_odd_tables(spark):
    nodes = spark.createDataFrame([(0, 1.0, 0, 0, 0.5, None, 1, 2, None, None, None), (0, 1.0, 1, None, None, None, None, None, -1.0, None, None),
                                   (0, 1.0, 2, None, None, None, None, None, 3.0, None, None),
                                   (1, 2.0, 0, None, None, None, None, None, 0.25, None, None)], tc.NODE_SCHEMA)  # the second tree is one leaf
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None)], "row_id long, x double")
    x = F.array("x")
    got = {r.row_id: (r.base, r.margin, r.phi) for r in tc.tree_contributions(df, df.filter("row_id < 3"), nodes, x, ["x"]).collect()}
    assert got == {1: (1.5, -0.5, -2.0), 2: (1.5, 3.5, 2.0), 3: (1.5, 3.5, 2.0)}
    assert tc.tree_contributions(df.limit(0), df, nodes, x, ["x"]).collect() == []
    with pytest.raises(ValueError, match="background"):
        tc.tree_contributions(df, df.limit(0), nodes, x, ["x"])


def test_background_numbers_are_gapless(spark):
    df = _rows(spark).select("a", "b").union(spark.createDataFrame([(None, 1.0), (None, 1.0), (2.0, None)], "a double, b double"))
    got = sc.background_slots(df, ["a", "b"]).orderBy("_b").collect()
    assert [r["_b"] for r in got] == list(range(df.count()))
    key = lambda r: tuple((v is not None, v or 0.0) for v in r)
    assert [tuple(r["_bgrow"]) for r in got] == sorted((tuple(r) for r in df.collect()), key=key)


def test_permutations_with_a_large_background(spark):
    """More rows than the former limit of 10,000."""
    bg = spark.range(12_345).select((F.col("id") % 9973 / 7).alias("a"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("b"))
    df = spark.createDataFrame([(i, float(i % 4), float(i % 3)) for i in range(10)], "row_id long, a double, b double")
    c = sc.permutation_contributions(df, sc.linear_scorer(0.2, {"a": 0.001, "b": -0.04}), bg, ["a", "b"], n_perm=3)
    tot = c.groupBy("row_id").agg((F.sum("phi") + F.first("base")).alias("t"))
    z = df.select("row_id", (0.2 + 0.001 * F.col("a") - 0.04 * F.col("b")).alias("z"))
    n, err = tot.join(z, "row_id").agg(F.count("*"), F.max(F.abs(F.col("t") - F.col("z")))).first()
    assert n == 10 and err < 1e-9
    with pytest.raises(ValueError, match="background"):
        sc.permutation_contributions(df, sc.linear_scorer(0.2, {"a": 0.001}), bg.limit(0), ["a", "b"])
