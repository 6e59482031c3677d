"""Missing values: null groups, NaN and boolean features, null labels, sure votes."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from earlywarn.functions.ranking import global_row_number
from earlywarn.operators import audit, calibration, curves, evaluate, knn, label, prep, score, summary, threshold, validate


@pytest.fixture(scope="module")
def groups(spark):
    """The same rows as group 'x' and as the null group."""
    rows = [(g, i % 3 != 0, (i * 37 % 100) / 100) for g in ("x", None) for i in range(60)]
    return spark.createDataFrame(rows, "g string, t boolean, y_prob double").withColumn("y_true", F.col("t").cast("int"))


def same_for_both(df, drop=("g",)):
    rows = df.collect()
    part = {g: sorted(tuple(r[c] for c in df.columns if c not in drop) for r in rows if r.g == g) for g in ("x", None)}
    assert part["x"] and part["x"] == part[None]


def test_null_group_is_a_group(spark, groups):
    same_for_both(threshold.threshold_cost(groups, by=["g"]))
    same_for_both(evaluate.outcome_counts(groups, 0.5, by=["g"]))
    same_for_both(curves.roc_auc(groups, ["g"]))
    same_for_both(curves.average_precision(groups, ["g"]))
    same_for_both(curves.roc_curve(groups, ["g"]).fillna(-1.0, ["threshold"]))
    same_for_both(curves.pr_curve(groups, ["g"]).fillna(-1.0, ["threshold"]))
    same_for_both(calibration.calibration(groups, 8, ["g"]))
    same_for_both(audit.box_stats(groups, ["g"], "y_prob"))
    same_for_both(audit.profile_by(groups, ["g"], "y_prob"))
    same_for_both(evaluate.metrics_at(groups, 0.5, ["g"]))


def test_nan_is_a_missing_value(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    out = Pipeline(stages=prep.numeric_stage(["v"])).fit(df).transform(df)
    assert [round(r.v, 6) for r in out.collect()] == [round(x, 6) for x in (-1 / np.sqrt(0.5), 0.0, 0.0, 1 / np.sqrt(0.5))]


def test_boolean_features(spark):
    df = spark.createDataFrame([(True, 1.0), (False, 2.0), (None, 3.0), (True, 4.0)], "b boolean, v double")
    out = prep.preprocessor(["b"], ["v"]).fit(df).transform(df).select(vector_to_array("features").alias("f")).collect()
    assert [list(r.f[:2]) for r in out] == [[1, 0], [0, 1], [1, 0], [1, 0]]


def test_null_label_is_an_error(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 1)], "row_id long, target int")
    with pytest.raises(Exception, match="null in label"):
        validate.assign_folds(df, 2).collect()


def test_uplift_finds_the_zoo_baseline(spark):
    rows = [(m, o, "macro_f1", s, 0.0) for o, (m, s) in enumerate([("Dummy Baseline", 0.4), ("KNN", 0.7)])]
    df = spark.createDataFrame(rows, "model string, model_order int, metric string, mean double, std double")
    assert {r.model: round(r.uplift, 6) for r in summary.uplift(df).collect()} == {"Dummy Baseline": 0.0, "KNN": 0.3}


def test_row_ids_along_a_text(spark):
    df = spark.range(5000).select(F.concat(F.lit("n"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("string")).alias("name"), "id")
    out = global_row_number(df, [], ["name", "id"])
    rows = sorted((r.name, r.id, r.rn) for r in out.collect())
    assert [r[2] for r in rows] == list(range(1, 5001))


def test_sure_votes_have_contributions(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 0.0)], "row_id long, a double, b double")
    sure = lambda x: x.withColumn("y_prob", F.when(F.col("a") > 0.5, 1.0).otherwise(0.0))
    out = score.permutation_contributions(df, sure, df, ["a", "b"], n_perm=4)
    assert all(np.isfinite(r.phi) and np.isfinite(r.base) for r in out.collect())


def test_knn_tiles_keep_order(monkeypatch):
    r = np.random.default_rng(1)
    key = r.integers(0, 6, (50, 90)).astype(float)
    want = np.argsort(key, axis=1, kind="stable")[:, :7]
    assert (knn.smallest(key, 7) == want).all()
    assert (knn.smallest(key[:, :5], 7) == np.argsort(key[:, :5], axis=1, kind="stable")).all()


def test_one_candidate_is_scored(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 2) + (i % 5) / 10) for i in range(40)], "row_id long, target int, v double")
    _, table = validate.grid_search(validate.assign_folds(df, 2), "Decision Tree", [{"max_depth": 3}])
    assert table[0]["mean_macro_f1"] == pytest.approx(1.0)


def test_all_missed_cases(spark, groups):
    df = groups.withColumn("row_id", F.monotonically_increasing_id())
    every = evaluate.missed_cases(df, 0.5, n=None).count()
    assert every == df.filter("y_true = 0 and y_prob >= 0.5").count() > 5
    assert evaluate.missed_cases(df, 0.5, n=5).count() == 5


def test_label_messages(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "target int")
    with pytest.raises(ValueError, match="0,1,2"):
        label.require_binary(df)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|", "~"])
def test_separators_are_found(spark, tmp_path, sep):
    from earlywarn.sources import io

    path = tmp_path / "t.csv"
    path.write_text(f' a {sep}b{sep}"c,;|"\n1{sep}"x,y;z"{sep}2\n3{sep}q{sep}4\n')
    out = io.read_delimited(spark, str(path))
    assert out.columns == ["a", "b", "c,;|"]
    assert [tuple(r) for r in out.orderBy("a").collect()] == [(1, "x,y;z", 2), (3, "q", 4)]


def test_only_a_missing_model_is_passed_over(spark, tmp_path):
    from earlywarn.sources import io

    with pytest.raises(FileNotFoundError, match="a: not found"):
        io.resolve_model([("a", str(tmp_path / "none"))])
    bad = tmp_path / "bad" / "metadata"
    bad.mkdir(parents=True)
    (bad / "part-00000").write_text("not a model\n")
    with pytest.raises(Exception) as e:
        io.resolve_model([("bad", str(tmp_path / "bad")), ("b", str(tmp_path / "none"))])
    assert not isinstance(e.value, FileNotFoundError)
