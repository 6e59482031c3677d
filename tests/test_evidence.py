"""Evidence bundles (commit point, manifest, trained models), label and pairing checks, duplicates by mark."""

import json

import pytest
from pyspark.sql import functions as F

from earlywarn.functions.ranking import MD5, bounds_below, global_row_number
from earlywarn.operators import audit, evaluate as ev, knn, label, report, stats as st, validate as va
from earlywarn.session import scratch_path


def _tables(spark, n):
    return {"rows": spark.range(n).select("id", (F.col("id") / 3).alias("v")), "summary": spark.range(1).select(F.lit("a\nb").alias("s"))}


def test_bundle_reads_the_last_committed_version(spark):
    path = scratch_path(spark, "bundle")
    with pytest.raises(FileNotFoundError):
        report.read_evidence(spark, path)
    manifest = {r.artifact: r for r in report.write_evidence(_tables(spark, 5), path, params={"c": 1}).collect()}
    assert {k: r.rows for k, r in manifest.items()} == {"rows": 5, "summary": 2, "best_parameters": 1}
    first = report.committed_version(spark, path)
    # a write that fails half-way leaves the version before it
    broken = _tables(spark, 9) | {"worse": spark.range(3).select(F.raise_error(F.lit("lost")).cast("int").alias("x"))}
    with pytest.raises(Exception, match="lost"):
        report.write_evidence(broken, path)
    assert report.committed_version(spark, path) == first
    got = report.read_evidence(spark, path)
    assert got["rows"].count() == 5 and sorted(r.value for r in got["summary"].collect()) == ["a", "b"]
    assert json.loads(got["best_parameters"].first().value) == {"c": 1}
    # a whole write takes its place
    report.write_evidence(_tables(spark, 7), path)
    assert report.committed_version(spark, path) != first
    assert report.read_evidence(spark, path, ["rows"])["rows"].count() == 7
    with pytest.raises(KeyError):
        report.read_evidence(spark, path, ["best_parameters"])


def test_changed_table_is_refused(spark):
    path = scratch_path(spark, "bundle")
    report.write_evidence(_tables(spark, 5), path)
    root = report.committed_version(spark, path)
    # as many rows, one of another value
    spark.range(5).select("id", F.when(F.col("id") == 4, 0.5).otherwise(F.col("id") / 3).alias("v")).write.mode("overwrite").parquet(f"{root}/rows")
    with pytest.raises(ValueError, match="manifest"):
        report.read_evidence(spark, path, ["rows"])
    assert report.read_evidence(spark, path, ["summary"])["summary"].count() == 2


def _small(spark, n=120):
    x = F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0
    return spark.range(n).select(F.col("id").alias("row_id"), x.alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"),
                                 (x + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 300.0 > 0.6).cast("int").alias("target"))


def test_trained_bundle_saves_every_model(spark):
    df = _small(spark)
    path = scratch_path(spark, "trained")
    grids = {"Dummy Baseline": [{}], "Logistic Regression": [{"C": 1.0, "l1_ratio": 0.0}], "KNN": [{"n_neighbors": 3, "weights": "uniform"}]}
    models = va.train_bundle(df, path, grids, outer=3, inner=2, excluded=("grade",))
    got = report.read_evidence(spark, path)
    assert {r.model for r in got["leaderboard"].collect()} == set(grids)
    assert got["oof"].count() == 3 * 120
    meta = got["metadata"].first()
    assert (meta.folds, meta.inner_folds, meta.rows, meta.features) == (3, 2, 120, 2)
    assert meta.created_utc.endswith("Z") and meta.spark_version and meta.python_version
    chosen = json.loads(got["best_parameters"].first().value)
    assert chosen["model"] == meta.best_model and chosen["parameters"] == grids[meta.best_model][0]
    text = "\n".join(r.value for r in got["executive_summary"].collect())
    assert "3 outer x 2 inner" in text and meta.fingerprint in text and "Left out of the inputs: grade" in text
    loaded = report.read_model(spark, path, "Logistic Regression")
    a, b = ([r.probability for r in m.transform(df).orderBy("row_id").select("probability").collect()] for m in (models["Logistic Regression"], loaded))
    assert a == b
    # k-NN votes from the rows in the bundle as from the rows it was trained on
    test = report.read_model(spark, path, "KNN").transform(df)
    votes = [sorted(map(tuple, knn.knn_classify(base, test, 3).collect())) for base in (got["knn_rows"], models["KNN"].transform(df))]
    assert votes[0] == votes[1] and len(votes[0]) == 120


def test_training_needs_both_classes(spark):
    one = _small(spark).withColumn("target", F.lit(1))
    for run in (lambda: va.nested_cv(one, {"Dummy Baseline": [{}]}), lambda: va.random_search(one, "Logistic Regression", 2),
                lambda: va.fit_final(one, "Logistic Regression", [{"C": 1.0, "l1_ratio": 0.0}])):
        with pytest.raises(ValueError, match="0 and 1"):
            run()


def test_listing_of_labels_says_when_it_is_cut(spark):
    many = spark.range(1000).select(F.col("id").alias("target"))
    r = label.assert_binary(many).first()
    assert r.classes.split(",") == sorted(map(str, range(1000)))[:20]
    assert (r.n_classes, r.is_binary, r.truncated) == (1000, False, True)
    assert label.assert_binary(many.limit(0)).first()["is_binary"] is False
    assert label.assert_binary(spark.range(2).select(F.col("id").alias("target"))).first()["truncated"] is False
    words = spark.createDataFrame([("yes",), ("no",)], "target string")
    assert label.assert_binary(words).first()["is_binary"] is False
    with pytest.raises(ValueError, match="1000 in all"):
        label.require_binary(many)


@pytest.mark.parametrize("left,right", [([1, 2, 3], [1, 2]), ([1, 2], [1, 2, 3]), ([1, 2, 2], [1, 2]), ([1, 2], [1, 2, 2]), ([1, None], [1, None])])
def test_unpaired_predictions_are_an_error(spark, left, right):
    f = spark.createDataFrame([(x, "f") for x in left], "row_id long, a string")
    o = spark.createDataFrame([(x, 0.5) for x in right], "row_id long, y_prob double")
    with pytest.raises(Exception, match="not one row of features and one prediction"):
        ev.attach_predictions(f, o).collect()


def test_paired_predictions(spark):
    f = spark.createDataFrame([(1, "f"), (2, "g")], "row_id long, a string")
    o = spark.createDataFrame([(2, 0.5), (1, 0.25)], "row_id long, y_prob double")
    assert sorted(map(tuple, ev.attach_predictions(f, o).collect())) == [(1, "f", 0.25), (2, "g", 0.5)]


def test_duplicates_by_mark(spark):
    rows = [(1, None, 2.0)] * 40 + [(None, 1, 2.0), (1, None, float("nan")), (1, None, float("nan")), (None, None, None), (None, None, None), (5, 5, 0.0)]
    df = spark.createDataFrame(rows, "a int, b int, c double").repartition(4)
    assert audit.duplicate_rows(df).first()[0] == 39 + 1 + 1
    # whatever marks collide: all of them, or none that differ
    one = F.struct(F.lit(3).cast("long").alias("m1"), F.lit(3).cast("long").alias("m2"))
    few = F.struct((F.xxhash64("a") % 2).alias("m1"), F.lit(-1).cast("long").alias("m2"))
    assert audit.duplicate_rows(df, one).first()[0] == audit.duplicate_rows(df, few).first()[0] == 41
    assert audit.duplicate_rows(df.limit(0)).first()[0] == 0
    assert audit.duplicate_rows(df.distinct()).first()[0] == 0


def test_friedman_counts_the_models(spark):
    scores = [("e", m, f, float((f * 7 + i * 3) % 5) + i) for i, m in enumerate("abcd") for f in range(6)]
    scores += [("g", m, f, float((f * 5 + i) % 3) - i) for i, m in enumerate("ab") for f in range(6)] + [("h", "a", f, 1.0) for f in range(3)]
    df = spark.createDataFrame(scores, "exp string, model string, fold int, score double")
    got = {r.exp: r for r in st.friedman(df, ["exp"]).collect()}
    assert (got["e"].k, got["g"].k, got["h"].k) == (4, 2, 1) and got["h"].p_value is None
    for e, dof in (("e", 3), ("g", 1)):
        want = spark.range(1).select(st.chi2_sf(F.lit(got[e].statistic), dof)).first()[0]
        assert got[e].p_value == pytest.approx(want, abs=1e-12)
    table = spark.range(1, 12).select("id", st.chi2_sf_by(F.lit(4.5), F.col("id")).alias("p"))
    for r in table.collect():
        assert r.p == pytest.approx(spark.range(1).select(st.chi2_sf(F.lit(4.5), int(r.id))).first()[0], abs=1e-12)


def test_binary_search_of_bounds(spark):
    b = [0.1, 0.2, 0.2, 0.2, 0.7]
    df = spark.createDataFrame([(b, x) for x in (0.0, 0.1, 0.15, 0.2, 0.5, 0.7, 0.9)] + [([], 0.3)], "b array<double>, x double")
    got = [(r.lo, r.hi) for r in df.select(bounds_below("b", F.col("x"), False).alias("lo"), bounds_below("b", F.col("x"), True).alias("hi")).collect()]
    assert got == [(0, 0), (0, 1), (1, 1), (1, 4), (4, 4), (4, 5), (5, 5), (0, 0)]


def test_md5_slices_follow_the_rows(spark, monkeypatch):
    from earlywarn.functions import ranking

    monkeypatch.setattr(ranking, "SLICE_ROWS", 7)
    df = spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("k"))
    assert ranking.with_md5_slice(df, "k", "s").agg(F.countDistinct("s")).first()[0] > 60
    got = [r.id for r in global_row_number(df, [], ["k"], slicer=MD5).orderBy("rn").collect()]
    assert got == [r.id for r in df.orderBy("k").collect()]


def test_candidate_join_finds_the_neighbours(spark):
    """Scores are exact; the recall against the exact join is 0.9 or more."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").filter("embedding is not null")
    args = (v, v, 5, "vec_id", "vec_id", "embedding", "embedding")
    exact = knn.knn_join(*args, exclude_self=True).select("q_id", "n_id", "score")
    found = knn.knn_candidates(*args, exclude_self=True, bits=4).select("q_id", "n_id", "score")
    want, got = ({(r.q_id, r.n_id): r.score for r in x.collect()} for x in (exact, found))
    assert len(got) == len(want)
    assert all(got[p] == want[p] for p in got if p in want)
    assert len(set(got) & set(want)) >= 0.9 * len(want)


@pytest.mark.parametrize("metric", ["ip", "euclidean"])
def test_candidate_join_is_whole_where_buckets_are(spark, metric):
    """One bucket, split into chunks, with a third of equal vectors, ties and nulls: the exact answer."""
    v = F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.pmod("id", F.lit(11)) / 3.0, F.pmod("id", F.lit(7)) * 1.0))
    df = spark.range(200).select("id", v.alias("v")).union(spark.createDataFrame([(None, [1.0, 1.0]), (900, None)], "id long, v array<double>"))
    exact = df.filter("id is not null and v is not null")
    for self_ in (True, False):
        want = knn.knn_join(exact, exact, 4, "id", "id", "v", "v", metric=metric, exclude_self=self_)
        got = knn.knn_candidates(df, df, 4, "id", "id", "v", "v", metric=metric, exclude_self=self_, tables=2, probes=1, bits=1, block_rows=16)
        assert sorted(map(tuple, got.select("q_id", "rank", "n_id", "score").collect())) == sorted(map(tuple, want.select("q_id", "rank", "n_id", "score").collect()))
    assert knn.knn_candidates(df, df.limit(0), 4, "id", "id", "v", "v").count() == 0
