"""Label rules and audit on hand cases."""

import pytest
from pyspark.sql import functions as F

from earlywarn.operators import audit, label


def test_normalize_label_text(spark):
    df = spark.createDataFrame([(" Pass",), ("AT RISK",), ("0",), ("true",)], "target string")
    assert [r.target for r in label.normalize_label(df).collect()] == [1, 0, 0, 1]


def test_normalize_label_unknown_raises(spark):
    df = spark.createDataFrame([("maybe",)], "target string")
    with pytest.raises(Exception, match="unrecognised label"):
        label.normalize_label(df).collect()


def test_derive_target_non_numeric_raises(spark):
    df = spark.createDataFrame([("12",), ("x",)], "G3 string")
    with pytest.raises(Exception, match="non-numeric"):
        label.derive_target(df).collect()


def test_prepare_features_drops_and_guards(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 1)], "a int, G1 int, G2 int, G3 int, target int")
    assert label.prepare_features(df).columns == ["a"]
    assert label.prepare_features(df, include_prior_grades=True).columns == ["a", "G1", "G2"]
    with pytest.raises(ValueError):
        label.prepare_features(df.select("G3", "target"))


def test_assert_binary(spark):
    ok = spark.createDataFrame([(0,), (1,), (1,)], "target int")
    bad = spark.createDataFrame([(1,), (1,)], "target int")
    assert label.assert_binary(ok).first().is_binary
    assert not label.assert_binary(bad).first().is_binary
    with pytest.raises(ValueError):
        label.require_binary(bad)


def test_audit_counts(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, 1.0)], "k int, s string, x double")
    out = {r.check: r.value for r in audit.quality_audit(df).collect()}
    assert out["Rows"] == "3" and out["Missing cells"] == "3" and out["Duplicate rows"] == "1"
    assert out["Constant columns"] == "0"


def test_fingerprint_order_free(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 7).alias("m"))
    a = audit.fingerprint(df).first()[0]
    b = audit.fingerprint(df.repartition(5).orderBy(F.rand(3))).first()[0]
    assert a == b and len(a) == 16


def test_median_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double").withColumn("g", F.lit(1))
    r = audit.profile_by(df, ["g"], "v").first()
    assert r.median == 2.5


def test_cluster_conf_sizes_partitions():
    from earlywarn.session import cluster_conf

    c = cluster_conf(100 * (1 << 40), executors=1000, cores=4)  # 100 TiB
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * (1 << 40) // (256 << 20)
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    small = cluster_conf(1 << 30, executors=10, cores=4)
    assert int(small["spark.sql.shuffle.partitions"]) == 80  # at least two waves over the cores
