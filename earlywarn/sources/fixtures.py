"""Analysis inputs derived from the driver tables (see FIXTURES.md).

The reference works on one student table and the out-of-fold predictions of
its models. These builders derive tables with the same roles from the TPC-H
style tables so that every operator runs on data that grows with the scale
factor.  Each expression has a twin in ``earlywarn.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.functions.hashing import md5_order, u
from earlywarn.functions.ranking import MD5, global_row_number
from earlywarn.sources.tables import table


def learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per order, student-like features with a planted signal."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    g3 = F.least(F.lit(20), F.floor(F.col("o_totalprice") / F.lit(15000.0))).cast("int")
    base = o.join(c, o.o_custkey == c.c_custkey, "inner").withColumn("g3", g3)
    rid = F.col("o_orderkey")
    risk = F.lit(1.0) - F.col("g3") / F.lit(20.0)
    return base.select(
        rid.alias("row_id"),
        F.col("c_mktsegment").alias("school"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("sex"),
        (F.lit(15) + F.col("o_custkey") % 8).cast("int").alias("age"),
        F.col("o_orderpriority").alias("mjob"),
        F.when(rid % 3 == 0, F.lit("yes")).otherwise(F.lit("no")).alias("famsup"),
        F.when(rid % 5 == 0, F.lit("yes")).otherwise(F.lit("no")).alias("schoolsup"),
        F.floor(F.lit(3.999) * (F.lit(0.6) * risk + F.lit(0.4) * u("f", "o_orderkey"))).cast("int").alias("failures"),
        F.floor(F.lit(30.0) * (F.lit(0.5) * risk + F.lit(0.5) * u("a", "o_orderkey"))).cast("int").alias("absences"),
        (F.lit(1) + F.floor(F.lit(3.999) * (F.lit(0.5) * F.col("g3") / F.lit(20.0) + F.lit(0.5) * u("s", "o_orderkey")))).cast("int").alias("studytime"),
        F.greatest(F.lit(0), F.col("g3") - 1 - (rid % 3).cast("int")).cast("int").alias("g1"),
        F.least(F.lit(20), F.col("g3") + (rid % 2).cast("int")).cast("int").alias("g2"),
        F.col("g3"),
    )


def learners_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from earlywarn.operators.label import derive_target

    return derive_target(learners(spark, sf_dir), grade="g3", threshold=10)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one model's out-of-fold table (row_id, grp, y_true, y_prob)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderstatus").alias("grp"),
        (F.col("o_totalprice") >= F.lit(150000.0)).cast("int").alias("y_true"),
        F.round(
            F.lit(0.55) * F.least(F.lit(1.0), F.col("o_totalprice") / F.lit(500000.0)) + F.lit(0.45) * u("42", "o_orderkey"), 3
        ).alias("y_prob"),
    )


MODELS = (("baseline", 1), ("alpha", 2), ("beta", 3))


def oof(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """out-of-fold predictions of three models with stratified folds.

    The fold of a row depends only on its label and key (not on the model),
    so folds are dealt once per row and the rows are then expanded to the
    three models.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    base = o.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderstatus").alias("grp"),
        (F.col("o_totalprice") >= F.lit(150000.0)).cast("int").alias("y_true"),
        F.least(F.lit(1.0), F.col("o_totalprice") / F.lit(500000.0)).alias("_price"),
    ).withColumn("_k", md5_order("42|fold", "row_id"))
    rn = global_row_number(base, ["y_true"], ["_k", "row_id"], name="_rn", slicer=MD5)
    folded = rn.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_k", "_rn")
    price = F.col("_price")
    models = F.array(
        F.struct(F.lit("baseline").alias("model"), F.lit(1).alias("model_order"), F.lit(0.7).alias("y_prob")),
        F.struct(F.lit("alpha").alias("model"), F.lit(2).alias("model_order"),
                 F.round(F.lit(0.55) * price + F.lit(0.45) * u("42", "row_id"), 3).alias("y_prob")),
        F.struct(F.lit("beta").alias("model"), F.lit(3).alias("model_order"),
                 F.round(F.lit(0.35) * price + F.lit(0.65) * u("43", "row_id"), 3).alias("y_prob")),
    )
    rows = folded.select("row_id", "grp", "y_true", "fold", F.inline(models))
    return rows.withColumn("y_pred", (F.col("y_prob") >= F.lit(0.5)).cast("int")).select(
        "row_id", "grp", "y_true", "model", "model_order", "y_prob", "y_pred", "fold")


def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro-F1 per (model, fold) from F3."""
    from earlywarn.operators.evaluate import classification_metrics

    m = classification_metrics(oof(spark, sf_dir), by=["model", "model_order", "fold"], with_ranking=False)
    return m.select("model", "model_order", "fold", F.col("macro_f1").alias("score"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with planted nulls, a constant column and duplicated rows."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    base = c.select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        F.when(F.col("c_custkey") % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.lit(1).alias("const"),
    )
    return base.unionByName(base.filter(F.col("c_custkey") % 50 == 0))


RAW_LABEL_TEXTS = (" Pass", "PASSED ", "yes", "True", "fail", "Failed", "risk", "At Risk", "at-risk", "No", "false", "1", "0")


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: orders with a text label chosen by o_orderkey % 13."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    texts = F.array(*[F.lit(t) for t in RAW_LABEL_TEXTS])
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.element_at(texts, (F.col("o_orderkey") % 13 + 1).cast("int")).alias("target"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the embeddings table as (vec_id, embedding, label)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


# Fixed scorer used where an oracle must reproduce model output exactly.
FIXED_INTERCEPT = 1.2
FIXED_COEF = {"failures": -0.9, "absences": -0.05, "studytime": 0.4}

# Fixed trees for the same purpose: (weight, {node: (feature, threshold, left, right) or a leaf value}).
FIXED_TREES = (
    (1.0, {0: ("failures", 0.5, 1, 2), 1: ("absences", 6.5, 3, 4), 2: ("studytime", 1.5, 5, 6), 3: 0.812937461, 4: 0.307114829, 5: -0.904862173, 6: -0.215739048}),
    (0.5, {0: ("absences", 10.5, 1, 2), 1: ("absences", 3.5, 3, 4), 2: ("failures", 1.5, 5, 6), 3: 0.418273659, 4: 0.103958247, 5: -0.296417583, 6: -0.731850264}),
    (0.25, {0: ("studytime", 2.5, 1, 2), 1: ("failures", 0.5, 3, 4), 2: 0.253719846, 3: ("absences", 20.5, 5, 6), 4: -0.408261957, 5: 0.117392548,
            6: -0.620581437}),
)


def fixed_nodes(spark: SparkSession, features: list[str]) -> DataFrame:
    """``FIXED_TREES`` as a node table over the positions of ``features``."""
    from earlywarn.operators.tree_contributions import NODE_SCHEMA

    rows = []
    for t, (weight, tree) in enumerate(FIXED_TREES):
        for node, n in tree.items():
            inner = (features.index(n[0]), n[1], None, n[2], n[3], None) if isinstance(n, tuple) else (None, None, None, None, None, n)
            rows.append((t, weight, node, *inner, None, None))
    return spark.createDataFrame(rows, NODE_SCHEMA)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a search history, one trial per supplier: C log-uniform in [1e-3, 1e2],
    l1 in {0, 1} and a score in [0.5, 0.7)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return s.select(
        F.col("s_suppkey").alias("trial"),
        F.pow(F.lit(10.0), F.lit(-3.0) + F.lit(5.0) * u("C", "s_suppkey")).alias("c"),
        F.floor(F.lit(2.0) * u("l1", "s_suppkey")).cast("int").alias("l1"),
        F.round(F.lit(0.5) + F.lit(0.2) * u("v", "s_suppkey"), 4).alias("value"),
    )
