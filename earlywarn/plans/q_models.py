"""Preparation, folds, models, selection and search queries."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from earlywarn.operators import knn, prep, search, validate as va
from earlywarn.operators.models import GRIDS, MajorityClass
from earlywarn.plans.catalog import query
from earlywarn.plans.oracle_sql import DIRTY, LEARNERS, r6, with_ctes
from earlywarn.sources import fixtures as fx

L = with_ctes(LEARNERS)

FEATURES = ["row_id", "school", "sex", "age", "mjob", "famsup", "schoolsup", "failures", "absences", "studytime", "target"]


def _learners(spark, d):
    return fx.learners_labelled(spark, d).select(*FEATURES)


_FOLDS_SQL = L + """SELECT row_id, target, CAST((row_number() OVER (PARTITION BY target ORDER BY md5('42|fold|' || CAST(row_id AS VARCHAR)), row_id) - 1) % 5 AS INTEGER) AS fold
FROM learners_t"""


@query("assign_folds", _FOLDS_SQL)
def assign_folds(spark, d):
    """Stratified 5 folds, seed 42."""
    return va.assign_folds(_learners(spark, d).select("row_id", "target"), 5, 42)


_PREFIX_SQL = L + """, f AS (SELECT row_id, CAST((row_number() OVER (PARTITION BY target ORDER BY md5('42|fold|' || CAST(row_id AS VARCHAR)), row_id) - 1) % 3 AS INTEGER) AS fold FROM learners_t),
r AS (SELECT fold, row_id, row_number() OVER (PARTITION BY fold ORDER BY md5('42|size|' || CAST(row_id AS VARCHAR)), row_id) AS rn, count(*) OVER (PARTITION BY fold) AS n FROM f),
s AS (SELECT * FROM (VALUES (0.2e0), (0.4e0), (0.6e0), (0.8e0), (1.0e0)) v(size))
SELECT fold, size, count(*) AS n FROM r JOIN s ON r.rn <= greatest(1, floor(s.size * r.n)) GROUP BY fold, size"""


@query("training_prefixes", _PREFIX_SQL)
def training_prefixes(spark, d):
    """Nested 20-100 % training subsets per fold (sizes per fold)."""
    f = va.assign_folds(_learners(spark, d).select("row_id", "target"), 3, 42)
    return va.training_prefixes(f, [0.2, 0.4, 0.6, 0.8, 1.0]).groupBy("fold", "size").agg(F.count(F.lit(1)).alias("n"))


_NUM_SQL = with_ctes(DIRTY) + """, m AS (SELECT quantile_cont(c_acctbal, 0.5e0) AS med_a, quantile_cont(CAST(c_nationkey AS DOUBLE), 0.5e0) AS med_n FROM dirty),
f AS (SELECT c_custkey, COALESCE(c_acctbal, med_a) AS a, COALESCE(CAST(c_nationkey AS DOUBLE), med_n) AS n FROM dirty, m),
s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(n) AS mn, stddev_pop(n) AS sn FROM f)
SELECT c_custkey, (a - ma) / sa AS c_acctbal, (n - mn) / sn AS c_nationkey FROM f, s"""


@query("numeric_stage", r6(_NUM_SQL, "c_acctbal", "c_nationkey"))
def numeric_stage(spark, d):
    """Exact-median fill then population standardisation of F5."""
    df = fx.dirty(spark, d).select("c_custkey", "c_acctbal", "c_nationkey")
    m = Pipeline(stages=prep.numeric_stage(["c_acctbal", "c_nationkey"])).fit(df)
    return m.transform(df)


_MODE_SQL = with_ctes(DIRTY) + """, m AS (SELECT arg_min(v, struct_pack(a := -n, b := v)) AS mode FROM (SELECT c_mktsegment AS v, count(*) AS n FROM dirty WHERE c_mktsegment IS NOT NULL GROUP BY 1) x)
SELECT c_custkey, COALESCE(c_mktsegment, mode) AS c_mktsegment FROM dirty, m"""


@query("mode_imputer", _MODE_SQL)
def mode_imputer(spark, d):
    """M3: most-frequent fill of text nulls (smallest value on ties)."""
    df = fx.dirty(spark, d).select("c_custkey", "c_mktsegment")
    return prep.ModeImputer(inputCols=["c_mktsegment"]).fit(df).transform(df)


_OHE_SQL = L + """, r AS (SELECT mjob, CAST(row_number() OVER (ORDER BY n DESC, mjob) - 1 AS INTEGER) AS idx, count(*) OVER () AS k FROM (SELECT mjob, count(*) AS n FROM learners GROUP BY mjob) c)
SELECT l.row_id, l.mjob, r.idx AS mjob_index, CAST(r.k AS INTEGER) AS vector_size FROM learners l JOIN r USING (mjob)"""


@query("categorical_stage", _OHE_SQL)
def categorical_stage(spark, d):
    """M4: frequency-ordered index and one-hot of size k (unknown -> all zeros)."""
    df = fx.learners(spark, d).select("row_id", "mjob")
    stages, ohe = prep.categorical_stage(["mjob"])
    out = Pipeline(stages=stages).fit(df).transform(df)
    arr = vector_to_array(F.col(ohe[0]))
    return out.select("row_id", "mjob", (F.array_position(arr, 1.0) - 1).cast("int").alias("mjob_index"), F.size(arr).cast("int").alias("vector_size"))


@query("majority_class", r6(L + "SELECT CASE WHEN avg(CAST(target AS DOUBLE)) > 0.5e0 THEN 1 ELSE 0 END AS majority, avg(CAST(target AS DOUBLE)) AS share, CASE WHEN avg(CAST(target AS DOUBLE)) > 0.5e0 THEN 1e0 ELSE 0e0 END AS probability FROM learners_t", "share", "probability"))
def majority_class(spark, d):
    """M6: the baseline's fitted class, the pass share and the probability it gives every row."""
    df = _learners(spark, d)
    m = MajorityClass(labelCol="target").fit(df)
    p = m.transform(df).agg(F.max(vector_to_array("probability")[1]).alias("probability"))
    return p.select(F.lit(m.getOrDefault(m.majority)).alias("majority"), F.lit(m.getOrDefault(m.share)).alias("share"), "probability")


_KNN_SQL = """SELECT q_id, n_id, rank, score FROM (
  SELECT a.vec_id AS q_id, b.vec_id AS n_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score,
         CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS INTEGER) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) x WHERE rank <= 5"""


@query("knn_join", r6(_KNN_SQL, "score"))
def knn_join(spark, d):
    """Exact 5 nearest neighbours (inner product) of every embedding, itself excluded."""
    v = fx.vectors(spark, d)
    return knn.knn_join(v, v, 5, "vec_id", "vec_id", "embedding", "embedding", metric="ip", exclude_self=True) \
        .select("q_id", "n_id", F.col("rank").cast("int").alias("rank"), "score")


@query("knn_candidates", None)
def knn_candidates(spark, d):
    """J9, approximate: 5 nearest neighbours (inner product) of every embedding among the rows of its buckets."""
    v = fx.vectors(spark, d)
    return knn.knn_candidates(v, v, 5, "vec_id", "vec_id", "embedding", "embedding", metric="ip", exclude_self=True) \
        .select("q_id", "n_id", F.col("rank").cast("int").alias("rank"), "score")


_NCV_FOLDS = L + """, f AS (SELECT row_id, target, CAST((row_number() OVER (PARTITION BY target ORDER BY md5('42|fold|' || CAST(row_id AS VARCHAR)), row_id) - 1) % 5 AS INTEGER) AS fold FROM learners_t)
SELECT m.model, f.fold, count(*) AS n, CAST(sum(1 - f.target) AS BIGINT) AS n_risk
FROM f CROSS JOIN (VALUES """ + ", ".join(f"('{m}')" for m in GRIDS) + """) m(model) GROUP BY m.model, f.fold"""


def _ncv(spark, d, models=GRIDS):
    return va.nested_cv(_learners(spark, d), models, outer=5, inner=5)


@query("nested_cv", None)
def nested_cv(spark, d):
    """Nested CV (5 outer x 5 inner) of the whole grid, seven families: the fold-metrics table."""
    return _ncv(spark, d)[1]


@query("nested_cv_folds", _NCV_FOLDS)
def nested_cv_folds(spark, d):
    """M16 invariant, whole grid: one OOF row per (row, model); fold sizes and risk counts per model."""
    oof = _ncv(spark, d)[0]
    return oof.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("y_true")).cast("bigint").alias("n_risk"))


def _ncv_family(name: str):
    def run(spark, d):
        return _ncv(spark, d, {name: GRIDS[name]})[1]
    run.__doc__ = f"M16: nested CV (5 outer x 5 inner) of {name}, its whole grid: the fold-metrics table."
    return run


# the baseline always says the training majority, so SQL can state its fold metrics
_NCV_DUMMY = L + """, f AS (SELECT row_id, target, CAST((row_number() OVER (PARTITION BY target ORDER BY md5('42|fold|' || CAST(row_id AS VARCHAR)), row_id) - 1) % 5 AS INTEGER) AS fold FROM learners_t),
k AS (SELECT DISTINCT fold FROM f),
m AS (SELECT k.fold, CAST(2 * sum(f.target) > count(*) AS INTEGER) AS p FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold),
c AS (SELECT fold, p, count(*) FILTER (target = 1) * 1e0 AS n1, count(*) FILTER (target = 0) * 1e0 AS n0 FROM f JOIN m USING (fold) GROUP BY fold, p),
s AS (SELECT fold, p, n0, n1, CASE WHEN p = 1 THEN n1 ELSE n0 END AS hit, CASE WHEN p = 1 THEN 2 * n1 / (2 * n1 + n0) ELSE 0e0 END AS f1p, CASE WHEN p = 0 THEN 2 * n0 / (2 * n0 + n1) ELSE 0e0 END AS f1r FROM c)
SELECT 'Dummy Baseline' AS model, 1 AS model_order, fold, hit / (n0 + n1) AS accuracy, 0.5e0 AS bal_acc, (f1p + f1r) / 2 AS macro_f1, f1p AS f1_pass, f1r AS f1_risk,
  p * n1 / (n0 + n1) AS precision_pass, p * 1e0 AS recall_pass, (1 - p) * n0 / (n0 + n1) AS precision_risk, 1e0 - p AS risk_recall, p * 1e0 AS missed_risk_rate,
  1e0 - p AS false_alarm_rate, 0.5e0 AS auc, n0 / (n0 + n1) AS pr_auc_risk, 0e0 AS mcc FROM s"""
_SUITE = ("accuracy", "bal_acc", "macro_f1", "f1_pass", "f1_risk", "precision_pass", "recall_pass", "precision_risk", "risk_recall",
          "missed_risk_rate", "false_alarm_rate", "auc", "pr_auc_risk", "mcc")
for _name in GRIDS:
    query("nested_cv_" + _name.lower().replace(" ", "_"), r6(_NCV_DUMMY, *_SUITE) if _name == "Dummy Baseline" else None)(_ncv_family(_name))


@query("grid_search", None)
def grid_search(spark, d):
    """Inner-fold Macro-F1 per logistic-regression candidate (C x penalty)."""
    df = va.assign_folds(_learners(spark, d), 5, 42)
    _, table = va.grid_search(df, "Logistic Regression", GRIDS["Logistic Regression"])
    rows = [(r["candidate"], float(r["params"]["C"]), float(r["params"]["l1_ratio"]), r["mean_macro_f1"]) for r in table]
    return spark.createDataFrame(rows, "candidate int, C double, l1_ratio double, mean_macro_f1 double")


@query("random_search", None)
def random_search(spark, d):
    """Seeded random search, 30 trials x 5 folds, logistic regression."""
    return va.random_search(_learners(spark, d), "Logistic Regression", n_trials=30, folds=5)


@query("searched_model", None)
def searched_model(spark, d):
    """The best trial of the search, refitted on all rows; its parameters and pooled metrics at 0.5."""
    import json

    from earlywarn.operators import evaluate as ev
    from earlywarn.operators.models import pass_probability

    lr = _learners(spark, d)
    trials = va.random_search(lr, "Logistic Regression", n_trials=30, folds=5)
    model, params = va.fit_searched(lr, "Logistic Regression", trials)
    out = model.transform(lr)
    pred = out.select(F.lit("Logistic Regression").alias("model"), F.col("target").alias("y_true"), pass_probability(out).alias("y_prob"))
    return ev.metrics_at(pred, 0.5, ["model"]).withColumn("params", F.lit(json.dumps(params, sort_keys=True)))


@query("learning_curve", None)
def learning_curve(spark, d):
    """Learning curve of a depth-5 tree, 5 sizes x 3 folds, with diagnosis."""
    lc = va.learning_curve(_learners(spark, d), "Decision Tree", {"max_depth": 5, "min_samples_leaf": 1})
    return va.summarize_curve(lc)


_TR = """tr AS (SELECT s_suppkey AS trial,
   pow(10e0, -3e0 + 5e0 * (CAST('0x' || substr(md5('C|' || CAST(s_suppkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0)) AS c,
   CAST(floor(2e0 * (CAST('0x' || substr(md5('l1|' || CAST(s_suppkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0)) AS INTEGER) AS l1,
   round(0.5e0 + 0.2e0 * (CAST('0x' || substr(md5('v|' || CAST(s_suppkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0), 4) AS value FROM supplier)"""


@query("search_history", r6(with_ctes(_TR) + "SELECT trial, c, l1, value, max(value) OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM tr",
                            "c", "value", "best_so_far"))
def search_history(spark, d):
    """Search history with the best value so far."""
    return search.search_history(fx.trials(spark, d))


@query("best_trial", r6(with_ctes(_TR) + "SELECT * FROM tr ORDER BY value DESC, trial LIMIT 1", "c", "value"))
def best_trial(spark, d):
    """Best trial, first on ties."""
    return search.best_trial(fx.trials(spark, d))


def _imp_sql(p: str, kind: str) -> str:
    x = f"log10({p})" if kind == "log" else f"CAST({p} AS DOUBLE)"
    if kind == "choice":
        b = f"CAST({x} AS VARCHAR)"
    else:
        b = f"CAST(CASE WHEN hi = lo THEN 0 ELSE least(4, CAST(floor(({x} - lo) / ((hi - lo) / 5e0)) AS INTEGER)) END AS VARCHAR)"
    return f"""SELECT '{p}' AS parameter, CASE WHEN sst > 0 THEN ssb / sst ELSE 0e0 END AS importance FROM
  (SELECT sum(n * pow(bm - m, 2)) AS ssb FROM (SELECT {b} AS bin, count(*) AS n, avg(value) AS bm, any_value(m) AS m FROM tr,
     (SELECT min({x}) AS lo, max({x}) AS hi, avg(value) AS m FROM tr) r GROUP BY 1) g) a,
  (SELECT sum(pow(value - m, 2)) AS sst FROM tr, (SELECT avg(value) AS m FROM tr) r) t"""


@query("parameter_importance", r6(with_ctes(_TR) + _imp_sql("c", "log") + " UNION ALL " + _imp_sql("l1", "choice"), "importance"))
def parameter_importance(spark, d):
    """Variance share explained by each search parameter."""
    return search.parameter_importance(fx.trials(spark, d), {"c": "log", "l1": "choice"})


def _family(name: str):
    def run(spark, d):
        import json

        from earlywarn.operators import evaluate as ev

        df = va.assign_folds(_learners(spark, d), 5, 42)
        enc = va._encode(df, [(F.col("fold") != 0, F.col("fold") == 0)], "target", "row_id", ("fold",))
        grid = GRIDS[name]
        m = ev.metrics_at(va.fit_many(enc, [(0, name, p) for p in grid]), 0.5, ["problem"])
        params = F.element_at(F.lit([json.dumps(p, sort_keys=True) for p in grid]), F.col("problem") + 1)
        return m.select(F.lit(name).alias("model"), F.col("problem").alias("candidate"), params.alias("params"), *[c for c in m.columns if c != "problem"])
    run.__doc__ = f"M6-M13: every candidate of {name} fitted on folds 1-4, scored on fold 0 (pooled metrics at 0.5)."
    return run


for _name in GRIDS:
    query("fit_" + _name.lower().replace(" ", "_"), None)(_family(_name))


_CATS = ["school", "sex", "mjob", "famsup", "schoolsup"]
_NUMS = ["age", "failures", "absences", "studytime"]
_NAMES_SQL = L + ", cats AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, {i} AS ord, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM learners GROUP BY {c}" for i, c in enumerate(_CATS)) + """),
r AS (SELECT col, ord, v, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) - 1 AS i, count(*) OVER (PARTITION BY col) AS k FROM cats),
blk AS (SELECT col, ord, COALESCE(sum(k) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT DISTINCT col, ord, k FROM r) x),
tot AS (SELECT count(*) AS kk FROM r)
SELECT CAST(o + i AS INTEGER) AS position, col || '=' || v AS feature, col AS source FROM r JOIN blk USING (col, ord)
UNION ALL SELECT CAST(kk + j AS INTEGER), name, name FROM tot, (VALUES """ + ", ".join(f"({j}, '{c}')" for j, c in enumerate(_NUMS)) + ") v(j, name)"


@query("preprocessor", _NAMES_SQL)
def preprocessor(spark, d):
    """M5: the assembled feature vector of the learners (categorical one-hot slots first, then numeric)."""
    df = _learners(spark, d)
    cat, num = va._features(df, "target", "row_id", [])
    out = prep.preprocessor(cat, num).fit(df).transform(df.limit(0))
    return prep.feature_names(out)


@query("fit_final", None)
def fit_final(spark, d):
    """Tune logistic regression (whole grid) on 5 stratified folds of all rows (seed 42), refit the
    best on all rows; the chosen parameters and the refit model's pooled metrics at 0.5."""
    import json

    from earlywarn.operators import evaluate as ev
    from earlywarn.operators.models import pass_probability

    lr = _learners(spark, d)
    model, params = va.fit_final(lr, "Logistic Regression", GRIDS["Logistic Regression"], folds=5)
    out = model.transform(lr)
    pred = out.select(F.lit("Logistic Regression").alias("model"), F.col("target").alias("y_true"),
                      F.col("prediction").cast("int").alias("y_pred"), pass_probability(out).alias("y_prob"))
    m = ev.metrics_at(pred, 0.5, ["model"])
    return m.withColumn("params", F.lit(json.dumps(params, sort_keys=True)))
