"""Sources, sinks, streaming and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from earlywarn.operators import report, score as sc, summary as sm
from earlywarn.operators import evaluate as ev
from earlywarn.plans import q_evaluate as qe, q_score as qs
from earlywarn.plans.catalog import query
from earlywarn.plans.oracle_sql import LEARNERS, OOF, r6, with_ctes
from earlywarn.session import scratch_path
from earlywarn.sources import fixtures as fx, io
from earlywarn.streaming.score_stream import read_sink, run_to_end, score_stream as start_stream

L = with_ctes(LEARNERS)


@query("read_delimited", L + "SELECT * FROM learners")
def read_delimited(spark, d):
    """Learners written as ';'-separated CSV with padded headers, read back with separator detection."""
    lr = fx.learners(spark, d)
    path = scratch_path(spark, "learners-csv")
    padded = lr.toDF(*[f" {c} " for c in lr.columns])
    io.write_csv(padded, path, sep=";")
    return io.read_delimited(spark, path, schema=padded.schema).toDF(*lr.columns)


@query("score_stream", r6(qs._BATCH, "pass_probability", "risk_probability"))
def score_stream(spark, d):
    """Learners arriving as files, scored by a streaming query (available-now) into a Parquet sink; equals batch E5."""
    lr = fx.learners(spark, d).select(*qs.COLS)
    src = scratch_path(spark, "stream-src")
    lr.repartition(4).write.mode("overwrite").parquet(src)
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    q = start_stream(spark, src, lr.schema, qs.SCORER, 0.5, sink, ckpt, "fixed-linear", max_files_per_trigger=2)
    run_to_end(q)
    cols = [*qs.COLS, "model", "pass_threshold", "pass_probability", "risk_probability", "prediction", "verdict", "risk_band", "action"]
    return read_sink(spark, sink).select(*cols)


_FEATS = ["school", "sex", "age", "mjob", "famsup", "schoolsup", "failures", "absences", "studytime"]
_CELLS = ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '∅')" for c in _FEATS)
_META = qe._summary_sql(f""", best AS (SELECT model AS best_model FROM summary WHERE metric = 'macro_f1' ORDER BY mean DESC, model_order LIMIT 1),
fp AS (SELECT substr(sha256(CAST(sum(CAST(h AS DECIMAL(38,0))) AS VARCHAR) || '|' || CAST(count(*) AS VARCHAR)), 1, 16) AS fingerprint, count(*) AS rows
       FROM (SELECT CAST('0x' || substr(md5(concat_ws('␟', {_CELLS})), 1, 8) AS BIGINT) AS h FROM learners) x)
SELECT 42 AS seed, 5 AS folds, 5 AS inner_folds, 'macro_f1' AS metric, best_model, rows, {len(_FEATS)} AS features, fingerprint FROM best, fp""").replace(
    "WITH fm AS", "WITH " + LEARNERS.strip() + ",\nfm AS", 1)


def _meta(spark, d, with_time=False):
    best = sm.best_model(qe._fold_summary(spark, d))
    return report.experiment_metadata(fx.learners(spark, d), best, 42, 5, "macro_f1", _FEATS, with_time=with_time)


@query("experiment_metadata", _META)
def experiment_metadata(spark, d):
    """Experiment record (the creation time and versions are left out for the comparison)."""
    return _meta(spark, d).drop("spark_version", "python_version")


_SUMMARY = qe._TIER.replace("SELECT b.model AS best_model", "SELECT b.model AS best_model, b.model_order AS best_order", 1)


@query("render_summary", r6(f"""SELECT t.best_model, t.macro_f1, t.risk_recall, a.mean AS auc, t.uplift, t.tier,
  printf('Best model: %s. Mean Macro-F1 %.3f ± %.3f, Risk Recall %.3f, AUC-ROC %.3f; uplift over the baseline %.3f. Evidence: %s.',
         t.best_model, t.macro_f1, s.std, t.risk_recall, a.mean, t.uplift, t.tier) AS summary
FROM ({qe._TIER}) t
JOIN ({qe._summary_sql("SELECT * FROM summary")}) s ON s.model = t.best_model AND s.metric = 'macro_f1'
JOIN ({qe._summary_sql("SELECT * FROM summary")}) a ON a.model = t.best_model AND a.metric = 'auc'""", "macro_f1", "risk_recall", "auc", "uplift"))
def render_summary(spark, d):
    """One-line summary of the selected model."""
    s = qe._fold_summary(spark, d)
    return report.render_summary(sm.evidence_tier(s, "baseline"), s)


_OOF_ROWS = with_ctes(OOF) + """SELECT * FROM (VALUES ('leaderboard', 'parquet', 3), ('fold_metrics', 'parquet', 15), ('pairwise_tests', 'parquet', 3),
  ('metadata', 'json', 1), ('summary', 'text', 1), ('executive_summary', 'text', 22), ('model_card', 'text', 14)) v(artifact, format, rows)
UNION ALL SELECT 'oof', 'parquet', CAST(count(*) AS INTEGER) FROM oof
UNION ALL SELECT 'best_parameters', 'text', 1"""


def _evidence(spark, d, path):
    """The F3 experiment as a committed bundle; its manifest."""
    oof = fx.oof(spark, d)
    fm = ev.classification_metrics(oof, ["model", "model_order", "fold"])
    tables = report.evidence_tables(fx.learners(spark, d), oof, fm, _FEATS, 42, 5, 5, "baseline", excluded=("g1", "g2", "g3"))
    return report.write_evidence(tables, path, params={"weight": 0.55})


@query("write_evidence", _OOF_ROWS)
def write_evidence(spark, d):
    """The evidence bundle of the F3 experiment written to the shared folder and committed; its manifest."""
    out = _evidence(spark, d, scratch_path(spark, "evidence"))
    return out.select("artifact", "format", F.col("rows").cast("int").alias("rows"))


@query("read_evidence", r6(with_ctes(OOF) + """SELECT model, row_id, y_true, y_pred, y_prob AS pass_probability, 1e0 - y_prob AS risk_probability, fold FROM oof""",
                           "pass_probability", "risk_probability"))
def read_evidence(spark, d):
    """The OOF rows of the committed bundle, read back and compared with its manifest."""
    path = scratch_path(spark, "evidence")
    _evidence(spark, d, path)
    oof = report.read_evidence(spark, path, ["oof"])["oof"]
    return oof.select("model", "row_id", "y_true", "y_pred", F.col("y_prob").alias("pass_probability"),
                      (F.lit(1.0) - F.col("y_prob")).alias("risk_probability"), "fold")


_TRAINED = L + """, f AS (SELECT row_id, target, CAST((row_number() OVER (PARTITION BY target ORDER BY md5('42|fold|' || CAST(row_id AS VARCHAR)), row_id) - 1) % 5 AS INTEGER) AS fold FROM learners_t),
n AS (SELECT count(*) AS n FROM f)
SELECT m.model, f.fold, count(*) AS n, CAST(sum(1 - f.target) AS BIGINT) AS n_risk, any_value(n.n) AS n_scored, any_value(n.n) AS n_same
FROM f CROSS JOIN n CROSS JOIN (VALUES ('Dummy Baseline'), ('Logistic Regression')) m(model) GROUP BY m.model, f.fold"""


@query("trained_bundle", _TRAINED)
def trained_bundle(spark, d):
    """Nested CV of baseline and logistic regression, every model tuned and refitted on all rows, the
    bundle written and read again; by model and fold the OOF rows read back, with the rows that the reloaded model
    scores and those of them with the score of the model before it was saved."""
    from earlywarn.operators import validate as va
    from earlywarn.operators.models import GRIDS, pass_probability
    from earlywarn.plans import q_models as qm

    lr = va.written(qm._learners(spark, d), "learners")
    path = scratch_path(spark, "trained")
    models = va.train_bundle(lr, path, {m: GRIDS[m] for m in ("Dummy Baseline", "Logistic Regression")}, excluded=("g1", "g2", "g3"))
    scored = []
    for name, model in models.items():
        a, b = (m.transform(lr) for m in (model, report.read_model(spark, path, name)))
        a, b = (x.select("row_id", F.round(pass_probability(x), 9).alias(c)) for x, c in ((a, "before"), (b, "after")))
        same = F.count(F.when(F.col("before") == F.col("after"), 1)).alias("n_same")
        scored.append(a.join(b, "row_id").agg(F.count(F.lit(1)).alias("n_scored"), same).withColumn("model", F.lit(name)))
    oof = report.read_evidence(spark, path, ["oof"])["oof"]
    counts = oof.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("y_true")).cast("bigint").alias("n_risk"))
    return counts.join(scored[0].unionByName(scored[1]), "model")


@query("resolve_model", None)
def resolve_model(spark, d):
    """A default model saved to the shared folder, resolved by precedence
    (tuned, searched, default), loaded and used to score every learner."""
    from earlywarn.operators import validate as va
    from earlywarn.plans import q_models as qm

    lr = qm._learners(spark, d)
    model = va.fit_default(lr)
    path = scratch_path(spark, "model-default")
    io.save_model(model, path)
    name, loaded = io.resolve_model([("tuned", scratch_path(spark, "absent-tuned")), ("searched", scratch_path(spark, "absent-searched")),
                                     ("default", path)])
    rec = sc.score_batch(lr.drop("target"), sc.model_scorer(loaded), 0.5, name)
    return rec.groupBy("model", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("oof_store", r6(with_ctes(OOF) + "SELECT row_id, y_true, y_pred, y_prob AS pass_probability, 1e0 - y_prob AS risk_probability, fold FROM oof WHERE model = 'beta'",
                       "pass_probability", "risk_probability"))
def oof_store(spark, d):
    """The OOF table of all models written partitioned by model; reading one
    model prunes the other partitions (PartitionFilters on the scan)."""
    path = scratch_path(spark, "oof-store")
    io.write_table(fx.oof(spark, d), path, "parquet", partition_by=["model"])
    back = spark.read.parquet(path).filter(F.col("model") == "beta")
    return back.select("row_id", "y_true", "y_pred", F.col("y_prob").alias("pass_probability"),
                       (F.lit(1.0) - F.col("y_prob")).alias("risk_probability"), "fold")
