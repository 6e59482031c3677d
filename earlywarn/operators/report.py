"""Experiment metadata, summary text and the evidence bundle.

The bundle is a directory of versions, each a folder of tables written by
Spark (Parquet for tables, JSON for records, text for the summaries and the
model card) with the saved pipelines and a manifest; a version counts once its
commit record is written.  Nothing is packed on the driver.
"""

from __future__ import annotations

import json
import platform
import re
import uuid
from collections.abc import Sequence

import pyspark
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from earlywarn.functions.frames import join_on
from earlywarn.operators import evaluate as ev
from earlywarn.operators.audit import fingerprint, row_fingerprint
from earlywarn.operators.stats import holm, paired_scores, wilcoxon_pairs
from earlywarn.operators.summary import best_model, evidence_tier, leaderboard, summarize_folds
from earlywarn.session import shared_dir
from earlywarn.sources.io import load_model


def experiment_metadata(data: DataFrame, best: DataFrame, seed: int, folds: int, metric: str, features: list[str],
                        with_time: bool = True, inner: int = 5) -> DataFrame:
    """One row: utc time, seed, outer and inner folds, metric, best model, rows, features, fingerprint, versions."""
    rows = data.agg(F.count(F.lit(1)).alias("rows"))
    fp = fingerprint(data, features)
    j = join_on(join_on(best.select("best_model"), rows, []), fp, [])
    cols = [
        F.lit(int(seed)).alias("seed"), F.lit(int(folds)).alias("folds"), F.lit(int(inner)).alias("inner_folds"), F.lit(metric).alias("metric"),
        "best_model", "rows", F.lit(len(features)).alias("features"), "fingerprint",
        F.lit(pyspark.__version__).alias("spark_version"), F.lit(platform.python_version()).alias("python_version"),
    ]
    if with_time:
        cols.insert(0, F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_utc"))
    return j.select(*cols)


def render_summary(tier: DataFrame, summary: DataFrame) -> DataFrame:
    """One line of text from the evidence tier and the best model's fold summary."""
    s = summary.groupBy("model").agg(
        F.max(F.when(F.col("metric") == "macro_f1", F.col("std"))).alias("_sd"),
        F.max(F.when(F.col("metric") == "auc", F.col("mean"))).alias("_auc"))
    j = tier.join(s, tier.best_model == s.model).drop("model")
    text = F.format_string(
        "Best model: %s. Mean Macro-F1 %.3f ± %.3f, Risk Recall %.3f, AUC-ROC %.3f; uplift over the baseline %.3f. Evidence: %s.",
        F.col("best_model"), F.col("macro_f1"), F.col("_sd"), F.col("risk_recall"), F.col("_auc"), F.col("uplift"), F.col("tier"))
    return j.select("best_model", "macro_f1", "risk_recall", F.col("_auc").alias("auc"), "uplift", "tier", text.alias("summary"))


TEXTS = ("summary", "executive_summary", "model_card")
RECORDS = ("metadata",)
MANIFEST = "artifact string, format string, rows long, fingerprint string"


def _read(spark: SparkSession, fmt: str, path: str) -> DataFrame:
    return spark.read.format(fmt).load(path)


def _write_artifact(name: str, df: DataFrame, path: str) -> str:
    """One table of the bundle: tables as Parquet, records as JSON, texts as lines (last column)."""
    if name in TEXTS:
        df.select(F.col(df.columns[-1]).cast("string").alias("value")).coalesce(1).write.text(path)
        return "text"
    if name in RECORDS:
        df.coalesce(1).write.json(path)
        return "json"
    df.write.parquet(path)
    return "parquet"


def _measured(spark: SparkSession, name: str, fmt: str, path: str) -> DataFrame:
    """Manifest row of a written artifact, from what is read back: rows and content fingerprint."""
    return row_fingerprint(_read(spark, fmt, path)).select(F.lit(name).alias("artifact"), F.lit(fmt).alias("format"), "rows", "fingerprint")


def write_evidence(bundle: dict[str, DataFrame], path: str, models: dict | None = None, params: dict | None = None) -> DataFrame:
    """Write a version of the bundle under ``path``; returns its manifest
    (artifact, format, rows, fingerprint) as read back.

    Every call writes a folder of its own: the tables, ``best_parameters``
    (JSON), the saved ``models`` by name (rows: their stages) and the manifest.
    Only then one record is appended to ``path/commits``, which makes the
    version the one that ``read_evidence`` finds; a write that ends before
    leaves the version before it in place.
    """
    spark: SparkSession = next(iter(bundle.values())).sparkSession
    base, version = path.rstrip("/"), uuid.uuid4().hex
    root = f"{base}/{version}"
    written = [(name, _write_artifact(name, df, f"{root}/{name}")) for name, df in bundle.items()]
    if params is not None:
        spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.text(f"{root}/best_parameters")
        written.append(("best_parameters", "text"))
    stages = []
    for name, model in (models or {}).items():
        model.write().save(f"{root}/{model_folder(name)}")
        stages.append((model_folder(name), "model", len(model.stages), None))
    manifest = spark.createDataFrame(stages, MANIFEST)
    for name, fmt in written:
        manifest = manifest.unionByName(_measured(spark, name, fmt, f"{root}/{name}"))
    manifest.coalesce(1).write.parquet(f"{root}/manifest")
    last = _last_commit(spark, base)
    record = json.dumps({"seq": 1 + (last["seq"] if last else 0), "version": version})
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("append").text(f"{base}/commits")
    return spark.read.parquet(f"{root}/manifest")


def model_folder(name: str) -> str:
    """Folder of a saved model within a bundle: its name in lower case, other characters as ``_``."""
    return "model_" + re.sub("[^0-9a-z]+", "_", name.lower())


def _last_commit(spark: SparkSession, base: str) -> Row | None:
    try:
        lines = spark.read.text(f"{base}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    r = lines.select(F.from_json("value", "seq long, version string").alias("r")).select("r.*")
    return r.orderBy(F.col("seq").desc(), "version").first()  # top-n of one record a write


def committed_version(spark: SparkSession, path: str) -> str:
    """Folder of the last committed version of a bundle; an error where there is none."""
    base = path.rstrip("/")
    last = _last_commit(spark, base)
    if last is None:
        raise FileNotFoundError(f"no committed evidence bundle at {base}")
    return f"{base}/{last['version']}"


def read_evidence(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The tables (all, or those named) of the last committed version.

    Rows and content of each are compared with the manifest first; a table
    that was changed, cut short or lost since is an error.
    """
    root = committed_version(spark, path)
    manifest = {r.artifact: r for r in spark.read.parquet(f"{root}/manifest").collect()}  # one row per artifact
    unknown = sorted(set(names or ()) - set(manifest))
    if unknown:
        raise KeyError(f"the bundle holds no {unknown}; it holds {sorted(manifest)}")
    out = {}
    for name in names or [n for n, r in manifest.items() if r.format != "model"]:
        want, at = manifest[name], f"{root}/{name}"
        got = _measured(spark, name, want.format, at).first()
        if (got.rows, got.fingerprint) != (want.rows, want.fingerprint):
            raise ValueError(f"{at} holds {got.rows} rows ({got.fingerprint}), the manifest says {want.rows} ({want.fingerprint})")
        out[name] = _read(spark, want.format, at)
    return out


def read_model(spark: SparkSession, path: str, name: str):
    """The saved pipeline of a model, from the last committed version."""
    return load_model(f"{committed_version(spark, path)}/{model_folder(name)}")


def evidence_tables(data: DataFrame, oof: DataFrame, fold_metrics: DataFrame, features: list[str], seed: int, outer: int, inner: int,
                    baseline: str, excluded: Sequence[str] = (), metric: str = "macro_f1") -> dict[str, DataFrame]:
    """The tables of a bundle from an experiment's OOF rows and fold
    metrics: leaderboard, fold metrics, OOF rows of all models, Wilcoxon-Holm
    pairs, metadata, summary, executive summary and model card."""
    shared_dir(data.sparkSession)
    fold_metrics = fold_metrics.checkpoint()  # a row a model and fold, behind every other table
    s = summarize_folds(fold_metrics, ev.SUITE).checkpoint()
    tier = evidence_tier(s, baseline)
    meta = experiment_metadata(data, best_model(s), seed, outer, metric, features, inner=inner).checkpoint()
    scores = fold_metrics.select("model", "model_order", "fold", F.col(metric).alias("score"))
    return {
        "leaderboard": leaderboard(s),
        "fold_metrics": fold_metrics,
        "oof": oof,
        "pairwise_tests": holm(wilcoxon_pairs(paired_scores(scores))),
        "metadata": meta,
        "summary": render_summary(tier, s),
        "executive_summary": executive_summary(tier, s, meta, baseline, excluded),
        "model_card": model_card(tier, meta, excluded),
    }


def executive_summary(tier: DataFrame, summary: DataFrame, meta: DataFrame, baseline: str, excluded: Sequence[str] = ()) -> DataFrame:
    """The whole summary (markdown, one row): data, design, result, interpretation, limits."""
    means = lambda m: F.max(F.when(F.col("metric") == m, F.col("mean")))
    base = summary.filter(F.col("model") == baseline).agg(means("macro_f1").alias("_base"))
    auc = summary.groupBy("model").agg(means("auc").alias("_auc"))
    j = tier.join(auc, tier.best_model == auc.model).drop("model")
    j = join_on(join_on(j, base, []), meta.drop("best_model"), [])
    num = lambda c: F.format_string("%.3f", F.col(c))
    line = lambda label, value: F.concat(F.lit(f"- {label}: "), value.cast("string"))
    lines = [
        F.lit("# Summary of the experiment"), F.lit(""),
        F.lit("## Data and design"),
        line("Records", F.col("rows")), line("Inputs", F.col("features")),
        F.lit("- Label: 0 = at risk, 1 = pass"), F.lit("- Left out of the inputs: " + (", ".join(excluded) or "nothing")),
        F.concat(F.lit("- Validation: "), F.col("folds").cast("string"), F.lit(" outer x "), F.col("inner_folds").cast("string"), F.lit(" inner folds")),
        line("Metric of selection", F.col("metric")), line("Fingerprint of the data", F.col("fingerprint")), F.lit(""),
        F.lit("## Result"),
        line("Selected model", F.col("best_model")), line("Macro-F1", num("macro_f1")), line("Macro-F1 of the baseline", num("_base")),
        line("Uplift over the baseline", num("uplift")), line("Risk Recall", num("risk_recall")), line("AUC-ROC", num("_auc")),
        line("Evidence", F.col("tier")), F.lit(""),
        F.lit("## Limits"),
        F.lit("Out-of-fold results on past data; a new population needs a validation of its own, governance and monitoring."),
    ]
    return j.select("best_model", F.concat_ws("\n", *lines).alias("executive_summary"))


def model_card(tier: DataFrame, meta: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """The model card (markdown, one row) from the evidence-tier row and the metadata."""
    j = join_on(tier, meta.drop("best_model"), [])
    lines = [
        F.lit("# Early-warning model card"),
        F.lit(""),
        F.lit("## Intended use"),
        F.lit("Decision support for identifying learners at risk; never the sole basis for a decision about a person."),
        F.lit("## Data"),
        F.format_string("%d records, %d inputs, fingerprint %s. Label: 0 = at risk, 1 = pass. Left out: %s.",
                        F.col("rows"), F.col("features"), F.col("fingerprint"), F.lit(", ".join(excluded) or "nothing")),
        F.lit("## Validation"),
        F.format_string("%d outer x %d inner stratified folds; primary metric %s; out-of-fold predictions only.",
                        F.col("folds"), F.col("inner_folds"), F.col("metric")),
        F.lit("## Selected model"),
        F.col("best_model"),
        F.lit("## Evidence"),
        F.format_string("%s: Macro-F1 %.3f, Risk Recall %.3f, uplift over the baseline %.3f.",
                        F.col("tier"), F.col("macro_f1"), F.col("risk_recall"), F.col("uplift")),
        F.lit("## Limitations"),
        F.lit("Associations, not causes; subgroup estimates can be unstable; no external validation."),
    ]
    return j.select("best_model", F.concat_ws("\n", *lines).alias("model_card"))
