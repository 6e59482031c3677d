"""Folds, fits, model selection and learning curves.

Selection encodes the table once, with every row's role in all splits and the
preprocessing of each split (``splits``), and then runs all candidates of all
splits together (``fit_many``): logistic families as passes that add up the
gradients of every open fit, trees, forests, boosting and k-NN as tasks that
share growths and neighbours; a table too large for one task goes through the
distributed fits of ``pyspark.ml``, on features prepared once a split.
Preprocessing sees the training rows of its split only (leakage-safe).
"""

from __future__ import annotations

import functools
import json
import random
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.functions.hashing import md5_order
from earlywarn.functions.ranking import MD5, global_row_number
from earlywarn.operators import evaluate as ev
from earlywarn.operators import linear_fits, task_fits
from earlywarn.operators.knn import knn_classify
from earlywarn.operators.label import require_binary, split_columns
from earlywarn.operators.models import GRIDS, build_estimator, pass_probability
from earlywarn.operators.prep import preprocessor
from earlywarn.operators.splits import Encoded, encode
from earlywarn.operators.summary import summarize_folds
from earlywarn.session import scratch_path

SEED = 42
WORKERS = 8
FEW_ROWS = 500_000
KINDS_PER_TASK = 100_000


def materialize(df: DataFrame) -> DataFrame:
    """A table many fits read: checkpointed to the shared folder (``spark.checkpoint.dir``)
    so that a lost executor costs a re-read, not a recomputation of the fold
    lineage, and kept in memory/disk for the repeated scans."""
    from earlywarn.session import shared_dir

    shared_dir(df.sparkSession)
    # checkpointing an uncached plan computes it twice (count, then the write)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    cp = cached.checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
    cp.count()
    cached.unpersist()
    return cp


def written(df: DataFrame, name: str) -> DataFrame:
    """A table that many steps scan, written once to the shared folder and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def assign_folds(df: DataFrame, k: int, seed: int | Column = SEED, y: str = "target", key: str = "row_id", out: str = "fold",
                 by: Sequence[str] = ()) -> DataFrame:
    """Stratified folds: rows of each class shuffled by md5(seed|fold|key), then dealt round-robin.

    The per-class row number is computed in md5-prefix slices, so a class
    (half the table) never sits in one task.  A null label is an error.
    """
    label = F.when(F.col(y).isNull(), F.raise_error(F.lit(f"null in label column {y}"))).otherwise(F.col(y))
    seed = F.lit(seed) if isinstance(seed, int) else seed
    d = df.withColumn(y, label).withColumn("_k", F.md5(F.concat_ws("|", seed.cast("string"), F.lit("fold"), F.col(key).cast("string"))))
    rn = global_row_number(d, [*by, y], ["_k", key], name="_rn", slicer=MD5)
    return rn.withColumn(out, ((F.col("_rn") - 1) % k).cast("int")).drop("_k", "_rn")


def nested_folds(df: DataFrame, outer: int, inner: int, seed: int = SEED, label: str = "target", key: str = "row_id") -> DataFrame:
    """``df`` with ``outer`` and the map ``inner``: for every outer fold f that a
    row trains in, its inner fold, dealt with seed + f over the rows outside f."""
    folds = materialize(assign_folds(df.select(key, label), outer, seed, label, key, "outer"))
    held = folds.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).filter(F.col("f") != F.col("outer"))
    dealt = assign_folds(held, inner, F.lit(seed) + F.col("f"), label, key, "i", by=["f"])
    maps = dealt.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("f", "i"))).alias("inner"))  # outer - 1 entries
    return df.join(folds.select(key, "outer"), key).join(maps, key, "left")


def training_prefixes(df: DataFrame, sizes: Sequence[float], seed: int = SEED, key: str = "row_id", fold: str = "fold") -> DataFrame:
    """Nested training subsets: a row belongs to every size at or above its hashed position.

    Returns the input with ``size`` (one row per size it belongs to): the rows
    whose rank is within the size's share of their fold, whole rows only and
    one at least.  A reader of one size filters ``training_ranks`` instead.
    """
    ranked = training_ranks(df, seed, key, fold)
    sz = F.array(*[F.lit(float(s)) for s in sizes])
    return ranked.select(*df.columns, F.explode(F.filter(sz, in_prefix)).alias("size"))


def in_prefix(size: Column) -> Column:
    """Whether a row of ``training_ranks`` is in the training subset of a size."""
    return F.col("size_rank") <= F.greatest(F.lit(1), F.floor(size * F.col("size_rows")))


def training_ranks(df: DataFrame, seed: int = SEED, key: str = "row_id", fold: str = "fold") -> DataFrame:
    """``df`` with ``size_rank``, the rank of md5(seed|size|key) in the fold, and ``size_rows``, the rows of the fold."""
    d = df.withColumn("_k", md5_order(f"{seed}|size", key))
    rn = global_row_number(d, [fold], ["_k", key], name="_rn", slicer=MD5)
    n = rn.groupBy(fold).agg(F.count(F.lit(1)).alias("_n"))
    j = rn.join(F.broadcast(n), fold)  # one row per fold
    return j.select(*df.columns, F.col("_rn").alias("size_rank"), F.col("_n").alias("size_rows"))


def _features(df: DataFrame, label: str, key: str, exclude: Sequence[str]) -> tuple[list[str], list[str]]:
    cat, num = split_columns(df, exclude=[label, key, "weight", *exclude])
    return cat, num


def fit_pipeline(train: DataFrame, name: str, params: dict, label: str = "target", key: str = "row_id",
                 exclude: Sequence[str] = ("fold",)):
    """Preprocessor + estimator fitted on ``train`` (balanced weights attached;
    boosting and logistic regression of more than ``FEW_ROWS`` rows on equal rows as one)."""
    cat, num = _features(train, label, key, exclude)
    if name == "Gradient Boosting" and int(params.get("min_samples_leaf", 1)) <= 1:  # a leaf counts rows, so equal ones are kept apart for more
        held = train.select(*cat, *num, label).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = held.count()
            if n > FEW_ROWS:
                return _fit_on_kinds(held, n, name, params, cat, num, label)
        finally:
            held.unpersist()
    # one job: class counts (two rows for a binary label) give n and the balanced weights,
    # attached as a literal map so later scans do not re-aggregate
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    n = sum(counts.values())
    pairs = []
    for c, k in sorted(counts.items(), key=lambda kv: str(kv[0])):
        if c is not None:
            pairs += [F.lit(c), F.lit(n / (2.0 * k))]
    weight = F.element_at(F.create_map(*pairs), F.col(label)) if pairs else F.lit(1.0)
    if name == "Logistic Regression" and n > FEW_ROWS:
        held = train.select(*cat, *num, label).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return _fit_on_kinds(held, n, name, params, cat, num, label, weight)
        finally:
            held.unpersist()
    weighted = train.withColumn("weight", weight)
    est = build_estimator(name, params, n, label=label)
    pipe = Pipeline(stages=[*preprocessor(cat, num).getStages(), *est])
    return pipe.fit(weighted)


def _fit_on_kinds(rows: DataFrame, n: int, name: str, params: dict, cat: Sequence[str], num: Sequence[str], label: str,
                  weight: Column | None = None) -> PipelineModel:
    """A fit whose passes read each kind of row once, weighted by its rows (and
    the ``weight`` of each); the preprocessing is that of all rows."""
    spark = rows.sparkSession
    prepared = preprocessor(cat, num).fit(rows)
    kinds = rows.groupBy(*cat, *num, label).agg(F.count(F.lit(1)).cast("double").alias("__rows"))
    if weight is not None:
        kinds = kinds.withColumn("__rows", F.col("__rows") * weight)
    kinds = written(kinds, "fit-kinds")
    tasks = max(spark.sparkContext.defaultParallelism, -(-kinds.count() // KINDS_PER_TASK))
    (est,) = build_estimator(name, params, n, label=label)
    model = est.setWeightCol("__rows").fit(prepared.transform(kinds.repartition(tasks)))
    return PipelineModel(stages=[*prepared.stages, model])


def fit_predict(train: DataFrame, test: DataFrame, name: str, params: dict, label: str = "target", key: str = "row_id",
                exclude: Sequence[str] = ("fold",)) -> DataFrame:
    """(key, y_true, y_pred, y_prob) on ``test`` for a model fitted on ``train``."""
    if name == "KNN":
        cat, num = _features(train, label, key, exclude)
        pm = preprocessor(cat, num).fit(train)
        tr, te = pm.transform(train), pm.transform(test)
        p = knn_classify(tr, te, int(params.get("n_neighbors", 5)), params.get("weights", "uniform"), key, "features", label)
        p = materialize(p)  # the join is quadratic: it runs once, whatever reads the predictions
        return test.select(key, F.col(label).alias("y_true")).join(p, key)
    model = fit_pipeline(train, name, params, label, key, exclude)
    out = model.transform(test)
    return out.select(key, F.col(label).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
                      pass_probability(out).alias("y_prob"))


def _macro_f1(pred: DataFrame) -> float:
    from earlywarn.functions import metrics as M

    cm = ev.confusion(pred)
    return float(cm.select(M.macro_f1().alias("m")).first()["m"])


def _pool_map(fn, items, workers: int = WORKERS):
    """``fn`` over ``items`` from a few threads; at the first failure, or when
    this call is interrupted, nothing further is begun and the jobs under way
    are cancelled."""
    from pyspark import SparkContext

    sc = SparkContext.getOrCreate()
    tag = f"pool-{uuid.uuid4()}"

    def one(item):
        sc.addJobTag(tag)
        try:
            return fn(item)
        finally:
            sc.removeJobTag(tag)

    ex = ThreadPoolExecutor(max_workers=workers)
    try:
        out = [f.result() for f in [ex.submit(one, x) for x in items]]
    except BaseException:
        ex.shutdown(wait=False, cancel_futures=True)
        sc.cancelJobsWithTag(tag)
        raise
    ex.shutdown()
    return out


Candidate = tuple[int, str, dict]  # split, model, parameters


def _distributed(enc: Encoded, tasks: Sequence[Candidate]) -> DataFrame:
    """Single fits of ``pyspark.ml``, on the features of each split written once."""
    spark = enc.table.sparkSession
    dense = {}
    for s in sorted({t[0] for t in tasks}):
        rows = task_fits.design_rows(enc, s)
        path = scratch_path(spark, "split-features")
        rows.write.parquet(path)
        dense[s] = spark.read.schema(rows.schema).parquet(path).withColumn("features", array_to_vector("x"))

    def run(item):
        i, (s, name, params) = item
        train, test = dense[s].filter("role = 1"), dense[s].filter("role = 2")
        if name == "KNN":
            p = materialize(knn_classify(train, test, int(params.get("n_neighbors", 5)), params.get("weights", "uniform"), "key", "features", "y"))
            pred = test.select("key", F.col("y").cast("int").alias("y_true")).join(p, "key")
        else:
            out = Pipeline(stages=build_estimator(name, params, int(enc.plan.rows[s].sum()), label="y")).fit(train).transform(test)
            pred = out.select("key", F.col("y").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), pass_probability(out).alias("y_prob"))
        return pred.select(F.lit(i).alias("problem"), "key", "y_true", "y_pred", "y_prob")

    return functools.reduce(DataFrame.unionByName, _pool_map(run, list(enumerate(tasks)), 4))


LINEAR = ("Logistic Regression", "SVM RBF")


def _problems(tasks: Sequence[Candidate]) -> list[linear_fits.Problem]:
    return [linear_fits.Problem(s, float(p.get("C", 1.0)), float(p.get("l1_ratio", 0.0)), p.get("gamma", "scale") if name == "SVM RBF" else None,
                                int(p.get("n_components", 200))) for s, name, p in tasks]


def _fits(enc: Encoded, tasks: Sequence[Candidate], name: str):
    """What fits the candidates of a family of trees or k-NN: tasks on rows, tasks on groups of equal rows, or ``pyspark.ml``."""
    if task_fits.few_rows(enc):
        return task_fits.predict
    if task_fits.groups_fit(enc) if name in task_fits.GROWN else task_fits.neighbours_fit(enc, [t for t in tasks if t[1] == name]):
        return task_fits.predict_groups
    return task_fits.predict if task_fits.fits_in_a_task(enc) else _distributed


def fit_many(enc: Encoded, tasks: Sequence[Candidate]) -> DataFrame:
    """(problem, key, y_true, y_pred, y_prob): the predictions on the test rows
    of its split by every (split, model, parameters), numbered as given."""
    parts = []

    def add(chosen: list[int], pred: DataFrame) -> None:
        at = F.element_at(F.lit(chosen), F.col("problem") + 1)
        parts.append(pred.withColumn("problem", at))

    by = {kind: [i for i, t in enumerate(tasks) if t[1] in names] for kind, names in
          {"dummy": ["Dummy Baseline"], "linear": LINEAR,
           "task": ["Decision Tree", "Random Forest", "Gradient Boosting", "KNN"]}.items()}
    unknown = {t[1] for t in tasks} - {tasks[i][1] for v in by.values() for i in v}
    if unknown:
        raise ValueError(f"no estimator is known for {sorted(unknown)}; choose one of {list(GRIDS)}")
    if by["dummy"]:
        rows = enc.plan.rows
        cases = F.array(*[F.struct(F.lit(i).alias("problem"), F.lit(tasks[i][0]).alias("s"), F.lit(int(rows[tasks[i][0], 1] > rows[tasks[i][0], 0])).alias("m"))
                          for i in by["dummy"]])
        d = enc.table.select("key", "y", "role", F.inline(cases)).filter(F.element_at("role", F.col("s") + 1) == 2)
        parts.append(d.select("problem", "key", F.col("y").cast("int").alias("y_true"), F.col("m").alias("y_pred"), F.col("m").cast("double").alias("y_prob")))
    if by["linear"]:
        add(by["linear"], linear_fits.predict(enc, linear_fits.fit(enc, _problems([tasks[i] for i in by["linear"]]))))
    by_fit: dict = {}
    for i in by["task"]:
        by_fit.setdefault((_fits(enc, tasks, tasks[i][1]), tasks[i][1] == "KNN"), []).append(i)
    for (fits, _), chosen in by_fit.items():
        add(chosen, fits(enc, [tasks[i] for i in chosen]))
    return functools.reduce(DataFrame.unionByName, parts)


def _scores(counts: DataFrame) -> dict[int, float]:
    """Macro-F1 of every problem: a number each."""
    from earlywarn.functions import metrics as M

    return {r.problem: r.m for r in counts.select("problem", M.macro_f1().alias("m")).collect()}


def _outcomes(enc: Encoded, tasks: Sequence[Candidate]) -> DataFrame:
    """(problem, tn, fp, fn, tp) on the test rows for every task, without a prediction for each row where counts do."""
    if all(t[1] in LINEAR for t in tasks):
        parts = linear_fits.confusions(enc, linear_fits.fit(enc, _problems(tasks)))
    elif (all(t[1] in task_fits.GROWN for t in tasks) or {t[1] for t in tasks} == {"KNN"}) and _fits(enc, tasks, tasks[0][1]) is task_fits.predict_groups:
        parts = (task_fits.from_neighbours if tasks[0][1] == "KNN" else task_fits.from_groups)(enc, tasks, counts=True)
    else:
        return ev.confusion(fit_many(enc, tasks), ["problem"])
    return parts.groupBy("problem").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])


def score_many(enc: Encoded, tasks: Sequence[Candidate]) -> list[float | None]:
    """Macro-F1 on the test rows for every task; the families run side by side."""
    groups = [[i for i, t in enumerate(tasks) if t[1] in names] for names in
              (["Dummy Baseline"], LINEAR, ["Random Forest"], ["Decision Tree", "Gradient Boosting"], ["KNN"])]
    groups = [g for g in groups if g]
    out: list[float | None] = [None] * len(tasks)
    for g, got in zip(groups, _pool_map(lambda g: _scores(_outcomes(enc, [tasks[i] for i in g])), groups, len(groups) or 1)):
        for j, i in enumerate(g):
            out[i] = got.get(j)
    return out


def _best(grid: Sequence[dict], scores: Sequence[Sequence[float | None]]) -> tuple[int, list[dict]]:
    """The first best candidate by its mean over the folds, and the table."""
    table = []
    for ci, p in enumerate(grid):
        vals = [s for s in scores[ci] if s is not None]
        table.append({"candidate": ci, "params": p, "mean_macro_f1": sum(vals) / len(vals) if vals else None})
    best = max(table, key=lambda r: (r["mean_macro_f1"] if r["mean_macro_f1"] is not None else -1.0, -r["candidate"]))
    return best["candidate"], table


def _encode(df: DataFrame, splits, label: str, key: str, exclude: Sequence[str]) -> Encoded:
    cat, num = _features(df, label, key, exclude)
    return encode(df, splits, cat, num, label, key)


def grid_search(df: DataFrame, name: str, grid: Sequence[dict], fold: str = "fold", label: str = "target",
                key: str = "row_id") -> tuple[dict, list[dict]]:
    """Mean Macro-F1 over the folds in ``fold`` per candidate; first best wins."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]  # k values
    enc = _encode(df, [(F.col(fold) != f, F.col(fold) == f) for f in folds], label, key, (fold,))
    scores = score_many(enc, [(s, name, p) for p in grid for s in range(len(folds))])
    best, table = _best(grid, [scores[i * len(folds) : (i + 1) * len(folds)] for i in range(len(grid))])
    return grid[best], table


def nested_cv(df: DataFrame, models: dict[str, list[dict]] | None = None, outer: int = 5, inner: int = 5,
              seed: int = SEED, label: str = "target", key: str = "row_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outer stratified folds; per outer fold a grid search on inner folds
    (seed + fold) of the training rows, a refit and predictions on the untouched
    test rows.  The OOF rows are written once, by model.  Returns (oof,
    fold_metrics, chosen parameters)."""
    models = models or GRIDS
    require_binary(df, label)
    d = nested_folds(df, outer, inner, seed, label, key)
    of, ats = F.col("outer"), [f"__inner{f}" for f in range(outer)]
    d = d.select("*", *[F.element_at("inner", F.lit(f)).alias(at) for f, at in enumerate(ats)]).drop("inner")  # looked up once a row
    splits = [(of != f, of == f) for f in range(outer)]
    for f, at in enumerate(ats):
        splits += [((of != f) & (F.col(at) != g), (of != f) & (F.col(at) == g)) for g in range(inner)]
    enc = _encode(d, splits, label, key, ("outer", *ats))

    searched = [(m, f, p) for m, grid in models.items() if len(grid) > 1 for f in range(outer) for p in grid]
    scores = score_many(enc, [(outer + f * inner + g, m, p) for m, f, p in searched for g in range(inner)])
    chosen = {}
    for m, grid in models.items():
        for f in range(outer):
            mine = [i for i, t in enumerate(searched) if t[:2] == (m, f)]
            chosen[m, f] = grid[_best(grid, [scores[i * inner : (i + 1) * inner] for i in mine])[0]] if mine else grid[0]

    spark = df.sparkSession
    final = list(chosen)
    pred = fit_many(enc, [(f, m, chosen[m, f]) for m, f in final])
    order = {m: i + 1 for i, m in enumerate(models)}
    names = F.lit([m for m, _ in final])
    pick = lambda values: F.element_at(values, F.col("problem") + 1)
    oof = pred.select(pick(names).alias("model"), pick(F.lit([order[m] for m, _ in final])).cast("int").alias("model_order"),
                      pick(F.lit([f for _, f in final])).cast("int").alias("fold"), F.col("key").alias(key), "y_true", "y_pred", "y_prob")
    path = scratch_path(spark, "oof")
    oof.write.partitionBy("model").parquet(path)
    oof = spark.read.parquet(path).select(*oof.columns)
    fm = ev.classification_metrics(oof, ["model", "model_order", "fold"])
    rows = [(m, f, json.dumps(p, sort_keys=True)) for (m, f), p in chosen.items()]
    return oof, fm, spark.createDataFrame(rows, "model string, fold int, params string")


def fit_final(df: DataFrame, name: str, grid: Sequence[dict], folds: int = 5, seed: int = SEED, label: str = "target",
              key: str = "row_id"):
    """Tune on folds of all rows (seed 42), then refit the best on all rows."""
    params = tune(df, name, grid, folds, seed, label, key)
    return fit_pipeline(df, name, params, label, key, ()), params


def tune(df: DataFrame, name: str, grid: Sequence[dict], folds: int = 5, seed: int = SEED, label: str = "target", key: str = "row_id") -> dict:
    """The best candidate of a grid on stratified folds of all rows; a single one needs no search."""
    require_binary(df, label)
    if len(grid) == 1:
        return grid[0]
    return grid_search(assign_folds(df, folds, seed, label, key, "fold"), name, grid, "fold", label, key)[0]


def train_models(df: DataFrame, models: dict[str, list[dict]] | None = None, outer: int = 5, inner: int = 5, seed: int = SEED,
                 label: str = "target", key: str = "row_id"):
    """Nested CV, the winner by mean Macro-F1 (first on ties, the
    baseline is eligible), and the winner tuned again and refitted on all
    rows.  Returns (oof, fold_metrics, chosen, winner, its parameters, model)."""
    models = models or GRIDS
    oof, fm, chosen = nested_cv(df, models, outer, inner, seed, label, key)
    winner = best_from(fm).first()["best_model"]
    model, params = fit_final(df, winner, models[winner], outer, seed, label, key)
    return oof, fm, chosen, winner, params, model


def train_bundle(df: DataFrame, path: str, models: dict[str, list[dict]] | None = None, outer: int = 5, inner: int = 5, seed: int = SEED,
                 label: str = "target", key: str = "row_id", baseline: str = "Dummy Baseline", excluded: Sequence[str] = ()) -> dict:
    """Nested CV, then every model tuned on folds of all rows and
    refitted on them, and the evidence bundle with the fitted pipelines and the
    winner's parameters committed under ``path``.  Returns the pipelines by
    name; for k-NN that is its preprocessing, and the rows that vote are the
    table ``knn_rows`` of the bundle (``knn_classify`` takes it as it is)."""
    from earlywarn.operators import report

    models = models or GRIDS
    require_binary(df, label)
    oof, fm, _ = nested_cv(df, models, outer, inner, seed, label, key)
    winner = best_from(fm).first()["best_model"]
    cat, num = _features(df, label, key, ())
    fitted = {m: fit_final(df, m, grid, outer, seed, label, key) for m, grid in models.items() if m != "KNN"}
    if "KNN" in models:
        fitted["KNN"] = preprocessor(cat, num).fit(df), tune(df, "KNN", models["KNN"], outer, seed, label, key)
    tables = report.evidence_tables(df, oof, fm, [*cat, *num], seed, outer, inner, baseline, excluded)
    if "KNN" in fitted:
        tables["knn_rows"] = fitted["KNN"][0].transform(df).select(key, vector_to_array("features").alias("features"), label)
    report.write_evidence(tables, path, {m: model for m, (model, _) in fitted.items()}, {"model": winner, "parameters": fitted[winner][1]})
    return {m: model for m, (model, _) in fitted.items()}


def best_from(fold_metrics: DataFrame) -> DataFrame:
    """The model with the highest mean Macro-F1 (list order on ties)."""
    from earlywarn.operators.summary import best_model

    return best_model(summarize_folds(fold_metrics, ["macro_f1"]))


def fit_default(df: DataFrame, label: str = "target", key: str = "row_id"):
    """Logistic regression, C = 1, balanced."""
    return fit_pipeline(df, "Logistic Regression", {"C": 1.0, "l1_ratio": 0.0}, label, key, ())


# The search spaces of the reference's hyperparameter search.
SPACES = {
    "Logistic Regression": {"C": ("log", 1e-3, 100.0), "l1_ratio": ("choice", [0.0, 1.0])},
    "Random Forest": {"n_estimators": ("int", 80, 350, 10), "max_depth": ("int", 3, 20, 1), "min_samples_leaf": ("int", 1, 10, 1)},
    "Gradient Boosting": {"n_estimators": ("int", 50, 300, 10), "learning_rate": ("log", 0.01, 0.3),
                          "max_depth": ("int", 2, 6, 1), "min_samples_leaf": ("int", 1, 10, 1)},
}


def sample_params(space: dict, rng: random.Random) -> dict:
    out = {}
    for k, spec in space.items():
        if spec[0] == "log":
            import math

            out[k] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
        elif spec[0] == "int":
            lo, hi, step = spec[1], spec[2], spec[3]
            out[k] = lo + step * rng.randrange((hi - lo) // step + 1)
        else:
            out[k] = rng.choice(spec[1])
    return out


def random_search(df: DataFrame, name: str, n_trials: int = 30, folds: int = 5, seed: int = SEED, label: str = "target",
                  key: str = "row_id") -> DataFrame:
    """Seeded random search, all trials and folds together; returns the
    trial table (trial, value, params JSON, state)."""
    require_binary(df, label)
    rng = random.Random(seed)
    trials = [sample_params(SPACES[name], rng) for _ in range(n_trials)]
    _, table = grid_search(assign_folds(df, folds, seed, label, key, "fold"), name, trials, "fold", label, key)
    rows = [(i + 1, r["mean_macro_f1"], json.dumps(trials[i], sort_keys=True), "COMPLETE") for i, r in enumerate(table)]
    return df.sparkSession.createDataFrame(rows, "trial long, value double, params string, state string")


def fit_searched(df: DataFrame, name: str, trials: DataFrame, label: str = "target", key: str = "row_id"):
    """The best trial of a search (first on ties), refitted on all rows: (model, parameters)."""
    from earlywarn.operators.search import best_trial

    params = json.loads(best_trial(trials).first()["params"])
    return fit_pipeline(df, name, params, label, key, ()), params


def diagnose_expr(train_col: str = "training_macro_f1", val_col: str = "validation_macro_f1"):
    """Gap >= .15 overfit; else validation < .60 underfit; else controlled."""
    gap = F.col(train_col) - F.col(val_col)
    return (F.when(gap >= 0.15, "Possible overfitting")
            .when(F.col(val_col) < 0.60, "Possible underfitting")
            .otherwise("Reasonably controlled"))


CURVE = "size double, fold int, n_train long, train_f1 double, val_f1 double"


def learning_curve(df: DataFrame, name: str, params: dict, sizes: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0), folds: int = 3,
                   seed: int = SEED, label: str = "target", key: str = "row_id", workers: int = WORKERS) -> DataFrame:
    """Train / validation Macro-F1 per training size over stratified folds.
    Trees of more than ``FEW_ROWS`` rows are grown together, on equal rows as one."""
    d = training_ranks(assign_folds(df, folds, seed, label, key, "fold"), seed, key, "fold")
    ranks = ("size_rank", "size_rows")
    jobs = [(float(s), f) for s in sizes for f in range(folds)]
    if name == "Decision Tree" and df.count() > FEW_ROWS:
        of = F.col("fold")
        enc = _encode(d, [(in_prefix(F.lit(s)) & (of != f), of == f) for s, f in jobs], label, key, ("fold", *ranks))
        if task_fits.groups_fit(enc):
            tasks = [(i, name, params) for i in range(len(jobs))]
            train, val = (_scores(task_fits.from_groups(enc, tasks, counts=True, on_train=on)) for on in (True, False))
            rows = [(s, f, int(enc.plan.rows[i].sum()), train.get(i), val.get(i)) for i, (s, f) in enumerate(jobs)]
            return df.sparkSession.createDataFrame(rows, CURVE)
    d = materialize(d)

    def run(job):
        s, f = job
        train = d.filter(in_prefix(F.lit(float(s))) & (F.col("fold") != f)).drop(*ranks)
        test = d.filter(F.col("fold") == f).drop(*ranks)
        model = fit_pipeline(train, name, params, label, key, ("fold",))
        score = lambda x: _macro_f1(model.transform(x).select(F.col(label).alias("y_true"), F.col("prediction").cast("int").alias("y_pred")))
        return (float(s), f, train.count(), score(train), score(test))

    rows = _pool_map(run, jobs, workers)
    d.unpersist()
    return df.sparkSession.createDataFrame(rows, CURVE)


def summarize_curve(lc: DataFrame) -> DataFrame:
    """M23 aggregation: mean train/validation Macro-F1 and validation std (ddof 1) per size; M24 diagnosis."""
    s = lc.groupBy("size").agg(
        F.round(F.avg("n_train")).cast("long").alias("training_examples"),
        F.avg("train_f1").alias("training_macro_f1"),
        F.avg("val_f1").alias("validation_macro_f1"),
        F.coalesce(F.stddev_samp("val_f1"), F.lit(0.0)).alias("validation_std"),
    )
    return s.withColumn("diagnosis", diagnose_expr())
