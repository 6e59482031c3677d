"""Scoring, scenarios and explanations.

A *scorer* is ``fn(DataFrame) -> DataFrame`` adding ``y_prob`` = P(pass):
either a fitted ``PipelineModel`` (``model_scorer``) or fixed linear
coefficients (``linear_scorer``, pure column expressions).  Scenarios are
built for every row at once: each row is expanded into the scenario list with
``inline`` of a literal array (no join), edited with ``when`` per changed
column and scored in one pass.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.functions.ranking import running_totals
from earlywarn.operators.models import pass_probability, sigmoid
from earlywarn.operators.prep import MedianImputerModel, ModeImputerModel, PopulationScalerModel

Scorer = Callable[[DataFrame], DataFrame]

# Verdict and action texts, and risk-band edges (percent).
VERDICT_PASS = "LOWER RISK SIGNAL · Predicted Pass"
VERDICT_RISK = "AT-RISK SIGNAL · Human review recommended"
ACTION_RISK = ("Recommended action: review attendance, prior failures and support needs with the student. "
               "Do not treat this output as proof of ability or intent.")
ACTION_PASS = "A lower-risk prediction does not guarantee success. Continue normal academic monitoring and support."
RISK_BANDS = ((35.0, "low"), (65.0, "moderate"), (100.0, "high"))
SCENARIO_NAMES = ("Current profile", "Attendance support", "Study-time coaching", "Custom adviser plan",
                  "Recovery plan after failures")
PROMISING = 0.05


def linear_scorer(intercept: float, coef: Mapping[str, float]) -> Scorer:
    """P(pass) = sigmoid(intercept + sum coef * x) as column expressions."""
    def score(df: DataFrame) -> DataFrame:
        z = F.lit(float(intercept))
        for c, w in coef.items():
            z = z + F.lit(float(w)) * F.col(c).cast("double")
        return df.withColumn("y_prob", sigmoid(z))
    return score


def model_scorer(model) -> Scorer:
    """P(pass) from a fitted pipeline; only the input columns are kept.  A
    logistic model behind the preprocessing of ``prep`` scores by plain column
    expressions, without a vector for each row; any other by ``transform``."""
    linear = linear_probability(model)

    def score(df: DataFrame) -> DataFrame:
        if linear is not None:
            out = df.select("*", linear.alias("y_prob"))
            for stage in model.stages:
                if isinstance(stage, (ModeImputerModel, MedianImputerModel, PopulationScalerModel)):
                    out = stage.transform(out)  # the input columns as the pipeline leaves them
            return out
        out = model.transform(df)
        return out.select(*df.columns, pass_probability(out).alias("y_prob"))
    return score


MAX_CASES = 64  # categories of a column that are told apart by comparisons


def linear_probability(model) -> Column | None:
    """P(class 1) of a pipeline of ``prep.preprocessor`` and a binary logistic
    model as an expression of the input columns: the same fills, slots, scaling
    and coefficients.  None for any other pipeline."""
    kinds = [type(s) for s in getattr(model, "stages", [])]
    cats = [ModeImputerModel, StringIndexerModel, OneHotEncoderModel]
    nums = [MedianImputerModel, PopulationScalerModel]
    if not any(kinds == [*c, *n, VectorAssembler, LogisticRegressionModel] for c in ([], cats) for n in ([], nums)):
        return None
    stage = dict(zip(kinds, model.stages))
    last, assembled = stage[LogisticRegressionModel], stage[VectorAssembler]
    if last.numClasses != 2 or last.getFeaturesCol() != assembled.getOutputCol() or last.isSet("thresholds") or assembled.getHandleInvalid() != "keep":
        return None
    weights, terms, used = last.coefficients.toArray().tolist(), {}, 0
    if ModeImputerModel in stage:
        index, slots = stage[StringIndexerModel], stage[OneHotEncoderModel]
        if index.getHandleInvalid() != "keep" or not slots.getDropLast() or slots.getInputCols() != index.getOutputCols() \
                or any(len(labels) > MAX_CASES for labels in index.labelsArray):
            return None
        fill = stage[ModeImputerModel].getStats()
        for c, out, labels in zip(index.getInputCols(), slots.getOutputCols(), index.labelsArray):
            v = F.col(c).cast("string") if fill.get(c) is None else F.coalesce(F.col(c).cast("string"), F.lit(fill[c]))
            terms[out] = len(labels), lambda w, v=v, labels=labels: functools.reduce(
                lambda e, x: e.when(v == F.lit(x[0]), F.lit(x[1])), zip(labels, w), F.when(v.isNull(), F.lit(0.0))).otherwise(F.lit(0.0))
    if MedianImputerModel in stage:
        fill, scale = stage[MedianImputerModel].getStats(), stage[PopulationScalerModel].getStats()
        for c in stage[PopulationScalerModel].getInputCols():
            x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) if fill.get(c) is not None else F.col(c)
            x = F.coalesce(x.cast("double"), F.lit(fill[c])) if fill.get(c) is not None else x.cast("double")
            mean, std = scale[c]
            z = F.coalesce((x - F.lit(mean or 0.0)) / F.lit(std if std else 1.0), F.lit(float("nan")))
            terms[c] = 1, lambda w, z=z: F.lit(w[0]) * z
    margin = F.lit(0.0)
    for c in assembled.getInputCols():
        if c not in terms:
            return None
        n, term = terms[c]
        margin = margin + term(weights[used : used + n])
        used += n
    if used != len(weights):
        return None
    return F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.exp(margin + F.lit(last.intercept)))  # as the model has it


def risk_band(risk_prob: Column) -> Column:
    """Risk probability in percent -> band."""
    pct = risk_prob * 100.0
    expr = None
    for edge, name in RISK_BANDS[:-1]:
        expr = F.when(pct < edge, F.lit(name)) if expr is None else expr.when(pct < edge, F.lit(name))
    return expr.otherwise(F.lit(RISK_BANDS[-1][1]))


def score_batch(df: DataFrame, scorer: Scorer, t: float = 0.5, model_name: str = "model") -> DataFrame:
    """The prediction record of every row."""
    s = scorer(df)
    pred = (F.col("y_prob") >= F.lit(float(t))).cast("int")
    return s.select(
        *df.columns,
        F.lit(model_name).alias("model"),
        F.lit(float(t)).alias("pass_threshold"),
        F.col("y_prob").alias("pass_probability"),
        (F.lit(1.0) - F.col("y_prob")).alias("risk_probability"),
        F.when(pred == 1, "Pass").otherwise("At risk").alias("prediction"),
        F.when(pred == 1, VERDICT_PASS).otherwise(VERDICT_RISK).alias("verdict"),
        risk_band(F.lit(1.0) - F.col("y_prob")).alias("risk_band"),
        F.when(pred == 1, ACTION_PASS).otherwise(ACTION_RISK).alias("action"),
    )


def scenario_specs(attendance_reduction: float = 45.0, study_boost: int = 1, recovery: bool = True, support: bool = True,
                   columns: Sequence[str] = ()) -> list[dict]:
    """The five scenarios as edits.  An edit is (column, kind, arg):
    'scale' truncates x * arg toward 0 (floored at 0), 'add_cap' adds and caps at 4,
    'sub_floor' subtracts and floors at 0, 'set' writes a constant."""
    factor = 1 - attendance_reduction / 100
    custom = [("absences", "scale", factor), ("studytime", "add_cap", int(study_boost))]
    if support:
        custom += [("famsup", "set", "yes"), ("schoolsup", "set", "yes")]
    if recovery:
        custom.append(("failures", "sub_floor", 1))
    specs = [
        {"scenario": SCENARIO_NAMES[0], "edits": []},
        {"scenario": SCENARIO_NAMES[1], "edits": [("absences", "scale", 0.65)]},
        {"scenario": SCENARIO_NAMES[2], "edits": [("studytime", "add_cap", 1)]},
        {"scenario": SCENARIO_NAMES[3], "edits": custom},
    ]
    if not columns or "failures" in columns:
        specs.append({"scenario": SCENARIO_NAMES[4], "edits": [("failures", "sub_floor", 1), ("studytime", "add_cap", 1)]})
    return specs


# a missing value of an edited column counts as this before the edit
_EDIT_DEFAULTS = {"absences": 0, "studytime": 1, "failures": 0}


def _edited(col: str, kind: str, arg, dtype: str) -> Column:
    x = F.coalesce(F.col(col).cast("double"), F.lit(float(_EDIT_DEFAULTS.get(col, 0))))
    if kind == "scale":
        v = F.greatest(F.lit(0.0), F.when(x * arg >= 0, F.floor(x * arg)).otherwise(F.ceil(x * arg)))
    elif kind == "add_cap":
        v = F.least(F.lit(4.0), x + F.lit(float(arg)))
    elif kind == "sub_floor":
        v = F.greatest(F.lit(0.0), x - F.lit(float(arg)))
    else:
        return F.lit(arg).cast(dtype)
    return v.cast(dtype)


def score_scenarios(df: DataFrame, scorer: Scorer, t: float = 0.5, specs: Sequence[dict] | None = None,
                    key: str = "row_id") -> DataFrame:
    """(key, scenario, position, pass_probability, risk_probability, signal) for every row."""
    specs = list(specs or scenario_specs(columns=df.columns))
    arr = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(s["scenario"]).alias("scenario")) for i, s in enumerate(specs)])
    x = df.select("*", F.inline(arr))
    types = dict(df.dtypes)
    cols = []
    for c in df.columns:
        expr = F.col(c)
        for i, s in enumerate(specs):
            for col, kind, arg in s["edits"]:
                if col == c:  # absent columns are skipped
                    expr = F.when(F.col("position") == i + 1, _edited(col, kind, arg, types[c])).otherwise(expr)
        cols.append(expr.alias(c))
    edited = x.select(*cols, "position", "scenario")
    s = scorer(edited)
    return s.select(
        key, "scenario", "position",
        F.col("y_prob").alias("pass_probability"),
        (F.lit(1.0) - F.col("y_prob")).alias("risk_probability"),
        F.when(F.col("y_prob") >= F.lit(float(t)), "Pass").otherwise("At risk").alias("signal"),
    )


def scenario_effect(scored: DataFrame, key: str = "row_id") -> DataFrame:
    """Per row the current risk, the best scenario (lowest risk, list
    order on ties), the reduction and whether it is promising (> 0.05)."""
    g = scored.groupBy(key).agg(
        F.max(F.when(F.col("position") == 1, F.col("risk_probability"))).alias("current_risk"),
        F.min_by(F.struct("scenario", "risk_probability"), F.struct("risk_probability", "position")).alias("b"),
    )
    red = F.col("current_risk") - F.col("b.risk_probability")
    return g.select(key, "current_risk", F.col("b.scenario").alias("best_scenario"), F.col("b.risk_probability").alias("best_risk"),
                    red.alias("risk_reduction"), (red > PROMISING).alias("promising"))


def scenario_changes(scored: DataFrame, key: str = "row_id") -> DataFrame:
    """Change of each scenario's risk against the current profile."""
    w = Window.partitionBy(key)
    cur = F.max(F.when(F.col("position") == 1, F.col("risk_probability"))).over(w)
    return scored.withColumn("risk_change", cur - F.col("risk_probability"))


def linear_contributions(df: DataFrame, background: DataFrame, intercept: float, coef: Mapping[str, float],
                         key: str = "row_id") -> DataFrame:
    """E1(a)/J11: exact additive contributions of a linear margin,
    phi_j = w_j (x_j - mean_background(x_j)); base = margin at the background mean.
    The background is reduced to one row of means before it meets the rows."""
    feats = list(coef)
    means = background.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in feats])
    base = F.lit(float(intercept))
    for c in feats:
        base = base + F.lit(float(coef[c])) * F.col(f"_m_{c}")
    j = df.select(key, *feats).crossJoin(F.broadcast(means))  # one-row side
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                               (F.lit(float(coef[c])) * (F.col(c).cast("double") - F.col(f"_m_{c}"))).alias("phi")) for c in feats])
    return j.select(key, base.alias("base"), F.inline(items))


def global_importance(contrib: DataFrame, k: int | None = None) -> DataFrame:
    """Mean |phi| per feature, highest first (top ``k`` when given)."""
    g = contrib.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    g = g.orderBy(F.col("mean_abs_phi").desc(), "feature")
    return g.limit(k) if k else g


def local_explanation(contrib: DataFrame, k: int = 5, key: str = "row_id") -> DataFrame:
    """Per row the ``k`` strongest contributions for (phi > 0) and against (phi < 0) passing."""
    d = contrib.filter(F.col("phi") != 0).withColumn("direction", F.when(F.col("phi") > 0, "supports pass").otherwise("raises risk"))
    w = Window.partitionBy(key, "direction").orderBy(F.abs("phi").desc(), "feature")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def class_contributions(df: DataFrame, col: str = "contrib", cls: int = 1) -> DataFrame:
    """Keep the class-``cls`` slice of per-class contribution arrays."""
    return df.withColumn(col, F.element_at(F.col(col), cls + 1))


CLIP = 1e-9
ROWS_PER_TASK = 100_000  # of the rows to explain, before they become coalitions
SMALL_BACKGROUND = 100_000  # background rows that may be broadcast
MAX_COMPARED = 16  # features that are ordered by comparing each with each


def background_slots(background: DataFrame, features: Sequence[str]) -> DataFrame:
    """(_b, _bgrow): background rows numbered from 0 in the order of their
    values.  Equal rows are counted first and take consecutive numbers, so
    the numbering needs no key; the counts are summed in slices of the order."""
    feats = list(features)
    kinds = background.select(*feats).groupBy(*feats).agg(F.count(F.lit(1)).alias("_n"))
    ends = running_totals(kinds, [], feats, {"_end": F.col("_n")})
    return ends.select(F.explode(F.sequence(F.col("_end") - F.col("_n"), F.col("_end") - 1)).alias("_b"), F.struct(*feats).alias("_bgrow"))


def permutation_contributions(df: DataFrame, scorer: Scorer, background: DataFrame, features: Sequence[str], n_perm: int = 8,
                              seed: int = 42, key: str = "row_id", margin: bool = True) -> DataFrame:
    """E1(b): model-agnostic contributions by permutation sampling (Strumbelj & Kononenko 2014).

    For every row, ``n_perm`` random feature orders and one background row
    each; walking an order, features switch one at a time from the
    background value to the row's value, and each switch's change of the
    score (the margin when ``margin``) is credited to that feature.  All
    coalitions of all rows are scored in one batch ``transform``; the average
    over permutations is an unbiased estimate that sums exactly to
    score(row) - mean score(background rows drawn).  The changes are summed
    by key where the coalitions are made, so no coalition is sorted or sent
    to another task.  Background rows are
    numbered in the order of their values and a draw meets its row by an
    equi-join on that number, so the background may have any size (one of up
    to ``SMALL_BACKGROUND`` rows is broadcast); an empty one is an error.
    """
    feats = list(features)
    nf = len(feats)
    slots = background_slots(background, feats)
    nbg = background.count()
    if nbg == 0:
        raise ValueError("the background has no rows")
    perms = F.sequence(F.lit(0), F.lit(n_perm - 1))
    # the rows are dealt by key before they become coalitions: what follows adds up within a task
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_TASK))
    small = nbg <= SMALL_BACKGROUND
    x = df.select(key, *feats).filter(F.col(key).isNotNull())
    x = (x.repartition(parts, key) if small else x).select("*", F.explode(perms).alias("_p"))
    # deterministic order: feature indices by a hash of (seed, key, perm, feature); _at: where a feature comes in it, from 1
    hashes = [F.xxhash64(F.lit(seed), F.col(key), F.col("_p"), F.lit(i)) for i in range(nf)]
    if nf <= MAX_COMPARED:
        x = x.select("*", *[h.alias(f"_h{i}") for i, h in enumerate(hashes)])
        before = lambda i, j: F.col(f"_h{i}") <= F.col(f"_h{j}") if i < j else F.col(f"_h{i}") < F.col(f"_h{j}")
        at = [functools.reduce(Column.__add__, [before(i, j).cast("int") for i in range(nf) if i != j], F.lit(1)) for j in range(nf)]
    else:
        x = x.withColumn("_ord", F.sort_array(F.array(*[F.struct(h.alias("h"), F.lit(i).alias("i")) for i, h in enumerate(hashes)]))["i"])
        at = [F.array_position("_ord", j).cast("int") for j in range(nf)]
    x = x.select(key, *feats, "_p", *[a.alias(f"_at{j}") for j, a in enumerate(at)])
    x = x.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col("_p")), F.lit(nbg)))
    x = x.join(F.broadcast(slots), "_b") if small else x.join(slots, "_b").repartition(parts, key)
    steps = F.sequence(F.lit(0), F.lit(nf))
    x = x.select("*", F.explode(steps).alias("_s"))  # coalition: first _s features of the order from the row
    cols = [F.when(F.col(f"_at{j}") <= F.col("_s"), F.col(c)).otherwise(F.col("_bgrow")[c]).alias(c) for j, c in enumerate(feats)]
    ats = [f"_at{j}" for j in range(nf)]
    coal = x.select(key, "_s", *ats, *cols)
    scored = scorer(coal)
    p = F.least(F.greatest(F.col("y_prob"), F.lit(CLIP)), F.lit(1.0 - CLIP))  # a sure vote has no finite margin
    v = F.log(p / (F.lit(1.0) - p)) if margin else F.col("y_prob")
    s = scored.select(key, "_s", *ats, v.alias("_v"))
    # a feature's mean change: what the coalitions score that have it last, less what those score to which it comes next
    change = [F.sum(F.when(F.col(a) == F.col("_s"), F.col("_v")).when(F.col(a) == F.col("_s") + 1, -F.col("_v"))).alias(f"_d{j}") for j, a in enumerate(ats)]
    first = F.col("_s") == 0
    g = s.groupBy(key).agg(F.sum(first.cast("long")).alias("_n"), F.avg(F.when(first, F.col("_v"))).alias("base"), *change)
    copies = F.col("_n") / F.lit(float(n_perm))  # rows of one key share its changes
    items = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"_d{j}") / F.col("_n") / copies).alias("phi")) for j, c in enumerate(feats)])
    return g.select(key, "base", F.inline(items))
