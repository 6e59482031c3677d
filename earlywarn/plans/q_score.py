"""Scoring, scenario and explanation queries with the fixed linear scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from earlywarn.operators import score as sc, shape
from earlywarn.plans.catalog import query
from earlywarn.plans.oracle_sql import LEARNERS, r6, with_ctes
from earlywarn.sources import fixtures as fx

L = with_ctes(LEARNERS)
SCORER = sc.linear_scorer(fx.FIXED_INTERCEPT, fx.FIXED_COEF)
Z = "(1.2e0 - 0.9e0 * failures - 0.05e0 * absences + 0.4e0 * studytime)"
P = f"(1e0 / (1e0 + exp(-{Z})))"
COLS = ["row_id", "school", "sex", "age", "famsup", "schoolsup", "failures", "absences", "studytime"]


def _band(r: str) -> str:
    return f"CASE WHEN {r} * 100e0 < 35e0 THEN 'low' WHEN {r} * 100e0 < 65e0 THEN 'moderate' ELSE 'high' END"


_BATCH = L + f"""SELECT {', '.join(COLS)}, 'fixed-linear' AS model, 0.5e0 AS pass_threshold, {P} AS pass_probability, 1e0 - {P} AS risk_probability,
  CASE WHEN {P} >= 0.5e0 THEN 'Pass' ELSE 'At risk' END AS prediction,
  CASE WHEN {P} >= 0.5e0 THEN '{sc.VERDICT_PASS}' ELSE '{sc.VERDICT_RISK}' END AS verdict,
  {_band('(1e0 - ' + P + ')')} AS risk_band,
  CASE WHEN {P} >= 0.5e0 THEN '{sc.ACTION_PASS}' ELSE '{sc.ACTION_RISK}' END AS action
FROM learners"""


@query("score_batch", r6(_BATCH, "pass_probability", "risk_probability"))
def score_batch(spark, d):
    """Prediction record for every learner (fixed coefficients)."""
    return sc.score_batch(fx.learners(spark, d).select(*COLS), SCORER, 0.5, "fixed-linear")


def _scen_sql() -> str:
    f = 1 - 45 / 100
    rows = f"""
s AS (SELECT * FROM (VALUES (1, 'Current profile'), (2, 'Attendance support'), (3, 'Study-time coaching'), (4, 'Custom adviser plan'),
                              (5, 'Recovery plan after failures')) v(position, scenario)),
e AS (SELECT l.row_id, s.position, s.scenario,
   CASE s.position WHEN 2 THEN CAST(greatest(0e0, floor(absences * 0.65e0)) AS INTEGER)
                   WHEN 4 THEN CAST(greatest(0e0, floor(absences * {f!r}e0)) AS INTEGER) ELSE absences END AS absences,
   CASE WHEN s.position IN (3, 4, 5) THEN CAST(least(4e0, studytime + 1e0) AS INTEGER) ELSE studytime END AS studytime,
   CASE WHEN s.position IN (4, 5) THEN CAST(greatest(0e0, failures - 1e0) AS INTEGER) ELSE failures END AS failures
 FROM learners l CROSS JOIN s)"""
    return L + "," + rows + f"""
SELECT row_id, scenario, position, {P} AS pass_probability, 1e0 - {P} AS risk_probability,
  CASE WHEN {P} >= 0.5e0 THEN 'Pass' ELSE 'At risk' END AS signal FROM e"""


_SCEN = _scen_sql()


def _scored(spark, d):
    return sc.score_scenarios(fx.learners(spark, d).select(*COLS), SCORER, 0.5)


@query("score_scenarios", r6(_SCEN, "pass_probability", "risk_probability"))
def score_scenarios(spark, d):
    """Five support scenarios for every learner."""
    return _scored(spark, d)


_EFFECT = f"""SELECT row_id, max(CASE WHEN position = 1 THEN risk_probability END) AS current_risk,
  arg_min(scenario, struct_pack(a := risk_probability, b := position)) AS best_scenario, min(risk_probability) AS best_risk,
  max(CASE WHEN position = 1 THEN risk_probability END) - min(risk_probability) AS risk_reduction,
  max(CASE WHEN position = 1 THEN risk_probability END) - min(risk_probability) > 0.05e0 AS promising
FROM ({_SCEN}) x GROUP BY row_id"""


@query("scenario_effect", r6(_EFFECT, "current_risk", "best_risk", "risk_reduction"))
def scenario_effect(spark, d):
    """Best scenario per learner and whether it is promising."""
    return sc.scenario_effect(_scored(spark, d))


@query("best_scenario_counts", f"SELECT best_scenario, count(*) AS n FROM ({_EFFECT}) e GROUP BY best_scenario")
def best_scenario_counts(spark, d):
    """How often each scenario is the best one."""
    return sc.scenario_effect(_scored(spark, d)).groupBy("best_scenario").agg(F.count(F.lit(1)).alias("n"))


_BG = L + """, bg AS (SELECT * FROM learners ORDER BY md5('42|sample|' || CAST(row_id AS VARCHAR)), row_id LIMIT 100),
m AS (SELECT avg(CAST(failures AS DOUBLE)) AS mf, avg(CAST(absences AS DOUBLE)) AS ma, avg(CAST(studytime AS DOUBLE)) AS ms FROM bg),
c AS (SELECT l.row_id, 1.2e0 - 0.9e0 * mf - 0.05e0 * ma + 0.4e0 * ms AS base, feature, value, phi FROM learners l, m,
  LATERAL (VALUES ('failures', CAST(l.failures AS DOUBLE), -0.9e0 * (l.failures - mf)),
                  ('absences', CAST(l.absences AS DOUBLE), -0.05e0 * (l.absences - ma)),
                  ('studytime', CAST(l.studytime AS DOUBLE), 0.4e0 * (l.studytime - ms))) v(feature, value, phi))"""


def _contrib(spark, d):
    lr = fx.learners(spark, d)
    bg = shape.seeded_sample(lr, 100, 42)
    return sc.linear_contributions(lr, bg, fx.FIXED_INTERCEPT, fx.FIXED_COEF)


@query("contributions", r6(_BG + " SELECT * FROM c", "base", "value", "phi"))
def contributions(spark, d):
    """Exact contributions of the linear margin against a 100-row seeded background."""
    return _contrib(spark, d)


@query("seeded_sample", L + "SELECT * FROM learners ORDER BY md5('42|sample|' || CAST(row_id AS VARCHAR)), row_id LIMIT 100")
def seeded_sample(spark, d):
    """100 rows drawn without replacement, seed 42 (a sampling operator)."""
    return shape.seeded_sample(fx.learners(spark, d), 100, 42)


@query("global_importance", r6(_BG + " SELECT feature, avg(abs(phi)) AS mean_abs_phi FROM c GROUP BY feature", "mean_abs_phi"))
def global_importance(spark, d):
    """Mean |phi| per feature."""
    return sc.global_importance(_contrib(spark, d))


@query("local_explanation", r6(_BG + """ SELECT row_id, base, feature, value, phi, direction, rank FROM (
  SELECT *, CASE WHEN phi > 0 THEN 'supports pass' ELSE 'raises risk' END AS direction,
         CAST(row_number() OVER (PARTITION BY row_id, phi > 0 ORDER BY abs(phi) DESC, feature) AS INTEGER) AS rank FROM c WHERE phi <> 0) x WHERE rank <= 5""",
                               "base", "value", "phi"))
def local_explanation(spark, d):
    """Strongest contributions for and against passing, per learner."""
    return sc.local_explanation(_contrib(spark, d), 5)


@query("contributions_model", None)
def contributions_model(spark, d):
    """E1(b)/J11: permutation contributions of a fitted logistic pipeline for every learner
    (8 permutations, background = the 100-row seeded sample); additive to the margin."""
    from earlywarn.operators import validate as va
    from earlywarn.plans import q_models as qm

    lr = va.written(qm._learners(spark, d), "learners")
    model = va.fit_default(lr)
    feats = [c for c in qm.FEATURES if c not in ("row_id", "target")]
    bg = shape.seeded_sample(lr, 100, 42)
    return sc.permutation_contributions(lr, sc.model_scorer(model), bg, feats)


@query("top_features", r6(_BG + " SELECT feature, avg(abs(phi)) AS mean_abs_phi FROM c GROUP BY feature ORDER BY mean_abs_phi DESC, feature LIMIT 2", "mean_abs_phi"))
def top_features(spark, d):
    """T4: the two features with the largest mean |phi| (a top-k report)."""
    return sc.global_importance(_contrib(spark, d), 2)


@query("class_contributions", r6(_BG + " SELECT row_id, feature, phi FROM c", "phi"))
def class_contributions(spark, d):
    """The pass-class slice of two-class contribution arrays (risk = -phi, pass = phi)."""
    c = _contrib(spark, d).select("row_id", "feature", F.array(-F.col("phi"), F.col("phi")).alias("contrib"))
    return sc.class_contributions(c, "contrib", 1).withColumnRenamed("contrib", "phi")


def _margin_sql(f: str, a: str, s: str) -> str:
    """Margin of the fixed trees (``fixtures.FIXED_TREES``) as CASE expressions."""
    at = {"failures": f, "absences": a, "studytime": s}

    def branch(tree: dict, node: int) -> str:
        n = tree[node]
        if not isinstance(n, tuple):
            return f"{n!r}e0"
        feature, threshold, left, right = n
        return f"CASE WHEN {at[feature]} <= {threshold!r}e0 THEN {branch(tree, left)} ELSE {branch(tree, right)} END"

    return " + ".join(f"{w!r}e0 * ({branch(tree, 0)})" for w, tree in fx.FIXED_TREES)


def _coalition_sql() -> str:
    """Shapley values by all eight coalitions of three features, each the mean
    margin over every background row, on distinct profiles with their counts."""
    cols = ("failures", "absences", "studytime")
    means = []
    for mask in range(8):
        args = [f"{'x' if mask >> i & 1 else 'z'}.{c}" for i, c in enumerate(cols)]
        means.append(f"sum(z.n * ({_margin_sql(*args)})) / sum(z.n) AS v{mask}")
    phis = []
    for i, c in enumerate(cols):
        j, k = [1 << o for o in range(3) if o != i]
        b = 1 << i
        phi = f"(v{b} - v0) / 3e0 + (v{b | j} - v{j}) / 6e0 + (v{b | k} - v{k}) / 6e0 + (v7 - v{j | k}) / 3e0"
        phis.append(f"({i}, '{c}', CAST(l.{c} AS DOUBLE), {phi})")
    return L + f""", p AS (SELECT failures, absences, studytime, CAST(count(*) AS DOUBLE) AS n FROM learners GROUP BY ALL),
v AS (SELECT x.failures, x.absences, x.studytime, {', '.join(means)} FROM p x, p z GROUP BY ALL)
SELECT l.row_id, v0 AS base, v7 AS margin, position, feature, value, phi
FROM learners l JOIN v USING (failures, absences, studytime), LATERAL (VALUES {', '.join(phis)}) s(position, feature, value, phi)"""


@query("contributions_trees", r6(_coalition_sql(), "base", "margin", "value", "phi"))
def contributions_trees(spark, d):
    """Exact contributions of a fixed ensemble of trees for every learner, all learners as background."""
    from earlywarn.operators import tree_contributions as tc

    lr = fx.learners(spark, d)
    names = ["failures", "absences", "studytime"]
    x = F.array(*[F.col(c).cast("double") for c in names])
    return tc.tree_contributions(lr, lr, fx.fixed_nodes(spark, names), x, names)


@query("contributions_boosting", None)
def contributions_boosting(spark, d):
    """Contributions of the default explained model (boosting, 120 trees, rate 0.05, depth 2, fitted on all
    learners) on its transformed features for every learner, log-odds, background = the 100-row seeded sample."""
    from earlywarn.operators import tree_contributions as tc
    from earlywarn.plans import q_models as qm

    lr = qm._learners(spark, d)
    return tc.boosting_contributions(lr, tc.fit_explained(lr), shape.seeded_sample(lr, 100, 42))
