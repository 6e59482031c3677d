"""Label, features, audit and exploratory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from earlywarn.operators import audit, label, shape
from earlywarn.operators.summary import class_weights
from earlywarn.plans.catalog import query
from earlywarn.plans.oracle_sql import DIRTY, LEARNERS, RAW_LABELS, SCORED, r6, with_ctes
from earlywarn.sources import fixtures as fx

L = with_ctes(LEARNERS)
D = with_ctes(DIRTY)
FEATS = ["school", "sex", "age", "mjob", "famsup", "schoolsup", "failures", "absences", "studytime"]


@query("derive_target", L + "SELECT row_id, g3, target FROM learners_t")
def derive_target(spark, d):
    """target = g3 >= 10."""
    return fx.learners_labelled(spark, d).select("row_id", "g3", "target")


_NORM = with_ctes(RAW_LABELS) + """SELECT row_id, CASE lower(trim(target))
  WHEN 'pass' THEN 1 WHEN 'passed' THEN 1 WHEN 'yes' THEN 1 WHEN 'true' THEN 1 WHEN '1' THEN 1
  WHEN 'fail' THEN 0 WHEN 'failed' THEN 0 WHEN 'risk' THEN 0 WHEN 'at risk' THEN 0 WHEN 'at-risk' THEN 0
  WHEN 'no' THEN 0 WHEN 'false' THEN 0 WHEN '0' THEN 0 END AS target FROM raw_labels"""


@query("normalize_label", _NORM)
def normalize_label(spark, d):
    """Text labels normalised to 0/1."""
    return label.normalize_label(fx.raw_labels(spark, d), "target")


@query("assert_binary", L + """SELECT array_to_string(list_slice(list_sort(list(CAST(c AS VARCHAR))), 1, 20), ',') AS classes, count(*) AS n_classes,
  count(*) = 2 AND sum(CASE WHEN c IN (0, 1) THEN 0 ELSE 1 END) = 0 AS is_binary, count(*) > 20 AS truncated
FROM (SELECT DISTINCT target AS c FROM learners_t WHERE target IS NOT NULL) x""")
def assert_binary(spark, d):
    """The label is exactly {0, 1}."""
    return label.assert_binary(fx.learners_labelled(spark, d))


@query("with_row_id", "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS row_id FROM customer")
def with_row_id(spark, d):
    """P5: dense row id in key order."""
    from earlywarn.sources.tables import table

    return label.with_row_id(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@query("prepare_features", L + "SELECT * EXCLUDE (target, g3, g1, g2) FROM learners_t")
def prepare_features(spark, d):
    """Leakage-safe features (label and grades dropped)."""
    return label.prepare_features(fx.learners_labelled(spark, d))


@query("prepare_features_prior", L + "SELECT * EXCLUDE (target, g3) FROM learners_t")
def prepare_features_prior(spark, d):
    """P6 with prior grades kept."""
    return label.prepare_features(fx.learners_labelled(spark, d), include_prior_grades=True)


_ROLES = L + "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{'categorical' if c in ('school', 'sex', 'mjob', 'famsup', 'schoolsup') else 'numeric'}', {i + 1})"
    for i, c in enumerate(["school", "sex", "age", "mjob", "famsup", "schoolsup", "failures", "absences", "studytime", "g1", "g2", "g3"])
) + ") v(feature, role, position) CROSS JOIN (SELECT count(*) AS non_null FROM learners) n"


@query("feature_roles", _ROLES)
def feature_roles(spark, d):
    """Categorical / numeric role of each column from the schema."""
    return label.feature_roles(fx.learners(spark, d), exclude=["row_id"])


@query("select_existing", L + "SELECT school, failures, absences FROM learners")
def select_existing(spark, d):
    """Only listed columns that exist."""
    return shape.select_existing(fx.learners(spark, d), ["school", "Medu", "failures", "Fedu", "absences"])


@query("display_safe", D + "SELECT c_custkey, COALESCE(c_name, '') AS c_name, c_nationkey, c_acctbal, COALESCE(c_mktsegment, '') AS c_mktsegment, const FROM dirty")
def display_safe(spark, d):
    """Text columns null -> '', numerics untouched."""
    return shape.display_safe(fx.dirty(spark, d))


@query("to_long", L + """SELECT row_id, variable, value FROM (SELECT row_id, CAST(failures AS DOUBLE) AS failures,
  CAST(absences AS DOUBLE) AS absences, CAST(studytime AS DOUBLE) AS studytime FROM learners)
  UNPIVOT (value FOR variable IN (failures, absences, studytime))""")
def to_long(spark, d):
    """Wide -> long."""
    return shape.to_long(fx.learners(spark, d), ["row_id"], ["failures", "absences", "studytime"])


_LABEL_CASE = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in shape.FEATURE_LABELS.items()) + " ELSE feature END"


@query("record_audit", L + f"""SELECT row_id, feature, {_LABEL_CASE} AS label, value FROM (
  SELECT row_id, school, sex, CAST(age AS VARCHAR) AS age, CAST(failures AS VARCHAR) AS failures,
         CAST(absences AS VARCHAR) AS absences, CAST(studytime AS VARCHAR) AS studytime FROM learners)
  UNPIVOT (value FOR feature IN (school, sex, age, failures, absences, studytime))""")
def record_audit(spark, d):
    """Each record as (feature, readable label, value)."""
    return shape.record_audit(fx.learners(spark, d).select("row_id", "school", "sex", "age", "failures", "absences", "studytime"))


@query("coerce_numeric", with_ctes(RAW_LABELS) + "SELECT row_id, TRY_CAST(target AS DOUBLE) AS target FROM raw_labels WHERE TRY_CAST(target AS DOUBLE) IS NOT NULL")
def coerce_numeric(spark, d):
    """Coercing cast and drop of non-numeric rows."""
    return shape.coerce_numeric(fx.raw_labels(spark, d), ["target"])


@query("map_labels", L + "SELECT row_id, CASE target WHEN 0 THEN 'Fail' WHEN 1 THEN 'Pass' ELSE CAST(target AS VARCHAR) END AS outcome FROM learners_t")
def map_labels(spark, d):
    """Class code -> text."""
    return shape.map_labels(fx.learners_labelled(spark, d).select("row_id", "target"), "target", shape.CLASS_LABELS, "outcome").select("row_id", "outcome")


_AUDIT_NUM = ["c_custkey", "c_nationkey", "c_acctbal", "const"]
_AUDIT_ALL = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "const"]
_MISS = " + ".join(f"count(*) - count({c})" for c in _AUDIT_ALL) + " + count(*) FILTER (WHERE isnan(c_acctbal))"
_CONST = " + ".join(f"CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1 AS INTEGER)" for c in _AUDIT_ALL)
_CELLS = ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '∅')" for c in _AUDIT_ALL)
_FP = f"""SELECT substr(sha256(CAST(sum(CAST(h AS DECIMAL(38,0))) AS VARCHAR) || '|' || CAST(count(*) AS VARCHAR)), 1, 16) AS fingerprint
FROM (SELECT CAST('0x' || substr(md5(concat_ws('␟', {_CELLS})), 1, 8) AS BIGINT) AS h FROM dirty) x"""
_DUP = "SELECT CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM dirty GROUP BY ALL_COLS) g".replace(
    "ALL_COLS", ", ".join(_AUDIT_ALL))

_QA = D + f""", s AS (SELECT count(*) AS rows, {len(_AUDIT_ALL)} AS columns, {_MISS} AS missing, {_CONST} AS constant FROM dirty),
dup AS ({_DUP}), fp AS ({_FP})
SELECT * FROM (VALUES (1, 'Rows', (SELECT CAST(rows AS VARCHAR) FROM s), 'Info'),
  (2, 'Columns', (SELECT CAST(columns AS VARCHAR) FROM s), 'Info'),
  (3, 'Missing cells', (SELECT CAST(missing AS VARCHAR) FROM s), (SELECT CASE WHEN missing > 0 THEN 'Review' ELSE 'Pass' END FROM s)),
  (4, 'Duplicate rows', (SELECT CAST(duplicate_rows AS VARCHAR) FROM dup), (SELECT CASE WHEN duplicate_rows > 0 THEN 'Review' ELSE 'Pass' END FROM dup)),
  (5, 'Constant columns', (SELECT CAST(constant AS VARCHAR) FROM s), (SELECT CASE WHEN constant > 0 THEN 'Review' ELSE 'Pass' END FROM s)),
  (6, 'Dataset fingerprint', (SELECT fingerprint FROM fp), 'Reproducibility')) v(position, "check", value, status)"""


@query("quality_audit", _QA)
def quality_audit(spark, d):
    """A1/A2: audit table of F5."""
    return audit.quality_audit(fx.dirty(spark, d))


_MISSING = D + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (count(*) - count({c})) * 100e0 / count(*) AS missing_pct FROM dirty" for c in _AUDIT_ALL)


@query("missingness", r6(f"SELECT * FROM ({_MISSING}) m WHERE missing_pct > 0", "missing_pct"))
def missingness(spark, d):
    """A3: missing % per column, only positive."""
    return audit.missingness(fx.dirty(spark, d))


@query("duplicate_rows", D + _DUP)
def duplicate_rows(spark, d):
    """A4: copies after the first."""
    return audit.duplicate_rows(fx.dirty(spark, d))


@query("constant_columns", D + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i + 1} AS position FROM dirty HAVING count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1"
    for i, c in enumerate(_AUDIT_ALL)))
def constant_columns(spark, d):
    """A5: columns with at most one value (null counts)."""
    return audit.constant_columns(fx.dirty(spark, d))


@query("fingerprint", D + _FP)
def fingerprint(spark, d):
    """Order-free dataset fingerprint."""
    return audit.fingerprint(fx.dirty(spark, d), _AUDIT_ALL)


@query("class_balance", r6(L + """, c AS (SELECT d.cls, CAST(COALESCE(n, 0) AS BIGINT) AS count FROM (VALUES (0), (1)) d(cls)
  LEFT JOIN (SELECT target AS cls, count(*) AS n FROM learners_t GROUP BY target) x USING (cls)),
t AS (SELECT sum(count) AS t, min(count) AS m FROM c)
SELECT cls AS class, CASE WHEN cls = 0 THEN 'Fail' ELSE 'Pass' END AS label, count, count / CAST(t AS DOUBLE) AS share,
  m / CAST(t AS DOUBLE) AS minority_share, m / CAST(t AS DOUBLE) < 0.25e0 AS material_imbalance FROM c, t""", "share", "minority_share"))
def class_balance(spark, d):
    """Class counts, shares and imbalance flag."""
    return audit.class_balance(fx.learners_labelled(spark, d))


def _hist_sql(col: str, nbins: int) -> str:
    return r6(L + f""", x AS (SELECT CAST({col} AS DOUBLE) AS x FROM learners WHERE {col} IS NOT NULL),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least({nbins - 1}, CAST(floor((x - lo) / ((hi - lo) / {nbins}e0)) AS INTEGER)) END AS bin, lo, hi FROM x, r)
SELECT CAST(bin AS INTEGER) AS bin, any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / {nbins}e0) AS bin_start,
  any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / {nbins}e0) AS bin_end, count(*) AS count FROM b GROUP BY bin""", "bin_start", "bin_end")


@query("histogram", _hist_sql("g3", 20))
def histogram(spark, d):
    """Grade histogram, 20 bins."""
    return audit.histogram(fx.learners(spark, d), "g3", 20)


@query("histogram_absences", _hist_sql("absences", 30))
def histogram_absences(spark, d):
    """Absences histogram, 30 bins."""
    return audit.histogram(fx.learners(spark, d), "absences", 30)


_CORR_COLS = ["age", "failures", "absences", "studytime", "g1", "g2", "g3", "target"]
_CORR = L + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM learners_t"
    for a in _CORR_COLS for b in _CORR_COLS)


@query("corr_matrix", r6(_CORR, "r"))
def corr_matrix(spark, d):
    """Pearson correlations of all numeric columns incl. target and grades."""
    df = fx.learners_labelled(spark, d)
    return audit.corr_matrix(df, [c for c in shape.numeric_columns(df) if c != "row_id"])


_BOX = L + """, d AS (SELECT studytime, target, CAST(g3 AS DOUBLE) AS y FROM learners_t),
q AS (SELECT studytime, target, quantile_cont(y, 0.25e0) AS q1, quantile_cont(y, 0.5e0) AS median, quantile_cont(y, 0.75e0) AS q3 FROM d GROUP BY ALL),
f AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lower_fence, q3 + 1.5e0 * (q3 - q1) AS upper_fence FROM q)
SELECT studytime, target, count(*) AS n, min(y) AS min, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, max(y) AS max,
  any_value(lower_fence) AS lower_fence, any_value(upper_fence) AS upper_fence,
  min(y) FILTER (WHERE y >= lower_fence AND y <= upper_fence) AS lower_whisker,
  max(y) FILTER (WHERE y >= lower_fence AND y <= upper_fence) AS upper_whisker,
  CAST(count(*) FILTER (WHERE NOT (y >= lower_fence AND y <= upper_fence)) AS BIGINT) AS outliers
FROM d JOIN f USING (studytime, target) GROUP BY studytime, target"""


@query("box_stats", r6(_BOX, "min", "q1", "median", "q3", "max", "lower_fence", "upper_fence", "lower_whisker", "upper_whisker"))
def box_stats(spark, d):
    """A10: grade box statistics by study time and class."""
    return audit.box_stats(fx.learners_labelled(spark, d), ["studytime", "target"], "g3")


@query("profile_by", r6(L + """SELECT target, count(absences) AS count, avg(absences) AS mean, quantile_cont(CAST(absences AS DOUBLE), 0.5e0) AS median,
  stddev_samp(absences) AS std FROM learners_t GROUP BY target""", "mean", "median", "std"))
def profile_by(spark, d):
    """Absences profile by outcome."""
    return audit.profile_by(fx.learners_labelled(spark, d), ["target"], "absences")


@query("value_shares", r6(L + "SELECT school AS value, count(*) AS count, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM learners GROUP BY school", "share"))
def value_shares(spark, d):
    """Value counts and shares."""
    return audit.value_shares(fx.learners(spark, d), "school")


_CAT = ["school", "sex", "mjob", "famsup", "schoolsup"]
_NUM = ["age", "failures", "absences", "studytime"]
_PROF_CAT = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, 'categorical' AS role, count(*) AS n_distinct, arg_min(v, struct_pack(a := -cnt, b := v)) AS mode,
  CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS BOOLEAN) AS is_integer, CAST(NULL AS VARCHAR) AS "values"
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM learners WHERE {c} IS NOT NULL GROUP BY 1) x""" for c in _CAT)
_PROF_NUM = " UNION ALL ".join(
    f"""SELECT '{c}', 'numeric', (SELECT count(DISTINCT {c}) FROM learners), NULL, min(v), max(v), quantile_cont(v, 0.5e0), true,
  (SELECT CASE WHEN count(*) <= 20 THEN string_agg(CAST(w AS VARCHAR), ',' ORDER BY w) END FROM (SELECT DISTINCT CAST({c} AS DOUBLE) AS w FROM learners) z)
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM learners WHERE {c} IS NOT NULL) x""" for c in _NUM)


@query("column_profile", r6(L + _PROF_CAT + " UNION ALL " + _PROF_NUM, "min", "max", "median"))
def column_profile(spark, d):
    """Scoring-form defaults per column."""
    return audit.column_profile(fx.learners(spark, d).select(*_CAT, *_NUM))


@query("class_weights", r6(L + "SELECT target AS class, count(*) AS n_class, sum(count(*)) OVER () / (2e0 * count(*)) AS weight FROM learners_t GROUP BY target", "weight"))
def class_weights_q(spark, d):
    """Balanced class weights."""
    return class_weights(fx.learners_labelled(spark, d))


@query("complete_counts", L + """SELECT d.failures, CAST(COALESCE(n, 0) AS BIGINT) AS count FROM (VALUES (0), (1), (2), (3), (4)) d(failures)
  LEFT JOIN (SELECT failures, count(*) AS n FROM learners GROUP BY failures) c USING (failures)""")
def complete_counts(spark, d):
    """Failures counted over the domain 0..4, zero filled."""
    return audit.complete_counts(fx.learners(spark, d).select("failures"), "failures", (0, 1, 2, 3, 4))


@query("distinct_values", L + "SELECT DISTINCT school FROM learners")
def distinct_values(spark, d):
    """U2"""
    return shape.distinct_values(fx.learners(spark, d), "school")


@query("is_subset", L + "SELECT count(*) = 0 AS is_subset, count(*) AS outside FROM learners_t WHERE target NOT IN (0, 1) OR target IS NULL")
def is_subset(spark, d):
    """Label values within {0, 1}."""
    return shape.is_subset(fx.learners_labelled(spark, d), "target", (0, 1))


@query("exclude", with_ctes(SCORED) + "SELECT row_id, grp FROM scored WHERE grp <> 'F'")
def exclude(spark, d):
    """U4: all groups but one."""
    return shape.exclude(fx.scored(spark, d).select("row_id", "grp"), "grp", "F")


@query("append_all", r6(L + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS count, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM learners GROUP BY {c}"
    for c in ("school", "mjob", "sex")), "share"))
def append_all(spark, d):
    """Value shares of three columns appended."""
    lr = fx.learners(spark, d)
    parts = [audit.value_shares(lr, c).select(F.lit(c).alias("column"), F.col("value").cast("string").alias("value"), "count", "share")
             for c in ("school", "mjob", "sex")]
    return shape.append_all(parts)


@query("preview", L + "SELECT * FROM learners ORDER BY row_id LIMIT 50")
def preview(spark, d):
    """First 50 rows (a preview report)."""
    return shape.preview(fx.learners(spark, d), 50)


@query("clean_params", r6(with_ctes(
    """tr AS (SELECT s_suppkey AS trial,
   pow(10e0, -3e0 + 5e0 * (CAST('0x' || substr(md5('C|' || CAST(s_suppkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0)) AS c,
   CAST(floor(2e0 * (CAST('0x' || substr(md5('l1|' || CAST(s_suppkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0)) AS INTEGER) AS l1 FROM supplier)""")
    + "SELECT trial, c AS \"C\", CAST(l1 AS DOUBLE) AS l1 FROM tr", "C"))
def clean_params(spark, d):
    """P21: 'clf__' prefixes stripped from search parameters (keys become columns)."""
    t = fx.trials(spark, d)
    m = t.select("trial", F.create_map(F.lit("clf__C"), F.col("c"), F.lit("clf__l1"), F.col("l1").cast("double")).alias("params"))
    c = shape.clean_params(m)
    return c.select("trial", F.col("params")["C"].alias("C"), F.col("params")["l1"].alias("l1"))
