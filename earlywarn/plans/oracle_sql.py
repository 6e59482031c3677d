"""DuckDB twins of the fixtures in ``earlywarn.sources.fixtures``.

Conventions for exact agreement: md5 prefix read with a ``0x`` cast, double
literals written ``e0``, integer truncation with ``floor``, integer sums cast
to BIGINT, doubles rounded to 6 places at the end of each query.
"""

from __future__ import annotations


_MIX = ["xor(_x, _x >> 16)", "(_x * 73244475) & 4294967295", "xor(_x, _x >> 16)", "(_x * 73244475) & 4294967295", "xor(_x, _x >> 16)"]


def _mixed(q: str) -> str:
    for e in _MIX:
        q = f"SELECT * REPLACE ({e} AS _x) FROM ({q}) s"
    return q


def key_hash_sql(src: str, cols: str, key: str, out: str = "kh") -> str:
    """Twin of ``earlywarn.functions.hashing.with_key_hash``."""
    k = f"CAST({key} AS BIGINT)"
    q = _mixed(f"SELECT {cols}, {k} AS _k, {k} & 4294967295 AS _x FROM {src}")
    q = _mixed(f"SELECT * REPLACE (xor(_x, (_k >> 32) & 4294967295) AS _x) FROM ({q}) s")
    return f"SELECT * EXCLUDE (_x, _k), _x AS {out} FROM ({q}) s"


def draw_sql(src: str, cols: str, state: str, key_hash: str, out: str = "u") -> str:
    """Twin of ``earlywarn.functions.hashing.with_draw``."""
    q = _mixed(f"SELECT {cols}, xor(CAST({state} AS BIGINT), CAST({key_hash} AS BIGINT)) AS _x FROM {src}")
    return f"SELECT * EXCLUDE (_x), _x / 4294967296e0 AS {out} FROM ({q}) s"


def U(tag: str, col: str) -> str:
    return f"(CAST('0x' || substr(md5('{tag}|' || CAST({col} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0)"


LEARNERS = f"""
learners_g AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderpriority, c.c_mktsegment,
         CAST(least(20, floor(o.o_totalprice / 15000e0)) AS INTEGER) AS g3
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
learners AS (
  SELECT o_orderkey AS row_id,
         c_mktsegment AS school,
         CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
         CAST(15 + o_custkey % 8 AS INTEGER) AS age,
         o_orderpriority AS mjob,
         CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'no' END AS famsup,
         CASE WHEN o_orderkey % 5 = 0 THEN 'yes' ELSE 'no' END AS schoolsup,
         CAST(floor(3.999e0 * (0.6e0 * (1e0 - g3 / 20e0) + 0.4e0 * {U('f', 'o_orderkey')})) AS INTEGER) AS failures,
         CAST(floor(30e0 * (0.5e0 * (1e0 - g3 / 20e0) + 0.5e0 * {U('a', 'o_orderkey')})) AS INTEGER) AS absences,
         CAST(1 + floor(3.999e0 * (0.5e0 * g3 / 20e0 + 0.5e0 * {U('s', 'o_orderkey')})) AS INTEGER) AS studytime,
         CAST(greatest(0, g3 - 1 - o_orderkey % 3) AS INTEGER) AS g1,
         CAST(least(20, g3 + o_orderkey % 2) AS INTEGER) AS g2,
         g3
  FROM learners_g
),
learners_t AS (SELECT *, CAST(g3 >= 10 AS INTEGER) AS target FROM learners)"""

PRICE = "least(1e0, o_totalprice / 500000e0)"

SCORED = f"""
scored AS (
  SELECT o_orderkey AS row_id, o_orderstatus AS grp,
         CAST(o_totalprice >= 150000e0 AS INTEGER) AS y_true,
         round(0.55e0 * {PRICE} + 0.45e0 * {U('42', 'o_orderkey')}, 3) AS y_prob
  FROM orders
)"""

OOF = f"""
oof_base AS (
  SELECT o_orderkey AS row_id, o_orderstatus AS grp,
         CAST(o_totalprice >= 150000e0 AS INTEGER) AS y_true,
         m.model, m.model_order,
         CASE m.model WHEN 'baseline' THEN 0.7e0
                      WHEN 'alpha' THEN round(0.55e0 * {PRICE} + 0.45e0 * {U('42', 'o_orderkey')}, 3)
                      ELSE round(0.35e0 * {PRICE} + 0.65e0 * {U('43', 'o_orderkey')}, 3) END AS y_prob
  FROM orders CROSS JOIN (VALUES ('baseline', 1), ('alpha', 2), ('beta', 3)) AS m(model, model_order)
),
oof AS (
  SELECT row_id, grp, y_true, model, model_order, y_prob,
         CAST(y_prob >= 0.5e0 AS INTEGER) AS y_pred,
         CAST((row_number() OVER (PARTITION BY model, y_true
                ORDER BY md5('42|fold|' || CAST(row_id AS VARCHAR)), row_id) - 1) % 5 AS INTEGER) AS fold
  FROM oof_base
)"""

# Confusion-count metric algebra in SQL, over columns tn, fp, fn, tp.
def metric_sql(name: str, strict: bool = False) -> str:
    z = "NULL" if strict else "0e0"
    d = lambda num, den: f"CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE {z} END"
    d0 = lambda num, den: f"CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0e0 END"
    f1r = d0("2*tn", "2*tn+fp+fn")
    f1p = d0("2*tp", "2*tp+fp+fn")
    table = {
        "accuracy": d0("tn+tp", "tn+fp+fn+tp"),
        "risk_recall": d("tn", "tn+fp"),
        "missed_risk_rate": d("fp", "tn+fp"),
        "false_alarm_rate": d("fn", "fn+tp"),
        "precision_risk": d("tn", "tn+fn"),
        "precision_pass": d0("tp", "tp+fp"),
        "recall_pass": d0("tp", "tp+fn"),
        "f1_risk": f1r,
        "f1_pass": f1p,
        "macro_f1": (f"CASE WHEN (tn+fp+fn > 0) AND (tp+fp+fn > 0) THEN ({f1r} + {f1p}) / 2e0 "
                     f"WHEN tn+fp+fn > 0 THEN {f1r} WHEN tp+fp+fn > 0 THEN {f1p} ELSE 0e0 END"),
        "bal_acc": (f"CASE WHEN (tn+fp > 0) AND (tp+fn > 0) THEN (CAST(tn AS DOUBLE)/(tn+fp) + CAST(tp AS DOUBLE)/(tp+fn)) / 2e0 "
                    f"WHEN tn+fp > 0 THEN CAST(tn AS DOUBLE)/(tn+fp) WHEN tp+fn > 0 THEN CAST(tp AS DOUBLE)/(tp+fn) ELSE 0e0 END"),
        "mcc": ("CASE WHEN sqrt(CAST(tp+fp AS DOUBLE)*(tp+fn)*(tn+fp)*(tn+fn)) <> 0 "
                "THEN (CAST(tp AS DOUBLE)*tn - CAST(fp AS DOUBLE)*fn) / sqrt(CAST(tp+fp AS DOUBLE)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0e0 END"),
    }
    return table[name]


def counts_sql(yt: str = "y_true", yp: str = "y_pred", w: str = "1") -> str:
    cast = "DOUBLE" if w != "1" else "BIGINT"
    return ", ".join(
        f"CAST(sum(CASE WHEN {yt} = {t} AND {yp} = {p} THEN {w} ELSE 0 END) AS {cast}) AS {n}"
        for n, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    )


def auc_sql(src: str, by: list[str], yt: str = "y_true", score: str = "y_prob") -> str:
    """ROC AUC per group with ties at half (Mann-Whitney on a score histogram)."""
    g = ", ".join(by)
    gp = (g + ", ") if by else ""
    part = f"PARTITION BY {g} " if by else ""
    return f"""(
  SELECT {gp}CASE WHEN sum(pos) > 0 AND sum(neg) > 0
              THEN sum(pos * (cum_neg - neg + neg / 2e0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auc
  FROM (SELECT *, sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
        FROM (SELECT {gp}{score} AS score, CAST(sum({yt}) AS BIGINT) AS pos, CAST(sum(1 - {yt}) AS BIGINT) AS neg
              FROM {src} GROUP BY {gp}{score}) h) c
  {"GROUP BY " + g if by else ""})"""


def ap_sql(src: str, by: list[str], yt: str = "y_true", score: str = "y_prob") -> str:
    """Average precision of the risk class ranked by 1 - p."""
    g = ", ".join(by)
    gp = (g + ", ") if by else ""
    part = f"PARTITION BY {g} " if by else ""
    return f"""(
  SELECT {gp}CASE WHEN sum(pos) > 0 THEN sum(pos * CAST(ctp AS DOUBLE) / (ctp + cfp)) / sum(pos) ELSE 0e0 END AS pr_auc_risk
  FROM (SELECT *, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp
        FROM (SELECT {gp}1e0 - {score} AS score, CAST(sum(1 - {yt}) AS BIGINT) AS pos, CAST(sum({yt}) AS BIGINT) AS neg
              FROM {src} GROUP BY {gp}1e0 - {score}) h
        WINDOW w AS ({part}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) c
  {"GROUP BY " + g if by else ""})"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


SUITE = ("accuracy", "bal_acc", "macro_f1", "f1_pass", "f1_risk", "precision_pass", "recall_pass",
         "precision_risk", "risk_recall", "missed_risk_rate", "false_alarm_rate", "auc", "pr_auc_risk", "mcc")


def suite_sql(src: str, by: list[str], metrics=SUITE, pred: str = "y_pred") -> str:
    """Per-group metric suite: confusion algebra joined with AUC and AP."""
    g = ", ".join(by)
    gp = (g + ", ") if by else ""
    conf = [m for m in metrics if m not in ("auc", "pr_auc_risk")]
    sel = ", ".join(f"{metric_sql(m)} AS {m}" if m in conf else m for m in metrics)
    if by:
        join = f"LEFT JOIN {auc_sql(src, by)} a USING ({g}) LEFT JOIN {ap_sql(src, by)} p USING ({g})"
    else:
        join = f"CROSS JOIN {auc_sql(src, by)} a CROSS JOIN {ap_sql(src, by)} p"
    return f"""SELECT {gp}{sel}
FROM (SELECT {gp}{counts_sql('y_true', pred)} FROM {src} {"GROUP BY " + g if by else ""}) cm
{join}"""


def r6(sql: str, *cols: str) -> str:
    """Round the named double columns to 6 places."""
    if not cols:
        return sql
    rep = ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) q"


DIRTY = """
dirty_base AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
         1 AS const
  FROM customer
),
dirty AS (SELECT * FROM dirty_base UNION ALL SELECT * FROM dirty_base WHERE c_custkey % 50 = 0)"""

RAW_LABELS = """
raw_labels AS (
  SELECT o_orderkey AS row_id,
         [' Pass', 'PASSED ', 'yes', 'True', 'fail', 'Failed', 'risk', 'At Risk', 'at-risk', 'No', 'false', '1', '0'][o_orderkey % 13 + 1] AS target
  FROM orders
)"""
