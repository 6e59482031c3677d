"""The registered queries: thin wrappers that apply an operator to its whole
table and derive the contract's digest columns from the operator's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.llm import ann, langid, lines, mix, pack, pii, shard, simhash, tokfile, topk
from earlywarn.llm.catalog import query
from earlywarn.llm.tokens import tokenizer_path
from earlywarn.llm.util import table
from earlywarn.session import scratch_path


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    found = langid.predict(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op2_kd_shards")
def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard.kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return rows.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


BLANKS_SQL = r"[\x20\x09-\x0D]+"
LINES_SQL = rf"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    w AS (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '{BLANKS_SQL}'), lambda x: x <> ''))) AS s FROM l),
    classes AS (SELECT s, len(s) AS n, min(doc_id * 1048576 + pos) AS e FROM w WHERE len(s) > 0 GROUP BY s),
    df AS (SELECT t, count(*) AS c FROM (SELECT unnest(s) AS t FROM classes) GROUP BY t),
    p AS (SELECT e, n, t FROM (SELECT e, n, t, row_number() OVER (PARTITION BY e ORDER BY c, t) AS k
        FROM (SELECT e, n, unnest(s) AS t FROM classes) JOIN df USING (t) WHERE TRUE) WHERE k <= n - (4 * n + 4) // 5 + 1),
    pairs AS (SELECT DISTINCT a.e AS later, b.e AS earlier FROM p a JOIN p b
        ON a.t = b.t AND a.e > b.e AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
    gone AS (SELECT DISTINCT later FROM pairs JOIN classes x ON x.e = later JOIN classes y ON y.e = earlier
        WHERE 5 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
    stay AS (SELECT e FROM classes WHERE e NOT IN (SELECT later FROM gone)),
    kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM w
        WHERE len(s) = 0 OR doc_id * 1048576 + pos IN (SELECT e FROM stay) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::INTEGER AS lines_in, coalesce(k.n, 0)::INTEGER AS lines_out,
        CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.text, '')) END AS text_md5
    FROM documents d LEFT JOIN kept k USING (doc_id)"""


@query("op3_line_dedup", LINES_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"), threshold=0.8)
    return out.select("doc_id", "lines_in", "lines_out", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("op4_personal_data")
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.fit(docs))
    return found.select(
        F.col("id").alias("doc_id"),
        *[f"n_{k}" for k in pii.KINDS],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, length=1024)
    return pieces.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query("op6_exact_top_k")
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


@query("op7_vp_trees")
def op7_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokfile.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    rows = tokfile.read_tokens(spark, path)
    digests = tokfile.id_digests(rows.select("doc_id", "part", "before", "n_tokens", "ids"))
    meta = tokfile.read_tokens(spark, path).select("part", "n_tokens")
    return tokfile.with_start(digests, meta).select("doc_id", "start", "n_tokens", "ids_crc32")


# The source tree of the mixing query: sources by domain, whole-number weights by level.
DOMAINS = {
    "crawl": ["src0"],
    "reference": [f"src{i}" for i in range(1, 7)],
    "forum": [f"src{i}" for i in range(7, 14)],
}
WEIGHTS = {
    0: {("crawl",): 4, ("reference",): 3, ("forum",): 2, ("other",): 1},
    1: {("en",): 4, ("de",): 2, ("fr",): 2, ("es",): 2},
}
MIX = {"budget_share": 0.8, "max_epochs": 2, "seed": 7}


def domain(source: Column) -> Column:
    out = F.lit("other")
    for name, members in DOMAINS.items():
        out = F.when(source.isin(*members), F.lit(name)).otherwise(out)
    return out


def mix_levels() -> dict[str, Column]:
    return {"domain": domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def mix_sql(docs: str = "documents", share: float = MIX["budget_share"], epochs: int = MIX["max_epochs"], seed: int = MIX["seed"]) -> str:
    """DuckDB SQL of the selection: doc_id, the levels, tokens and copies."""
    cases = " ".join(f"WHEN source IN ({', '.join(repr(m) for m in ms)}) THEN '{d}'" for d, ms in DOMAINS.items())
    levels = ["domain", "lang", "source"]
    ctes = [
        f"""rows0 AS (SELECT doc_id, CASE {cases} ELSE 'other' END AS domain, coalesce(lang, 'none') AS lang,
            coalesce(source, 'none') AS source,
            coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM {docs})""".replace("\\\\", "\\"),
        f"leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {epochs} AS cap FROM rows0 GROUP BY ALL)",
        f"state_ AS (SELECT least(coalesce(sum(cap), 0), floor(coalesce(sum(tokens), 0) * {share}::DOUBLE))::BIGINT AS given FROM leaves)",
    ]
    before = "state_"
    for i in range(3):
        here, parent = ", ".join(levels[: i + 1]), ", ".join(levels[:i])
        by = f"PARTITION BY {parent}" if parent else ""
        case = "1"
        for key, w in WEIGHTS.get(i, {}).items():
            case = f"CASE WHEN {levels[i]} = '{key[0]}' THEN {w} ELSE {case} END"
        join = f"JOIN {before} USING ({parent})" if parent else f", {before}"
        ctes += [
            f"n{i} AS (SELECT {here}, sum(cap)::BIGINT AS cap, ({case})::BIGINT AS weight FROM leaves GROUP BY {here})",
            f"""f{i} AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
                sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS ahead
                FROM n{i} {join} WINDOW w AS ({by} ORDER BY cap / weight, {here}))""",
            f"s{i} AS (SELECT *, cap * ahead + before * weight <= given * weight AS fits FROM f{i})",
            f"""g{i} AS (SELECT {here}, (CASE WHEN fits THEN cap ELSE least(cap, (weight * (given - r.before)) // r.ahead) END)::BIGINT AS given
                FROM (SELECT *, min(CASE WHEN NOT fits THEN {{'before': before, 'ahead': ahead}} END) OVER ({by}) AS r FROM s{i}))""",
        ]
        before = f"g{i}"
    ctes += [
        "t AS (SELECT domain, lang, source, tokens AS total, given AS target, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole FROM leaves JOIN g2 USING (domain, lang, source))",
        f"k AS (SELECT doc_id, domain, lang, source, tokens, whole, target - whole * total AS rest, md5('{seed}|' || whole || '|' || doc_id) AS key FROM rows0 JOIN t USING (domain, lang, source))",
        "c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM k)",
    ]
    return f"""WITH {', '.join(ctes)}
        SELECT doc_id, domain, lang, source, tokens, copies FROM (
            SELECT *, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c)
        WHERE copies > 0"""


@query("op10_source_mix", mix_sql())
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix.select(docs, mix_levels(), WEIGHTS, **MIX).withColumnRenamed("id", "doc_id")
