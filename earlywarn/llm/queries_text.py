"""The registered queries of phrase mining, lexical search and repeat removal, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.llm import phrases, repeats, search
from earlywarn.llm.catalog import query
from earlywarn.llm.util import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES_SQL = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
    w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
    total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    f AS (SELECT lang, k, g, count(*) AS c FROM (
        SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k))
        GROUP BY lang, k, g HAVING count(*) >= 30),
    c AS (SELECT lang, k, g, c AS a, string_split(g, ' ') AS w FROM f WHERE k > 1),
    cuts AS (SELECT lang, g, a, i, array_to_string(w[1:i], ' ') AS x, array_to_string(w[i + 1:k], ' ') AS y
        FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
    scored AS (SELECT u.lang, u.g, u.a, u.i, l.c AS l, r.c AS r, (2000000::HUGEINT * u.a // (l.c + r.c))::BIGINT AS score
        FROM cuts u JOIN f l ON l.lang = u.lang AND l.g = u.x JOIN f r ON r.lang = u.lang AND r.g = u.y),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
    inside AS (SELECT lang, a, array_to_string(w[s:s + m - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))),
    gone AS (SELECT DISTINCT c.lang, c.g FROM c JOIN inside i USING (lang, g) WHERE 100::HUGEINT * i.a >= 80::HUGEINT * c.a),
    kept AS (SELECT * FROM best ANTI JOIN gone USING (lang, g)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
    SELECT lang, rank::BIGINT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
    FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


@query("op11_phrases", PHRASES_SQL)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), min_count=30, absorbed=80, top=2000)


TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}') AS t FROM documents),
    stats AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
    i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}'))) AS term FROM benchmark),
    p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d)
        WHERE term IN (SELECT term FROM i) GROUP BY ALL),
    df AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, stats),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
        FROM i JOIN p USING (term) JOIN w USING (term), stats GROUP BY item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50"""


@query("op12_lexical_search", SEARCH_SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=50)


REPEATS_SQL = r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT row, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM d)),
    many AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1),
    gone AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS i FROM s SEMI JOIN many USING (s)),
    kept AS (SELECT row, string_agg(x, ' ' ORDER BY i) AS text, count(*) AS n
        FROM (SELECT row, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (row, i) GROUP BY row)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (row)"""


@query("op13_substring_dedup", REPEATS_SQL)
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    digest = F.sha2(F.array_join(words, " ").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))
