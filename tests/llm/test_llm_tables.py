"""Sharding, line dedup, vector search, mixing and the pipeline: results
against brute force or DuckDB, and the defined results of odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earlywarn.llm import ann, lines, mix, shard, topk, vectors
from tools.oracle_check import compare

SF = "/root/testdata/sf0.001"
CLASH = ["id", "w", "h", "d", "node", "key", "keys", "pos", "cid", "n", "e", "tokens", "cap", "rest", "vec", "block", "qb", "score"]


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


# -- sharding -----------------------------------------------------------------


def check_shards(rows, shards):
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    return [sum(r.size for r in rows if r.shard == s) for s in range(shards)]


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_and_keep_groups(spark, shards):
    rows = shard.kd_shards(docs(spark), shards=shards).collect()
    texts = {r.doc_id: r.text for r in docs(spark).collect()}
    sizes = check_shards(rows, shards)
    groups, places = {}, {}
    for r in rows:
        assert r.size == len((texts[r.id] or "").encode()) + 1
        groups[texts[r.id]] = groups.get(texts[r.id], 0) + r.size
        places.setdefault(texts[r.id], set()).add(r.shard)
    assert all(len(p) == 1 for p in places.values())
    # each of the cuts above a leaf is off by half a group at most
    assert max(sizes) - min(sizes) <= 3 * max(groups.values())


def brute_kd(points, leaves):
    """Leaves of a k-d tree by sorting: points are (dims, hash, weight, name)."""
    span = [max(p[0][i] for p in points) - min(p[0][i] for p in points) or 1.0 for i in range(len(points[0][0]))]
    if leaves == 1:
        return [points]

    def split(ps, leaves):
        if leaves == 1 or not ps:
            return [ps] + [[]] * (leaves - 1)
        width = [(max(p[0][i] for p in ps) - min(p[0][i] for p in ps)) / span[i] for i in range(len(span))]
        dim = max(range(len(width)), key=lambda i: (width[i], -i))
        target = sum(p[2] for p in ps) * (leaves // 2) / leaves
        groups = {}
        for p in ps:
            groups.setdefault((p[0][dim], p[1]), []).append(p)
        left, right, done, cut = [], [], 0, False
        for g in sorted(groups):
            w = sum(p[2] for p in groups[g])
            if not cut and (done + w < target or 2 * (target - done) >= w):
                left += groups[g]
                done += w
                cut = done >= target
            else:
                cut = True
                right += groups[g]
        return split(left, leaves // 2) + split(right, leaves - leaves // 2)

    return split(points, leaves)


def test_shards_equal_sorting(spark):
    r = random.Random(5)
    rows = [(i, r.choice("abc") * r.randint(0, 9), float(r.randint(0, 3)), float(r.choice([0, 0, 0, 7]))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x double, y double")
    # coordinates must follow from the text
    dims = [F.char_length("text").cast("double"), (F.ascii("text") % 3).cast("double")]
    got = shard.kd_shards(df, shards=5, dimensions=dims).collect()
    facts = df.select("doc_id", F.array(*dims).alias("d"), F.xxhash64("text").alias("h"), F.octet_length("text").alias("o")).collect()
    want = brute_kd([(tuple(x.d), x.h, x.o + 1, x.doc_id) for x in facts], 5)
    assert {r.id: r.shard for r in got} == {p[3]: s for s, leaf in enumerate(want) for p in leaf}


def test_shards_odd_inputs(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b" * 100_000), *[(i, "same text") for i in range(10, 40)]]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = shard.kd_shards(df, shards=4).collect()
    assert len(got) == len(rows)
    check_shards(got, 4)
    assert len({r.shard for r in got if r.id and r.id >= 10}) == 1
    assert shard.kd_shards(df.limit(0), shards=4).count() == 0
    assert {r.shard for r in shard.kd_shards(df, target_bytes=10**9).collect()} == {0}


# -- line dedup ---------------------------------------------------------------


def brute_any(rows, t=0.8):
    """Texts after dedup, by comparing every pair of lines."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = [], {}
    for doc, text in order:
        if text is None:
            out[doc] = None
            continue
        kept = []
        for line in text.split("\n"):
            words = set(line.lower().split())
            if not words or not any(len(words & s) >= t * len(words | s) for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        out[doc] = "\n".join(kept)
    return out


@pytest.mark.parametrize("t", [0.5, 0.8, 1.0])
def test_lines_equal_all_pairs(spark, t):
    """Families of near lines: dense, with chains that only earlier, removed lines join."""
    r = random.Random(int(t * 10))
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(r.randint(0, 8)):
            base = random.Random(r.randint(0, 5)).sample(vocab, 12)
            for _ in range(r.randint(0, 3)):
                base[r.randrange(len(base))] = r.choice(vocab)
            r.shuffle(base)
            text.append(r.choice([" ", "  ", "\t"]).join(base).upper() if r.random() < 0.2 else " ".join(base))
        rows.append((d, "\n".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in lines.dedup_lines(df, threshold=t).collect()}
    assert got == brute_any(rows, t)


def test_lines_odd_inputs(spark):
    rows = [(3, "b\n\n a  b \n"), (1, None), (2, ""), (4, "A B\nb a\n" * 500), (None, "x y z"), (7, "z y x"), (8, "c\r\nc"), (9, " \t")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("lines_in", F.lit("own"))
    out = lines.dedup_lines(df)
    got = {x.doc_id: x.text for x in out.collect()}
    assert got == brute_any(rows)
    assert [c for c in out.columns if c in CLASH] == CLASH and out.filter("key <> 'own key'").count() == 0
    twice = df.union(df.filter("doc_id = 3"))
    assert [x.text for x in lines.dedup_lines(twice).filter("doc_id = 3").collect()] == [got[3]] * 2
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_null_and_equal_ids(spark):
    """Other texts whose 32-bit hashes are equal, under no id and under one; copies without id."""
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{c} "), F.hex(F.xxhash64(F.lit(c), "id"))) for c in "ab"])
    texts = spark.range(400_000).select("id", text.alias("t"))
    pairs = texts.groupBy(F.hash("t").alias("h")).agg(F.collect_list("t").alias("ts")).filter(F.size("ts") > 1).limit(2).collect()
    assert len(pairs) == 2
    rows = [(None, t) for t in pairs[0].ts] + [(5, t) for t in pairs[1].ts] + [(6, t) for t in pairs[1].ts]
    rows += [(None, "one two\n\nthree four")] * 4 + [(7, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.text, r.lines_in, r.lines_out) for r in lines.dedup_lines(df).collect()))
    want = [("None", t, 2, 2) for t in pairs[0].ts] + [("5", t, 2, 2) for t in pairs[1].ts] + [("6", "", 2, 0)] * 2
    want += [("None", "one two\n\nthree four", 3, 3)] + [("None", "", 3, 1)] * 3 + [("7", "", 1, 0)]
    assert got == sorted(want)


def test_line_keys_of_odd_blanks(spark):
    """Each word has one key, rare words come first, and keys are never null, so that they are sorted as numbers."""
    texts = ["the A  the\u00c9 \u039f\u03a3\nthe\tB\x0bthe\r", "the\nthe a", "", " \n\t", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"{lines.ID} long, text string").withColumn(lines.MARK, F.lit(0))
    table = lines.rarity_table(df, "text")
    hashes = lines._hashes(F.col("line"), F.col("blanks"))
    got = lines._lines(df, "text").select("*", hashes.alias("hashes"), lines._keys(hashes, lines._ranks(table)).alias("keys"))
    assert not got.schema["keys"].dataType.containsNull
    words = ["the", "a", "the\u00e9", "\u03bf\u03c2", "b"]
    named = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    name = {r.h: r.w for r in named}
    assert len(table) == lines.BUCKETS and max(table) == table[next(r.h for r in named if r.w == "the") % lines.BUCKETS]
    rows = {(r[lines.ID], r.pos): r for r in got.collect()}
    for (doc, pos), r in rows.items():
        assert sorted(name[h] for h in r.hashes) == sorted(set(texts[doc].split("\n")[pos].lower().split()))
        assert r["keys"] == sorted((table[h % lines.BUCKETS] << 57) | ((h % (1 << 64)) >> 7) for h in r.hashes)
    assert len(rows) == 7


def test_queries_equal_their_sql(spark, duck):
    from earlywarn.llm import catalog

    catalog.load_all()
    assert {"op3_line_dedup", "op10_source_mix"} <= set(catalog.ORACLES)
    for name, sql in catalog.ORACLES.items():
        ok, why = compare(catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(sql).df())
        assert ok, (name, why)


# -- vector search ------------------------------------------------------------

VECTORS = [
    (0, [0.5, -0.25, 1.0]),
    (1, [0.5, -0.25, 1.0]),
    (2, None),
    (3, [float("nan"), 0.0, 1.0]),
    (4, [float("inf"), 0.0, 1.0]),
    (5, [0.0, 0.0, 0.0]),
    (6, [None, 1.0, 2.0]),
    (7, [3.0, 1.0]),
    (8, []),
    (9, [0.5, -0.25, 1.0]),
    (9, [0.5, -0.25, 1.0]),
    (None, [1.0, 1.0, 1.0]),
    (10, [-2.0, 0.3, 0.1]),
]


def brute_scores(rows, q, zero):
    use = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    use = [(i, np.array([*v, 0.0, 0.0][:3])) for i, v in use if zero or any(v)]
    mine = min(tuple(v) for i, v in use if i == q)
    return use, np.array(mine)


def test_top_k_odd_inputs(spark):
    df = clashing(spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>"))
    got = {}
    for r in topk.top_k(df, F.col("id") % 5 == 0, k=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 5, 10}
    for q, found in got.items():
        use, mine = brute_scores(VECTORS, q, True)
        want = sorted((-int(np.floor(256 * mine) @ np.floor(256 * v)), i) for i, v in use if i != q)[:4]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert topk.top_k(df.limit(0), F.col("id") % 5 == 0, k=4).count() == 0
    assert topk.top_k(df, F.col("id") == 77, k=4).count() == 0


def test_top_k_over_blocks(spark, monkeypatch):
    """Vectors of very different lengths, large whole numbers, several blocks."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 6)) * np.exp(rng.normal(size=(700, 1)))
    x[::40] *= 1e6  # products leave the whole numbers of a double
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    z = [[int(a) for a in np.floor(256 * v)] for v in x]
    got = {}
    for r in topk.top_k(df, F.col("id") % 50 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 700, 50):
        want = sorted((-sum(a * b for a, b in zip(z[q], z[i])), i) for i in range(700) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_ann_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    monkeypatch.setattr(ann, "LEAF", 8)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 5))
    x[100:200] = x[100]  # a run of ties
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("id") % 50 == 0, k=20, factor=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 900, 50):
        s = np.einsum("ij,j->i", x, x[q])
        want = sorted((-round(s[i], 9), i) for i in range(900) if i != q)[:20]
        assert [(v, round(c, 9)) for _, v, c in sorted(got[q])] == [(i, -c) for c, i in want]


def test_ann_recall_of_the_query(spark):
    from earlywarn.llm.queries import op7_vp_trees

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in op7_vp_trees(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = []
    for at in np.flatnonzero(ids % 20 == 0):
        s = x @ x[at]
        best = [i for i in np.lexsort((ids, -s)) if i != at][:20]
        assert all(abs(got[ids[at]][v] - s[np.flatnonzero(ids == v)[0]]) < 1e-12 for v in got[ids[at]])
        hits.append(len(set(ids[best]) & set(got[ids[at]])) / 20)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("case", ["one 3x", "lognormal"])
def test_ann_recall_of_unequal_lengths(spark, case):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    if case == "one 3x":
        x[7] *= 3
    else:
        x *= np.exp(0.5 * np.random.default_rng(3).normal(size=(len(x), 1)))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for at in np.flatnonzero(ids % 20 == 0):
        best = [i for i in np.lexsort((ids, -(x @ x[at]))) if i != at][:20]
        hits.append(len(set(ids[best]) & got[ids[at]]) / 20)
    assert np.mean(hits) >= 0.9, np.mean(hits)


def test_ann_odd_inputs(spark):
    df = clashing(spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>"))
    got = {}
    for r in ann.nearest(df, F.col("id") % 5 == 0, k=4, factor=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(got) == {0, 10}  # a zero vector takes no part
    for q, found in got.items():
        use, mine = brute_scores(VECTORS, q, False)
        want = sorted((-float(mine @ v), i) for i, v in use if i != q)[:4]
        assert sorted(found) == [(k + 1, i) for k, (_, i) in enumerate(want)]
    assert ann.nearest(df.limit(0), F.col("id") % 5 == 0, k=4).count() == 0


# -- mixing -------------------------------------------------------------------


def pour(node, given, weights, level):
    """Water-filling by raising the level step by step (floats): node maps
    names to children or to a leaf's supply."""
    if not isinstance(node, dict):
        return given
    supply = {k: total(v) for k, v in node.items()}
    share = {k: 0.0 for k in node}
    left = given
    open_ = {k for k in node if supply[k] > 0 and weights(level, k) > 0}
    while left > 1e-9 and open_:
        per = left / sum(weights(level, k) for k in open_)
        step = min([per, *[(supply[k] - share[k]) / weights(level, k) for k in open_]])
        for k in list(open_):
            share[k] += step * weights(level, k)
            left -= step * weights(level, k)
        open_ = {k for k in open_ if supply[k] - share[k] > 1e-9}
    return {k: pour(v, share[k], weights, level + 1) for k, v in node.items()}


def total(node):
    return sum(map(total, node.values())) if isinstance(node, dict) else node


def test_budgets_share_shortages_among_siblings_first(spark):
    r = random.Random(8)
    tree = {d: {x: {s: r.choice([0, 50, 400, 9000]) for s in "pqr"} for x in ("en", "de")} for d in "abc"}
    weights = {0: {("a",): 5, ("b",): 3}, 1: {("en",): 4, ("a", "de"): 1}, 2: {("q",): 7}}

    def weight(level, name):
        return {0: {"a": 5, "b": 3}, 1: {"en": 4}, 2: {"q": 7}}[level].get(name, 1)

    rows = [(d, x, s, t) for d, xs in tree.items() for x, ss in xs.items() for s, t in ss.items()]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    for budget in (0, 1000, 20_000, 10**7):
        got = mix.budgets(leaves, ["domain", "lang", "source"], weights, F.lit(budget), 1).collect()
        want = pour(tree, min(budget, total(tree)), weight, 0)
        for g in got:
            assert 0 <= want[g.domain][g.lang][g.source] - g.target < 8, (budget, g)  # whole tokens, rounded down


def test_mix_odd_inputs(spark):
    rows = [(1, "a b c", "en", "src0"), (2, None, "en", "src0"), (3, "", None, None), (4, "a b", "fr", "src1"), (4, "a b", "fr", "src1"), (None, "q " * 9, "en", "src2"), (5, "x " * 50_000, "en", "src3")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    levels = {"source": F.col("source"), "lang": F.col("lang")}
    every = mix.mix(df, levels, {}, 1.0, 1, 3)
    assert every.columns == df.columns and {r.doc_id for r in every.collect()} >= {1, 4, 5, None}
    assert mix.mix(df, levels, {}, 0.0, 1, 3).count() == 0
    assert mix.mix(df.limit(0), levels, {}, 1.0, 1, 3).count() == 0
    three = mix.select(df, levels, {}, 3.0, 3, 3).collect()
    assert {(r.id, r.copies) for r in three if r.tokens} == {(1, 3), (4, 3), (None, 3), (5, 3)}


def test_mix_buckets_do_not_change_the_prefix(spark, monkeypatch):
    levels = {"lang": F.col("lang")}
    want = sorted(mix.select(docs(spark), levels, {}, 0.5, 2, 1).collect(), key=str)
    monkeypatch.setattr(mix, "BUCKET_ROWS", 1)
    assert sorted(mix.select(docs(spark), levels, {}, 0.5, 2, 1).collect(), key=str) == want


@pytest.mark.parametrize("bucket", [20_000, 1])
def test_mix_takes_hot_and_null_ids_row_by_row(spark, monkeypatch, bucket):
    """A third of a leaf without id, a third of one id, some of them copies."""
    monkeypatch.setattr(mix, "BUCKET_ROWS", bucket)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"a b {i // 9}", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    levels = {"lang": F.col("lang")}
    for share in (0.1, 0.5, 0.9):
        got = mix.select(df, levels, {}, share, 1, 3)
        assert sum(r.tokens for r in got.collect()) == int(900 * share) // 3 * 3
        taken = mix.mix(df, levels, {}, share, 1, 3)
        ids = sorted((str(r.id) for r in got.collect()))
        assert sorted(str(r.doc_id) for r in taken.collect()) == ids and taken.columns == df.columns


def test_mix_reports_what_a_long_document_leaves(spark):
    rows = [(i, "x " * (1000 if i == 3 else 1), "en") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for seed in range(4):
        args = (df, {"lang": F.col("lang")}, {}, 0.5, 1, seed)
        r = mix.report(*args).first()
        assert (r.tokens, r.target) == (1009, 504)
        assert r.unspent == 504 - sum(x.tokens for x in mix.select(*args).collect()) > 0


# -- pipeline -----------------------------------------------------------------


def test_pipeline_stages(spark):
    """Each stage against brute force on its own input."""
    import corpus_pipeline as pipe
    from earlywarn.llm import langid, simhash
    from earlywarn.llm.queries import mix_levels
    from earlywarn.llm.util import cut

    assert [n for n, _ in pipe.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    junk = spark.createDataFrame([(10**6, "12 -- 34", "en", "src1", 8), (10**6 + 1, None, "en", "src1", 0)], docs(spark).schema)
    before = docs(spark).union(junk)
    columns = before.columns
    kept = cut(pipe.language_id(spark, before, SF), "t")
    model = langid.fit(before.filter(~langid.held_out()))
    want = set()
    for r in before.collect():
        lang, _, bits = model.predict([r.text])[0]
        if lang != "und" and bits <= model.most_bits():
            want.add(r.doc_id)
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == columns
    assert want == {r.doc_id for r in docs(spark).collect()}  # clean documents stay

    thin = cut(pipe.line_dedup(spark, kept, SF), "t")
    assert {r.doc_id: r.text for r in thin.collect()} == brute_any([(r.doc_id, r.text) for r in kept.collect()])
    assert thin.columns == columns and all(r.n_chars == len(r.text) for r in thin.collect())

    one = cut(pipe.near_dedup(spark, thin, SF), "t")
    groups = {r.id: r.component_id for r in simhash.near_duplicates(thin).collect()}
    assert {r.doc_id for r in one.collect()} == set(groups.values()) and one.columns == columns

    mixed = cut(pipe.mixing(spark, one, SF), "t")
    picked = mix.select(one, mix_levels(), pipe.WEIGHTS, **pipe.MIX).collect()
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.id for r in picked) and mixed.columns == columns
    assert sum(r.tokens for r in picked) <= 0.8 * sum(len(r.text.split()) for r in one.collect())

    pieces = pipe.packing(spark, mixed, SF).collect()
    assert {r.id for r in pieces} == {r.doc_id for r in mixed.collect()}
    whole = pipe.run(spark, SF)
    assert whole.count() > 0


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Repeated rows, equal ids with other text, null ids, and copies under both."""
    import corpus_pipeline as pipe
    from earlywarn.llm import simhash

    r = random.Random(6)
    a, b, c, d = (" ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (None, a), (3, b), (3, c), (4, b), (9, c), (None, d), (None, d), (None, d + " "), (None, c)]
    schema = docs(spark).schema
    full = [(i, t, "en", "src1", len(t)) for i, t in rows]
    got = pipe.near_dedup(spark, spark.createDataFrame(full, schema), SF)
    assert got.columns == schema.names
    kept = [(x.doc_id, x.text.strip()) for x in got.collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (3, b), (3, c), (None, d)], key=str)
    assert {x.component_id for x in simhash.near_duplicates(got).collect()} == {1, 3, None}
    assert pipe.near_dedup(spark, got.limit(0), SF).count() == 0
