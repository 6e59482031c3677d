"""Language ID, tokens, packing, token files, SimHash, personal data: results
against brute force, and the defined results of odd inputs."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from earlywarn.llm import langid, pack, pii, simhash, tagger, tokfile
from earlywarn.llm.tokens import ChunkEncoder, tokenizer_path
from earlywarn.session import scratch_path

SF = "/root/testdata/sf0.001"
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
LONG = "the quick brown fox jumps over the lazy dog 42 times. " * 4000
# null, empty, blank, repeated, tied and long texts; other columns with names that operators use inside
ODD = [
    (1, "the cat sat on the mat and looked at the dog", "en", "src0"),
    (2, None, "en", "src0"),
    (3, "", None, None),
    (4, " \t\n ", "fr", "src1"),
    (5, "the cat sat on the mat and looked at the dog", "en", "src2"),
    (5, "the cat sat on the mat and looked at the dog", "en", "src2"),
    (6, "le chat est sur la table et regarde le chien", "fr", "src2"),
    (7, LONG, "en", "src1"),
    (None, "le chat est sur la table et regarde le chien", "fr", None),
    (8, "12345 !!! ???", "en", "src0"),
    (9, "\U0001f600 é́ 中文 ok", None, "src9"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    clash = ["id", "part", "before", "n", "ids", "fp", "cell", "key", "pos", "tokens", "start", "found", "row", "lines_in"]
    return rows.withColumns({c: F.lit(f"own {c}") for c in clash}).withColumn("n_chars", F.char_length("text").cast("long"))


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


# -- language ID ------------------------------------------------------------


def phrases_by_search(text: str, learned: str) -> int:
    """Cross-parsing by substring search, in blocks."""
    total = 0
    for k in range(0, len(text), langid.BLOCK):
        block, i = text[k : k + langid.BLOCK], 0
        while i < len(block):
            j = i + 1
            while j <= len(block) and block[i:j] in learned:
                j += 1
            total += 1
            i = max(i + 1, j - 1)
    return total


def test_phrase_counts_equal_substring_search():
    r = random.Random(4)
    learned = [(x, "".join(r.choice(a) for _ in range(300))) for x, a in (("xx", "ab c"), ("yy", "abd "), ("zz", "éfg"))]
    model = langid.Model(learned)
    codes = langid.letter_codes(model.alphabet)
    for _ in range(30):
        text = "".join(r.choice("abcdéfgq !") for _ in range(r.randint(1, 2500)))
        coded = langid.encode(text, codes)
        as_text = "".join(map(chr, coded))
        pieces = -(-len(coded) // langid.BLOCK)
        blocks = np.full((pieces, langid.BLOCK), -1)
        blocks.reshape(-1)[: len(coded)] = coded
        got = model.phrases(blocks).sum(axis=1)
        want = []
        for lang in model.languages:
            own = " ".join(t for x, t in learned if x == lang)
            want.append(phrases_by_search(as_text, "".join(map(chr, langid.encode(f" {own} ", codes)))))
        assert got.tolist() == want


def test_language_held_out_accuracy(spark):
    table = docs(spark, "/root/testdata/sf0.01")
    model = langid.fit(table.filter(~langid.held_out()))
    got = langid.predict(table, model).join(table.withColumnRenamed("doc_id", "id"), "id")
    test = got.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2)
    right = test.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.98
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_odd_inputs(spark, odd):
    model = langid.fit(odd)
    got = {(r.id, r.lang_pred) for r in langid.predict(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (8, "und"), (1, "en"), (6, "fr"), (7, "en"), (None, "fr")} <= got
    assert langid.predict(odd.limit(0), model).count() == 0
    none = langid.fit(odd.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    beside = odd.select("doc_id", langid.language(model, F.col("text"), spark).alias("f"))
    assert {(r.doc_id, r.f.lang_pred) for r in beside.collect()} == got


# -- tokens -----------------------------------------------------------------


@pytest.mark.parametrize("name,leading", [(BYTE, True), (WORD, False)])
def test_chunks_encode_like_whole_texts(name, leading):
    from tokenizers import Tokenizer

    enc = ChunkEncoder(tokenizer_path(name), leading)
    r = random.Random(1)
    letters = list("aB 's't\n  \t\r.,!1 \u0085　᠎\x1c\x01ćé́ßΣς한中٣'ll​İ²ªµ ") + ["<|endoftext|>"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(3000)] + [LONG[:3000]]
    plain = letters[:-1]
    texts += ["".join(r.choice(plain) for _ in range(r.randint(0, 40))) for _ in range(6000)] + ["a <|endoftext|> b", "<|startoftext|>"]
    untouched = Tokenizer.from_file(tokenizer_path(name))
    flat, counts = enc.encode(texts + [None])
    at = 0
    for t, n in zip(texts, counts):
        assert flat[at : at + n].tolist() == untouched.encode(t, add_special_tokens=False).ids, repr(t)
        at += n
    assert at == len(flat) and counts[-1] == 0


def whole(name: str, text, end: int) -> list[int]:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(name))
    return [*tok.encode(text or "", add_special_tokens=False).ids, end]


def check_packing(pieces, texts: dict, length: int):
    """Pieces tile the stream, windows are full, ids are those of the texts."""
    rows = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    by_doc: dict = {}
    for r in rows:
        assert r.sequence_id * length + r.offset == at and 0 < r.length <= length - r.offset
        assert len(r.ids) == 4 * r.length
        at += r.length
        by_doc.setdefault((r.id, r.doc_tokens), []).append(r)
    return by_doc, at


def test_packing(spark, odd):
    got = pack.pack(odd, tokenizer_path(BYTE), 0, length=64).collect()
    by_doc, total = check_packing(got, {}, 64)
    want = [(i, whole(BYTE, t, 0)) for i, t, *_ in ODD]
    assert total == sum(len(x) for _, x in want)
    for i in {i for i, _ in want} - {5}:
        mine = sorted((r for r in got if r.id == i), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, dtype="<u4") for r in mine]).tolist()
        assert ids == next(x for k, x in want if k == i)
        assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine]])[:-1].tolist()
    assert sum(r.length for r in got if r.id == 5) == 2 * len(dict(want)[5])
    assert pack.pack(odd.limit(0), tokenizer_path(BYTE), 0).count() == 0


def test_packing_query(spark):
    from earlywarn.llm.queries import op5_packing

    rows = op5_packing(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs(spark).collect()}
    seqs = {}
    for r in rows:
        ids = whole(BYTE, texts[r.doc_id], 0)
        assert r.doc_tokens == len(ids)
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for s, parts in seqs.items():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
        assert ends[-1] == 1024 or s == len(seqs) - 1


def test_token_files(spark, odd):
    path = scratch_path(spark, "test-tokens")
    tokfile.write_tokens(odd, path, tokenizer_path(WORD), 2)
    rows = tokfile.read_tokens(spark, path).collect()
    want = sorted(((i is not None, i or 0, whole(WORD, t, 2)) for i, t, *_ in ODD))
    got = sorted(((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in rows))
    assert got == want
    index = sorted(tokfile.read_index(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in index] == np.cumsum([0, *[r.n_tokens for r in index]])[:-1].tolist()
    ids = [r.doc_id for r in index]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    plan = tokfile.read_index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan  # counts are read without the ids
    empty = scratch_path(spark, "test-tokens")
    tokfile.write_tokens(odd.limit(0), empty, tokenizer_path(WORD), 2)
    assert tokfile.read_index(spark, empty).count() == 0


def test_token_file_layout(spark):
    import glob

    import pyarrow.parquet as pq

    path = scratch_path(spark, "test-layout")
    tokfile.write_tokens(docs(spark), path, tokenizer_path(WORD), 2)
    files = glob.glob(path.removeprefix("file:") + "/*.parquet")
    meta = pq.ParquetFile(max(files, key=lambda f: pq.ParquetFile(f).metadata.num_rows)).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    ids = next(c for n, c in columns.items() if n.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings)
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index


def test_token_file_query(spark):
    from earlywarn.llm.queries import op9_token_files

    start = 0
    texts = {r.doc_id: r.text for r in docs(spark).collect()}
    for r in sorted(op9_token_files(spark, SF).collect(), key=lambda r: r.doc_id):
        ids = whole(WORD, texts[r.doc_id], 2)
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


# -- SimHash ----------------------------------------------------------------


def plain_fingerprint(text, size=4) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_pairs(ids, prints, k):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= k:
                root[find(a)] = find(b)
    low = {}
    for a, i in enumerate(ids):
        if i is not None:
            low[find(a)] = min(low.get(find(a), i), i)
    return [low.get(find(a)) for a in range(len(ids))]


def test_simhash_odd_inputs(spark, odd):
    got = sorted(((r.id is not None, r.id or 0, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(odd).collect()), key=str)
    prints = [plain_fingerprint(t) for _, t, *_ in ODD]
    comp = components_by_pairs([i for i, *_ in ODD], prints, 4)
    want = sorted(((r[0] is not None, r[0] or 0, p, c) for r, p, c in zip(ODD, prints, comp)), key=str)
    assert got == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("k,cell", [(4, 1 << 15), (4, 40), (2, 1 << 15), (0, 1 << 15), (7, 1 << 15)])
def test_links_join_what_all_pairs_join(spark, k, cell, monkeypatch):
    """Dense families of fingerprints, with and without splitting large cells."""
    monkeypatch.setattr(simhash, "CELL_ROWS", cell)
    r = random.Random(k)
    prints = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(40):
            x = base
            for b in r.sample(range(64), r.randint(0, k + 3)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), k).collect()
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        a, b = e.a % 2**64, e.b % 2**64
        root[find(a)] = find(b)
    want = components_by_pairs(list(range(len(prints))), prints, k)
    groups = {}
    for i, x in enumerate(prints):
        groups.setdefault(find(x), []).append(i)
    assert sorted(min(g) for g in groups.values()) == sorted(set(want))
    for g in groups.values():
        assert {want[i] for i in g} == {min(g)}


def test_simhash_query(spark):
    from earlywarn.llm.queries import op8_simhash

    rows = sorted(op8_simhash(spark, SF).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in docs(spark).collect()}
    prints = [plain_fingerprint(texts[r.doc_id]) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in rows] == components_by_pairs([r.doc_id for r in rows], prints, 4)


# -- personal data ----------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(text):
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def test_base_spans_equal_the_patterns():
    r = random.Random(2)
    for letters in ("a.b@-c1 ", "0123456789.", "01.2 -+()", "a@b.c+1 2-3.4\n", "4 -0"):
        for _ in range(3000):
            text = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(text) == plain_spans(text), repr(text)
    long = "1" * 200_000 + "@" + "a" * 200_000 + "1." * 100_000
    assert isinstance(pii.base_spans(long), list)  # linear, so this ends


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    model = tagger.Tagger(2, hidden=3)
    x = rng.integers(1, 90, (7, 4))
    mask, tags = np.ones((7, 4)), np.zeros((7, 4), dtype=int)
    mask[5:, 1] = x[5:, 1] = 0
    tags[2:4, 0], tags[0:2, 2], tags[6, 3] = (1, 2), (3, 4), 1
    _, grads = model.loss_and_gradients(x, mask, tags)
    for name, p in model.p.items():
        at = np.unravel_index(np.argmax(np.abs(grads[name])), p.shape)
        keep = p[at]
        p[at] = keep + 1e-5
        up = model.loss_and_gradients(x, mask, tags)[0]
        p[at] = keep - 1e-5
        down = model.loss_and_gradients(x, mask, tags)[0]
        p[at] = keep
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6, name


def test_viterbi_is_the_best_path():
    import itertools

    model = tagger.Tagger(1, hidden=4, seed=3)
    model.p["step"] += np.random.default_rng(1).normal(size=(3, 3))
    x = np.random.default_rng(2).integers(1, 90, (5, 6))
    mask = np.ones_like(x, dtype=bool)
    mask[1, 4:] = False
    tags, _ = model.decode(np.where(mask, x, 0), mask)
    e = model.emissions(np.where(mask, x, 0).T, mask.T.astype(float))[0]
    step, first = model.p["step"] + model.fixed_step, model.p["first"] + model.fixed_first
    for row in range(len(x)):
        n = int(mask[row].sum())

        def score(path, row=row, n=n):
            s = first[path[0]] + model.p["last"][path[-1]] + sum(e[t, row, k] for t, k in enumerate(path))
            return s + sum(step[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(3), repeat=n), key=score)
        assert tags[row][:n].tolist() == list(best)


def test_tagger_learns_spans(spark):
    """Held-out spans found by the tagger alone."""
    texts = [r.text for r in docs(spark, "/root/testdata/sf0.01").orderBy("doc_id").collect()]
    texts = [t for t in texts if plain_spans(t)]
    cut = len(texts) * 2 // 3
    x, mask, tags, _ = pii.examples(texts[:cut], limit=256)
    model = tagger.Tagger(len(pii.KINDS))
    losses = model.fit(x, mask, tags, epochs=20, batch=32)
    assert losses[-1] < losses[0] / 20
    alone = pii.added_spans(model.single(), texts[cut:], [[] for _ in texts[cut:]])
    hits = sum(any(s < e2 and s2 < e for s2, e2, _ in got) for t, got in zip(texts[cut:], alone) for s, e, _ in plain_spans(t))
    assert hits / sum(len(plain_spans(t)) for t in texts[cut:]) > 0.6


def test_windows_are_reconciled():
    text = "x" * 90 + " a1@b.co " + "y" * 200
    found = [(91, 96, 0, 5.0), (94, 98, 0, 7.0), (92, 99, 2, 6.0), (150, 160, 1, 99.0), (200, 210, 3, 1.0)]
    assert pii.reconcile(text, found, []) == [(91, 98, 0)]  # joined; the crossing card is weaker; no digit; too weak
    assert pii.reconcile(text, found, [(95, 97, 1)]) == []  # base spans stay


def test_personal_data_odd_inputs(spark):
    rows = [(1, "mail a.b@c.de now"), (2, None), (3, ""), (3, ""), (4, "ok 1.2.3.4 " * 3000), (None, "+49 151 2345678"), (5, "4111 1111 1111 1111")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("spans", F.lit(2))
    got = {(r.id, r.base, r.n_ip) for r in pii.find_personal_data(df, None).collect()}
    want = {(i, pii.listed(plain_spans(t or "")), sum(k == 1 for *_, k in plain_spans(t or ""))) for i, t in rows}
    assert got == want
    model = pii.fit(df)
    more = {r.id: (r.base, r.spans) for r in pii.find_personal_data(df, model).collect()}
    for base, spans in more.values():
        assert set(filter(None, base.split(","))) <= set(filter(None, spans.split(",")))
    assert pii.fit(df.limit(0)) is None and pii.find_personal_data(df.limit(0), model).count() == 0


def test_personal_data_query(spark):
    import hashlib

    from earlywarn.llm.queries import op4_personal_data

    texts = {r.doc_id: r.text for r in docs(spark).collect()}
    for r in op4_personal_data(spark, SF).collect():
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in base) for x in range(4)]
