"""Phrases, lexical search and repeated passages against brute force, and the
defined results of odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from earlywarn.llm import phrases, repeats, search
from earlywarn.llm import textwords as tw

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ["id", "th", "key", "mark", "n", "a", "ptr", "g", "s0", "k1", "k2", "pos", "starts", "q", "t", "score", "rank",
         "n_words", "n_removed", "held", "__rep_row"]


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH if c not in df.columns})


def random_texts(seed, n, words=9):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "GAMMA", "délta", "eps", "ζeta", "a.b", "x,y"][:words]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", "\n", ". ", "; ", "\x0b"])
                           for _ in range(rng.randrange(0, 60))))
    return out


# -- words and fingerprints -------------------------------------------------


def test_words_and_prints():
    texts = ["", None, " a  bb ", "x", "é中 \U0001f600", "a" * 50, "tail", " "]
    w = tw.split(pa.array(texts), tw.BLANK)
    got = [[w.data[w.start[i]:w.end[i]].tobytes().decode() for i in range(w.first[r], w.first[r + 1])] for r in range(len(texts))]
    assert got == [(t or "").split() for t in texts]
    assert w.array().to_pylist() == [x.encode() for t in texts for x in (t or "").split()]
    a, b = (tw.word_prints(w, s) for s in tw.SEEDS)
    assert len(set(a.tolist())) == len(set(b.tolist())) == len(a) and not np.any(a == b)


def test_prints_do_not_depend_on_place(monkeypatch):
    text = " ".join(random.Random(1).choice(["one", "two", "three", "four"]) for _ in range(3000))
    w = tw.split(pa.array([text, "one " + text]), tw.BLANK)
    whole = tw.word_prints(w, 11)
    monkeypatch.setattr(tw, "SPAN_BYTES", 64)
    assert np.array_equal(whole, tw.word_prints(w, 11))
    grams = tw.gram_prints(whole, 5, 11)
    by = defaultdict(set)
    words = text.split() + ["one"] + text.split()
    for i, g in enumerate(grams.tolist()):
        by[tuple(words[i:i + 5])].add(g)
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({next(iter(v)) for v in by.values()})


# -- phrases ----------------------------------------------------------------


def brute_phrases(rows, least, top):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    count[lang][tuple(w[i:i + n])] += 1
    out = set()
    for lang, f in count.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = defaultdict(int)
        for p, a in cands.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    held[p[s:s + m]] = max(held[p[s:s + m]], a)
        rows_ = []
        for p, a in cands.items():
            if 100 * held[p] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top]):
            out.add((lang, i + 1, p.decode(), -a, l, r, total[lang], -s))
    return out


@pytest.mark.parametrize("bits,combined", [(26, 2_000_000), (7, 50)])
def test_phrases_brute_force(spark, monkeypatch, bits, combined):
    """Also with a bitmap so small that it is full, and with many partial sums."""
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)
    monkeypatch.setattr(phrases, "COMBINED", combined)
    rng = random.Random(3)
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in random_texts(5, 150)] + [("en", None), ("fr", ""), (None, " .\n")]
    df = clashing(spark.createDataFrame(rows, "lang string, text string").repartition(5))
    got = {tuple(r) for r in phrases.collocations(df, min_count=6, top=40).collect()}
    assert got == brute_phrases(rows, 6, 40) and len(got) > 60


def test_phrases_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).collect() == []


def test_phrase_pointers():
    """A pointer to another text finds nothing; a far one is looked for in its text."""
    text, lang = pa.array(["a b c a b", "c c"]), pa.array(["en", None])
    runs = phrases._Runs(text, lang)
    key, mark = (x[3] for x in runs.made(2))
    wanted = [[{"n": 2, "key": int(key.view(np.int64)), "mark": int(mark), "off": off} for off in (3, phrases.FAR, 1)], []]
    kind = pa.list_(pa.struct([("n", pa.int32()), ("key", pa.int64()), ("mark", pa.int32()), ("off", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([lang, text, pa.array(wanted, kind)], ["lang", "text", "wanted"])
    found = [r for b in phrases._finder([batch]) for r in b.to_pylist()]
    assert [r["phrase"] for r in found] == ["a b", "a b"]


def test_colliding_fingerprints_are_told_apart():
    """Runs of one 64-bit key and other marks are counted apart."""
    key, mark = np.array([7, 7, 7, 9], dtype=np.uint64), np.array([1, 2, 1, 1], dtype=np.int32)
    got = [r for b in phrases._combined([(2, key[:2], mark[:2], np.array([5, 6])), (2, key[2:], mark[2:], np.array([3, 4]))]) for r in b.to_pylist()]
    sums = Counter()
    for r in got:
        sums[r["key"], r["mark"]] += r["a"]
    assert sums == {(7, 1): 2, (7, 2): 1, (9, 1): 1}


# -- lexical search -----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(items, docs, k):
    terms = [(i, TERM.findall((t or "").translate(ASCII_LOWER))) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in items:
        rows = []
        for i, t in terms:
            if not t:
                continue
            m, tf, score = 50 + (50 * len(t) * n_docs) // n_terms, Counter(t), 0
            for x in set(TERM.findall((text or "").translate(ASCII_LOWER))):
                if tf[x]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    score += w * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 20 * m))
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(rows)[:k])]
    return Counter(out)


@pytest.mark.parametrize("item_bytes", [1 << 20, 40])
def test_search_brute_force(spark, monkeypatch, item_bytes):
    monkeypatch.setattr(search, "ITEM_BYTES", item_bytes)
    texts = random_texts(8, 300)
    docs = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (900, None), (901, ""), (902, "?!")]
    items = [(1, "alpha DÉLTA"), (2, texts[0]), (3, None), (4, "unknown words"), (5, "beta"), (5, "ζeta eps"), (6, " ".join(texts[1:9])),
             (None, "gamma")]
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    i = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = Counter(tuple(r) for r in search.rank_documents(i, d, k=7).collect())
    assert got == brute_search(items, docs, 7)


def test_search_many_terms_and_empty(spark):
    """More terms than one machine word of mask bits; empty tables."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 80)))) for i in range(400)]
    items = [(1, " ".join(vocab[:150])), (2, " ".join(vocab))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in search.rank_documents(i, d, k=20).collect()) == brute_search(items, docs, 20)
    assert search.rank_documents(i.limit(0), d).collect() == []
    assert search.rank_documents(i, d.limit(0)).collect() == []


# -- repeated passages --------------------------------------------------------


def brute_repeats(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passages(seed, vocab):
    rng = random.Random(seed)
    words = lambda n: [f"{rng.choice('abc')}{rng.randrange(vocab)}" for _ in range(n)]
    shared = [words(n) for n in (12, 34, 35, 36, 60, 90)]
    texts = []
    for _ in range(60):
        w = words(rng.randrange(0, 50))
        for s in rng.sample(shared, rng.randrange(0, 3)):
            w += s + words(rng.randrange(0, 30))
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    whole = " ".join(words(70))
    near = whole.split()
    near[40] = "other"
    return texts + [whole] * 25 + [" ".join(near)] * 3 + [" ".join(shared[4] * 3)] + [None, "", " ", "x " * 500, "x " * 34, "solo"]


@pytest.mark.parametrize("window,group,bits", [(35, 200_000, 27), (35, 3, 8), (5, 10, 20), (12, 2, 16), (24, 2, 16), (1, 5, 16)])
def test_repeats_brute_force(spark, monkeypatch, window, group, bits):
    """Also with groups that must be split by longer prefixes and a bitmap that is full."""
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "FILTER_BITS", bits)
    texts = passages(window, 300 if window > 1 else 5000)
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.col("doc_id")).repartition(7))
    out = repeats.remove_repeats(df, window=window)
    assert out.columns[:2] == ["doc_id", "text"] and out.columns[-2:] == ["n_words", "n_removed"]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.text if r.n_removed else None) for r in out.collect())
    want = Counter((i, n, g, kept if g else None) for (i, _), (n, g, kept) in zip(rows, brute_repeats(texts, window)))
    assert got == want


def test_repeats_keep_clean_texts(spark):
    rows = [(1, " spaced  out\ntext "), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in repeats.remove_repeats(df).collect()} == set(rows)
    assert repeats.remove_repeats(df.limit(0)).collect() == []


def test_suffix_order_across_batches():
    """A node whose leaves lie in several batches is found once per leaf."""
    rng = random.Random(6)
    rows = sorted((g, s) for g in range(3) for s in rng.choices(range(40), k=60))
    rows = [(g, s, i) for i, (g, s) in enumerate(rows)]
    count = Counter((g, s) for g, s, _ in rows)
    for size in (1, 2, 7, 500):
        batches = []
        for i in range(0, len(rows), size):
            g, s, p = zip(*rows[i:i + size])
            batches.append(pa.RecordBatch.from_arrays(
                [pa.array(g, pa.int64()), pa.array(s, pa.int64()), pa.array(p, pa.int64()), pa.array(p, pa.int64()), pa.array(p, pa.int64())],
                ["s0", "s1", "k1", "k2", "run"]))
        got = [x for b in repeats._deep_nodes(iter(batches)) for x in b["run"].to_pylist()]
        assert sorted(got) == [i for g, s, i in rows if count[g, s] > 1]


def test_digest_of_kept_words(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = {d.doc_id: (n, g, hashlib.sha256(k.encode()).hexdigest()) for d, (n, g, k) in zip(docs, brute_repeats([d.text for d in docs], 35))}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in entry.queries()["op13_substring_dedup"](spark, sf).collect()}
    assert got == want
