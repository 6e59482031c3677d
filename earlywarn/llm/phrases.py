"""Phrase collocation mining by Rabin-Karp fingerprints.

1. Tasks hash the words of whole texts and all runs of 1 to 4 words by numpy
   prefix polynomials, add up equal fingerprints and keep a pointer to one
   occurrence (39 bits of the text's hash, word offset); a shuffle adds up the
   rest.  A run is counted only if its parts may be frequent: first words,
   then pairs of such words, then runs of three and four of such pairs.  What
   is known to be frequent travels as a bitmap of fixed size; where it fills
   up more is counted, with the same result.
2. Two independent polynomials (64 and 32 bits) name a run, so a collision of
   the first is split by the second.
3. The pointers of frequent runs are joined to their texts; the run found
   there is hashed again, and only one that has the wanted fingerprints is
   written out.
4. Scores come from the counts of the parts, and absorbed runs are dropped,
   by joins on the fingerprints.

Defined results: a null text has no words, a null language is ``und``; rows
repeated count as often as they are listed; an empty table has no phrases;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.llm import textwords as tw
from earlywarn.llm import util

BREAKS = tw.byte_set(*[(ord(c), ord(c)) for c in ".,;:!?"], (0x0A, 0x0D))
GAPS = BREAKS | tw.byte_set((0x20, 0x20), (0x09, 0x09))
LONGEST = 4
COMBINED = 700_000  # runs added up at once in a task
FILTER_BITS = 26
OFFSET_BITS = 24
FAR = (1 << OFFSET_BITS) - 1  # offsets from here on: the run is looked for in the whole text
UNKNOWN = "und"
ROWS = "n int, key long, mark int, a long, ptr long"


def _parts(n: int) -> list[tuple[int, int]]:
    """(first word, words) of all proper parts of a run of ``n`` words."""
    return [(s, w) for w in range(1, n) for s in range(n - w + 1)]


class _Runs:
    """Fingerprints of all runs of words of some rows."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        self.words = w = tw.split(text, GAPS, lower=True)
        self.prints = [tw.word_prints(w, seed) for seed in tw.SEEDS]
        breaks = np.cumsum(BREAKS[w.data])[w.start] if len(w.start) else np.zeros(0, dtype=np.int64)
        # joined[i]: the words i and i + 1 stand in one piece
        self.joined = (w.doc[1:] == w.doc[:-1]) & (breaks[1:] == breaks[:-1])
        names = pc.dictionary_encode(pc.fill_null(lang, UNKNOWN))
        self.names = names.dictionary.to_pylist()
        self.code = names.indices.to_numpy(zero_copy_only=False)
        self.salt = np.array([tw.text_hash64(x) for x in self.names], dtype=np.uint64)
        self._made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def made(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Key and mark of the run of ``n`` words at every word (of any n
        words in a row, also across pieces)."""
        if n not in self._made:
            key, mark = [tw.gram_prints(p, n, s) for p, s in zip(self.prints, tw.SEEDS)]
            salt = self.salt[self.code[self.words.doc[: len(key)]]] if len(key) else key
            self._made[n] = tw.mixed(key + salt), (mark >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return self._made[n]

    def whole(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each word on stand in one piece."""
        ok = np.ones(max(0, len(self.words.start) - n + 1), dtype=bool)
        for i in range(n - 1):
            ok &= self.joined[i : i + len(ok)]
        return ok


def _combined(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Equal fingerprints of (n, key, mark, pointer) parts added up."""
    for n in sorted({p[0] for p in parts}):
        mine = [p for p in parts if p[0] == n]
        key = np.concatenate([p[1] for p in mine])
        if not len(key):
            continue
        order = np.argsort(key)
        key = key[order]
        mark, ptr = (np.concatenate([p[i] for p in mine])[order] for i in (2, 3))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
        at = np.flatnonzero(new)
        a = np.diff(np.append(at, len(key)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), n, dtype=np.int32)), pa.array(key[at].view(np.int64)), pa.array(mark[at]),
             pa.array(a), pa.array(np.minimum.reduceat(ptr, at))], ["n", "key", "mark", "a", "ptr"])


def _counter(lengths: list[int], below: int, bitmap: np.ndarray | None):
    """Counts of the runs of ``lengths`` whose parts of ``below`` words are all in ``bitmap``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        totals: dict[str, int] = {}
        for batch in batches:
            lang, text, th = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            for begin, end in tw.slices(text):
                runs = _Runs(text.slice(begin, end - begin), lang.slice(begin, end - begin))
                w = runs.words
                known = None if bitmap is None else tw.in_filter(bitmap, runs.made(below)[0])
                for n in lengths:
                    ok = runs.whole(n)
                    for i in range(n - below + 1 if known is not None else 0):
                        ok &= known[i : i + len(ok)]
                    at = np.flatnonzero(ok)
                    key, mark = runs.made(n)
                    doc = w.doc[at]
                    ptr = (th[begin:end][doc] << OFFSET_BITS) | np.minimum(at - w.first[doc], FAR)
                    held.append((n, key[at], mark[at], ptr))
                    size += len(at)
                if bitmap is None:
                    for name, m in zip(runs.names, np.bincount(runs.code[w.doc], minlength=len(runs.names)).tolist()):
                        totals[name] = totals.get(name, 0) + m
                if size > COMBINED:
                    yield from _combined(held)
                    held, size = [], 0
        yield from _combined(held)
        if totals:  # all words of a language, under n = 0
            keys = pa.array(np.array([tw.text_hash64(x) for x in totals], dtype=np.uint64).view(np.int64))
            zero = np.zeros(len(totals), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(zero), keys, pa.array(zero), pa.array(list(totals.values()), pa.int64()),
                 pa.array(zero.astype(np.int64))], ["n", "key", "mark", "a", "ptr"])

    return count


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases that the pointers (n, key, mark, offset) of a text name."""
    for batch in batches:
        lang, text, wanted = batch.column(0), batch.column(1), batch.column(2)
        for begin, end in tw.slices(text):
            runs = _Runs(text.slice(begin, end - begin), lang.slice(begin, end - begin))
            w = runs.words
            asked = wanted.slice(begin, end - begin)
            row = np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy())
            n, key, mark, off = (pc.struct_field(asked.flatten(), i).to_numpy() for i in range(4))
            key = key.view(np.uint64)
            out: dict[str, list] = {c: [] for c in ("lang", "lang_key", "n", "key", "mark", "phrase", "part_key", "part_mark")}
            for i in range(len(row)):
                size, lo, hi = int(n[i]), int(w.first[row[i]]), int(w.first[row[i] + 1])
                keys, marks = runs.made(size)
                at = lo + int(off[i])
                if off[i] == FAR:
                    hit = np.flatnonzero((keys[lo : hi - size + 1] == key[i]) & (marks[lo : hi - size + 1] == mark[i]))
                    at = lo + int(hit[0]) if len(hit) else hi
                if at + size > hi or keys[at] != key[i] or marks[at] != mark[i]:
                    continue  # another text with the same 39 bits
                made = {k: runs.made(k) for k in range(1, size)}
                out["lang"].append(runs.names[runs.code[row[i]]])
                out["lang_key"].append(int(runs.salt[runs.code[row[i]]].view(np.int64)))
                out["n"].append(size)
                out["key"].append(int(key[i].view(np.int64)))
                out["mark"].append(int(mark[i]))
                out["phrase"].append(w.text(at, at + size).decode())
                out["part_key"].append([int(made[k][0][at + s].view(np.int64)) for s, k in _parts(size)])
                out["part_mark"].append([int(made[k][1][at + s]) for s, k in _parts(size)])
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))


def _part(n: int, s: int, w: int) -> tuple[Column, Column]:
    at = _parts(n).index((s, w))
    return F.col("part_key")[at], F.col("part_mark")[at]


def _cuts() -> Column:
    """For a candidate, (k, fingerprints of the first k words and of the rest)."""
    out = F.lit(None)
    for n in range(2, LONGEST + 1):
        cuts = []
        for k in range(1, n):
            (lk, lm), (rk, rm) = _part(n, 0, k), _part(n, k, n - k)
            cuts.append(F.struct(F.lit(k).alias("k"), lk.alias("lk"), lm.alias("lm"), rk.alias("rk"), rm.alias("rm")))
        out = F.when(F.col("n") == n, F.array(*cuts)).otherwise(out)
    return out


def _inner() -> Column:
    """For a candidate, the fingerprints of its parts of two words or more."""
    out = F.array().cast("array<struct<key:long,mark:int>>")
    for n in range(3, LONGEST + 1):
        own = [F.struct(k.alias("key"), m.alias("mark")) for k, m in (_part(n, s, w) for s, w in _parts(n) if w > 1)]
        out = F.when(F.col("n") == n, F.array(*own)).otherwise(out)
    return out


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 30, absorbed: int = 80,
                 top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of every language: lang, rank, phrase, a (its
    count), l and r (of its parts at the lowest-scoring cut), n (words of the
    language), score = floor(2000000 a / (l + r)).  A phrase goes if a longer
    one that holds it has at least ``absorbed`` per cent of its count."""
    util.require(df, lang_col, text_col)
    text_mark = F.xxhash64(F.col(text_col)).bitwiseAND(F.lit((1 << 39) - 1))
    docs = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), text_mark.alias("th"))

    def frequent(lengths: list[int], below: int, bitmap) -> DataFrame:
        rows = docs.mapInArrow(_counter(lengths, below, bitmap), ROWS)
        sums = rows.groupBy("n", "key", "mark").agg(F.sum("a").alias("a"), F.min("ptr").alias("ptr"))
        return util.cut(sums.filter((F.col("n") == 0) | (F.col("a") >= min_count)), "phrase-counts")

    levels, bitmap = [], None
    for lengths, below in (([1], 0), ([2], 1), ([3, 4], 2)):
        got = frequent(lengths, below, bitmap)
        levels.append(got)
        if lengths != [3, 4]:
            bitmap = tw.key_filter(got.filter("n > 0"), F.col("key"), FILTER_BITS)

    # texts of the candidates
    counts = levels[0].unionByName(levels[1]).unionByName(levels[2])
    wanted = F.struct("n", "key", "mark", F.col("ptr").bitwiseAND(F.lit(FAR)).alias("off"))
    asked = counts.filter("n > 1").groupBy(F.shiftright("ptr", OFFSET_BITS).alias("th")).agg(F.collect_list(wanted).alias("wanted"))
    held = docs.join(util.cut(asked, "phrase-asked"), "th").select("lang", "text", "wanted")
    found = held.mapInArrow(
        _finder, "lang string, lang_key long, n int, key long, mark int, phrase string, part_key array<long>, part_mark array<int>")
    found = found.dropDuplicates(["n", "key", "mark"])
    cands = util.cut(found.join(counts.filter("n > 1").select("key", "mark", "a"), ["key", "mark"]), "phrase-found")

    # counts of the parts
    sizes = counts.filter("n > 0").select("key", "mark", F.col("a").alias("f"))
    cuts = cands.select("key", "mark", "a", F.explode(_cuts()).alias("c")).select("key", "mark", "a", "c.*")
    left = sizes.select(F.col("key").alias("lk"), F.col("mark").alias("lm"), F.col("f").alias("l"))
    right = sizes.select(F.col("key").alias("rk"), F.col("mark").alias("rm"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lk", "lm"]).join(right, ["rk", "rm"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", wide("a") * F.lit(2_000_000).cast("decimal(7,0)"), wide("l") + wide("r"))
    best = cuts.groupBy("key", "mark").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))

    # candidates held by a longer one of nearly the same count
    longer = cands.select(F.explode(_inner()).alias("x"), "a").groupBy("x.key", "x.mark").agg(F.max("a").alias("longer"))
    rows = cands.select("lang", "lang_key", "key", "mark", "phrase", "a").join(best, ["key", "mark"])
    rows = rows.join(longer, ["key", "mark"], "left")
    rows = rows.filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * absorbed))
    rows = rows.join(levels[0].filter("n = 0").select(F.col("key").alias("lang_key"), F.col("a").alias("n")), "lang_key")
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n",
                       F.col("c.score").cast("long").alias("score"))
