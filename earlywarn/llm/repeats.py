"""Removal of repeated passages by prefix-partitioned suffix trees.

A passage of ``window`` words repeats if its word sequence starts anywhere
else too.  A suffix of a text is followed for ``window`` words, read as a few
symbols: fingerprints of 18 words or fewer.

1. Every window holds one anchor, the 8 words of smallest hash in it; equal
   windows hold equal anchors.  Anchors are counted over all texts, and the
   places of those that occur twice or more form a bitmap of fixed size.  Only
   suffixes whose anchor is in it can repeat; where the bitmap fills up, more
   suffixes are shipped, with the same result.
2. Suffixes are split by prefixes of variable length into groups of a size
   that fits a task: by their first symbol, by two where that symbol is
   common, by all where two are.  Suffixes that agree to the full depth within
   one slice of a task are known to repeat and are passed on as runs; one of
   them stands for them, so a passage of any number of copies is shipped once
   per slice.
3. Spark sorts every group; neighbours in this order share the longest
   prefixes, which is the group's suffix tree.  A node as deep as the window
   is a repeat, and all leaves below it start one.
4. The places found return to their texts, by 128 bits of the text, and the
   words under a repeated window go.

Defined results: a null text stays null and has no words; a text without
repeats is passed on as it is, any other one becomes its kept words joined by
one blank; rows of equal text are occurrences of their own, so copies of
``window`` words or more lose all of them; ids are not read, so null and
repeated ids do no harm; an empty table gives an empty result; other columns
are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import textwords as tw
from earlywarn.llm import util

ANCHOR = 8  # words of an anchor
SYMBOL = 18  # words of a symbol, at most
COMBINED = 500_000  # suffixes or anchors added up at once in a task
FILTER_BITS = 27
BINS = 14  # bits: hashed prefixes counted before the split
GROUP = 200_000  # suffixes of one group, before the prefix is made longer
SEED = tw.SEEDS[0]
K1, K2, TEXT, MARKS = "__rep_k1", "__rep_k2", "__rep_text", "__rep_at"


def _prints(texts: pa.Array) -> tuple[tw.Words, np.ndarray]:
    w = tw.split(texts, tw.BLANK)
    return w, tw.word_prints(w, SEED)


def _window_starts(w: tw.Words, window: int) -> np.ndarray:
    """Words from which on a text has ``window`` words."""
    n = len(w.doc) - window + 1
    return np.flatnonzero(w.doc[:n] == w.doc[window - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest value (the first of equal ones) in every run of
    ``span`` values, by doubling."""
    at = np.arange(len(values))
    done = 1
    while done < span:
        step = min(done, span - done)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        done += step
    return at


def _anchors(prints: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and place of the anchor of the windows at ``starts``."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    size = min(ANCHOR, window)
    grams = tw.gram_prints(prints, size, SEED)
    at = _least(grams, window - size + 1)[starts]
    return grams[at], at


def _anchor_counter(window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def combined():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

        for batch in batches:
            for begin, end in tw.slices(batch.column(0)):
                w, prints = _prints(batch.column(0).slice(begin, end - begin))
                key, at = _anchors(prints, _window_starts(w, window), window)
                # an anchor of several windows of one text is one occurrence
                new = np.ones(len(at), dtype=bool)
                new[1:] = at[1:] != at[:-1]
                held.append(key[new])
                size += len(held[-1])
                if size > COMBINED:
                    yield combined()
                    held, size = [], 0
        if size:
            yield combined()

    return count


def _symbols(prints: np.ndarray, starts: np.ndarray, window: int) -> list[np.ndarray]:
    """The symbols on the path of each suffix, of nearly equal length."""
    parts = -(-window // SYMBOL)
    edges = [window * i // parts for i in range(parts + 1)]
    made = {n: tw.gram_prints(prints, n, SEED) for n in {b - a for a, b in zip(edges, edges[1:])}}
    return [made[b - a][starts + a] for a, b in zip(edges, edges[1:])]


def _suffixes(texts: pa.Array, window: int, bitmap: np.ndarray) -> tuple[tw.Words, np.ndarray, list[np.ndarray]]:
    """Starts and symbols of the suffixes whose anchor may repeat."""
    w, prints = _prints(texts)
    starts = _window_starts(w, window)
    key, _ = _anchors(prints, starts, window)
    starts = starts[tw.in_filter(bitmap, key)] if len(starts) else starts
    if not len(starts):
        return w, starts, []
    return w, starts, _symbols(prints, starts, window)


def _bin(symbols: list[np.ndarray], depth: int) -> np.ndarray:
    out = np.full(len(symbols[0]), depth, dtype=np.uint64)
    for s in symbols[:depth]:
        out = tw.mixed(out + s)
    return out


def _runs(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the whole path, and where a new path begins in it."""
    key = _bin(symbols, len(symbols))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for s in [key, *symbols]:
        x = s[order]
        new[1:] |= x[1:] != x[:-1]
    return order, new


def _bin_counter(window: int, bitmap: np.ndarray):
    """Suffixes (one of each path in a slice) by the bin of their prefix of one and of two symbols."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, 1 << BINS), dtype=np.int64)
        for batch in batches:
            for begin, end in tw.slices(batch.column(0)):
                _, starts, symbols = _suffixes(batch.column(0).slice(begin, end - begin), window, bitmap)
                if len(starts):
                    order, new = _runs(symbols)
                    for depth in range(1, min(2, len(symbols)) + 1):
                        place = _bin([s[order[new]] for s in symbols], depth) >> np.uint64(64 - BINS)
                        sums[depth] += np.bincount(place.astype(np.int64), minlength=1 << BINS)
        depth, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(depth.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sums[depth, place])], ["d", "b", "n"])

    return count


def _one_by_one(starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where a start does not follow the one before it in the same text."""
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])
    return new


def _shipper(window: int, bitmap: np.ndarray, common: np.ndarray):
    """Rows (symbols that tell the group, path, text, run of starts) of the
    suffixes, in the order of the texts; path null: a run known to repeat,
    once per text and slice, with a depth below one that spreads them."""
    parts = -(-window // SYMBOL)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in batches:
            text, k1, k2 = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for begin, end in tw.slices(text):
                w, starts, symbols = _suffixes(text.slice(begin, end - begin), window, bitmap)
                if not len(starts):
                    continue
                doc = w.doc[starts]
                pos = starts - w.first[doc]
                a, b = k1[begin:end][doc], k2[begin:end][doc]
                order, new = _runs(symbols)
                at = np.flatnonzero(new)
                size = np.diff(np.append(at, len(order)))
                known = np.zeros(len(order), dtype=bool)
                known[order] = np.repeat(size > 1, size)
                # one suffix of each path stands for it; those known to repeat are passed on as found
                one = np.sort(order[at])
                paths = [s[one] for s in symbols]
                depth, deeper = np.ones(len(one), dtype=np.int32), True
                for d in range(1, min(parts, 3)):
                    deeper = deeper & (common[d][_bin(paths, d) >> np.uint64(64 - BINS)] > GROUP)
                    depth[deeper] = 2 if d == 1 else parts
                yield _rows(depth, paths, a[one], b[one], pos[one], np.ones(len(one), dtype=np.int64))
                at = np.flatnonzero(known)
                new = np.flatnonzero(_one_by_one(starts[at], doc[at]))
                n, at = np.diff(np.append(new, len(at))), at[new]
                own = np.unique(np.stack([a[at], b[at], pos[at], n]), axis=1)
                yield _rows(np.full(own.shape[1], -task, dtype=np.int32), [None] * parts, *own)

    return ship


def _rows(depth: np.ndarray, paths: list, k1: np.ndarray, k2: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    paths = [pa.nulls(len(pos), pa.int64()) if p is None else pa.array(p.view(np.int64)) for p in paths]
    return pa.RecordBatch.from_arrays(
        [pa.array(depth), *paths, pa.array(k1), pa.array(k2), pa.array((pos << 32) | n)],
        ["depth", *[f"s{i}" for i in range(len(paths))], "k1", "k2", "run"])


def _deep_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves below a node of full depth, from sorted suffixes: a leaf shares
    its whole path with a neighbour.  The last leaf of a batch waits for the
    next one."""
    held, held_repeats = None, False
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        done = table["s0"].is_null().to_numpy()
        same = ~(done[1:] | done[:-1])
        for c in [c for c in table.column_names if c[0] == "s"]:
            x = pc.fill_null(table[c], 0).to_numpy()
            same &= x[1:] == x[:-1]
        deep = done.copy()
        deep[1:] |= same
        deep[:-1] |= same
        deep[0] |= held_repeats
        out = np.flatnonzero(deep[:-1])
        held, held_repeats = table.slice(len(table) - 1), bool(deep[-1])
        if len(out):
            yield table.take(pa.array(out)).select(["k1", "k2", "run"]).combine_chunks().to_batches()[0]
    if held_repeats:
        yield held.select(["k1", "k2", "run"]).combine_chunks().to_batches()[0]


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of starts of each text in order, those that touch as one."""
    for batch in batches:
        runs = batch.column(2)
        row = np.repeat(np.arange(len(runs)), pc.list_value_length(runs).to_numpy())
        packed = runs.flatten().to_numpy()
        order = np.lexsort((packed, row))
        row, packed = row[order], packed[order]
        start = packed >> 32
        end = start + (packed & 0xFFFFFFFF)
        # the furthest end so far within the text
        wide = row * (np.int64(1) << 32)
        furthest = np.maximum.accumulate(end + wide) - wide
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > furthest[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(row)) - 1
        merged = (start[at] << 32) | (furthest[last] - start[at])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=len(runs)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(merged))], ["k1", "k2", "runs"])


def _remover(window: int):
    """Kept text, words and removed words from (text, runs of starts of repeats)."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, marks = batch.column("__rep_text"), batch.column("__rep_at")
            rest = [i for i, c in enumerate(batch.schema.names) if c not in ("__rep_text", "__rep_at")]
            for begin, end in tw.slices(text):
                part, at = text.slice(begin, end - begin), marks.slice(begin, end - begin)
                w = tw.split(part, tw.BLANK)
                n = np.diff(w.first)
                row = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(at), 0).to_numpy())
                run = at.flatten().to_numpy()
                start = w.first[row] + (run >> 32)
                edge = np.zeros(len(w.start) + 1, dtype=np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + (run & 0xFFFFFFFF) - 1 + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                gone = n - np.add.reduceat(np.append(keep, False).astype(np.int64), w.first[:-1]) * (n > 0)
                kept = [None if not g else _joined(w, int(a) + np.flatnonzero(keep[a:b]))
                        for g, a, b in zip(gone.tolist(), w.first[:-1], w.first[1:])]
                cols = [batch.column(i).slice(begin, end - begin) for i in rest]
                yield pa.RecordBatch.from_arrays(
                    [*cols, part, pa.array(kept, pa.string()), pa.array(n), pa.array(gone)],
                    [*[batch.schema.names[i] for i in rest], "__rep_text", "__rep_kept", "__rep_n", "__rep_gone"])

    return remove


def _joined(w: tw.Words, at: np.ndarray) -> str:
    return b" ".join([w.data[a:b].tobytes() for a, b in zip(w.start[at], w.end[at])]).decode()


def _mark(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def repeat_starts(df: DataFrame, text_col: str, window: int) -> DataFrame:
    """(k1, k2, runs): per text, the runs of words at which repeated windows
    start, each as first word * 2^32 + number of words."""
    texts = df.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), *_mark(F.col(text_col)))
    anchors = texts.select("text").mapInArrow(_anchor_counter(window), "key long, n long")
    anchors = anchors.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    bitmap = tw.key_filter(anchors, F.col("key"), FILTER_BITS)

    # 2 * 2^BINS counts, whatever the size of the input
    bins = texts.select("text").mapInArrow(_bin_counter(window, bitmap), "d int, b int, n long")
    common = np.zeros((3, 1 << BINS), dtype=np.int64)
    for r in bins.groupBy("d", "b").agg(F.sum("n").alias("n")).filter(F.col("n") > GROUP).collect():
        common[r.d, r.b] = r.n

    paths = [f"s{i}" for i in range(-(-window // SYMBOL))]
    schema = ", ".join(["depth int", *[f"{p} long" for p in paths], "k1 long, k2 long, run long"])
    rows = texts.mapInArrow(_shipper(window, bitmap, common), schema)
    # the prefix that names the group; runs known to repeat are spread
    spread = F.xxhash64("k1", "depth")
    group = [F.when(F.col("depth") > i, F.col(p)).otherwise(spread if i == 0 else None) for i, p in enumerate(paths)]
    rows = rows.repartition(*group).sortWithinPartitions(*paths).drop("depth")
    deep = rows.mapInArrow(_deep_nodes, "k1 long, k2 long, run long")
    runs = deep.groupBy("k1", "k2").agg(F.collect_set("run").alias("runs"))
    return runs.mapInArrow(_merger, "k1 long, k2 long, runs array<long>")


def remove_repeats(df: DataFrame, text_col: str = "text", window: int = 35) -> DataFrame:
    """``df`` with the words of repeated windows removed from ``text_col``,
    and the counts ``n_words`` and ``n_removed``."""
    util.require(df, text_col)
    if window < 1:
        raise ValueError("a window holds at least one word")
    found = util.cut(repeat_starts(df, text_col, window), "repeat-starts")
    found = found.select(F.col("k1").alias(K1), F.col("k2").alias(K2), F.col("runs").alias(MARKS))
    k1, k2 = _mark(F.col(text_col))
    rows = df.join(found, (k1 == F.col(K1)) & (k2 == F.col(K2)), "left").drop(K1, K2)
    others = [c for c in df.columns if c not in (text_col, "n_words", "n_removed")]
    rows = rows.select(*others, F.col(text_col).cast("string").alias(TEXT), MARKS)
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = ", ".join([*[f"`{c}` {types[c].simpleString()}" for c in others], f"{TEXT} string, __rep_kept string, __rep_n long, __rep_gone long"])
    out = rows.mapInArrow(_remover(window), schema)
    text = F.when(F.col("__rep_gone") > 0, F.col("__rep_kept")).otherwise(F.col(TEXT)).alias(text_col)
    return out.select(
        *[text if c == text_col else F.col(f"`{c}`") for c in df.columns if c not in ("n_words", "n_removed")],
        F.col("__rep_n").alias("n_words"), F.col("__rep_gone").alias("n_removed"))
