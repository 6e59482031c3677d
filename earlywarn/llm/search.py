"""Ranked lexical search by presence masks.

The items are read in blocks of bounded size.  For every block:

1. One pass over all texts counts documents, terms and, for the terms of the
   block's items only, document frequencies.
2. A second pass takes the documents of a task slice by slice.  Bitmaps of the
   item's terms are turned into one presence mask per document; documents of
   the same mask form a group, whose scores are bounded by the sum over its
   terms of the greatest contribution in the slice.  Groups are evaluated by
   descending bound until the bound is below the lowest score the task keeps,
   so ties are always evaluated.
3. Each task keeps its highest ``k`` an item; a window merges them, first
   within groups of tasks, then over all.

Defined results: null and empty texts hold no term and are never ranked; rows
of equal score are ordered by id, null ids last, and a row listed twice is
ranked twice; a repeated item is ranked once for every row; an item without
terms has no rows; empty tables give an empty result; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.llm import textwords as tw
from earlywarn.llm import util

TERM = tw.byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
ITEM_BYTES = 1 << 20  # text of the items of one block (one item at least)
CHUNK = 256  # documents evaluated between two looks at the bound
MERGERS = 64  # groups of tasks merged first
ROWS = "q int, doc_id long, score long"


def _item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Rows (item id, text) in blocks of at most ``ITEM_BYTES`` of text."""
    block, size = [], 0
    for r in items.toLocalIterator():
        more = len((r[1] or "").encode())
        if block and size + more > ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += more
    if block:
        yield block


def _term_ids(texts: pa.Array, vocab: pa.Array) -> tuple[tw.Words, np.ndarray]:
    """The terms of texts, and each one's place in ``vocab`` (-1: none)."""
    w = tw.split(texts, ~TERM, lower=True)
    return w, pc.fill_null(pc.index_in(w.array(), value_set=vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _distinct(doc: np.ndarray, term: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc * terms + term, count) of the terms that are known, ascending."""
    known = term >= 0
    return np.unique(doc[known] * terms + term[known], return_counts=True)


def _counter(vocab: pa.Array):
    """(term, documents), with -1 for documents that hold any term and -2 for all terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocab), dtype=np.int64)
        docs = terms = 0
        for batch in batches:
            text = batch.column(0)
            for begin, end in tw.slices(text):
                w, term = _term_ids(text.slice(begin, end - begin), vocab)
                docs += int((np.diff(w.first) > 0).sum())
                terms += len(w.start)
                code, _ = _distinct(w.doc, term, len(vocab))
                df += np.bincount(code % max(1, len(vocab)), minlength=len(vocab))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1, -2], at]).astype(np.int32)),
             pa.array(np.concatenate([[docs, terms], df[at]]).astype(np.int64))], ["t", "n"])

    return count


class _Best:
    """The highest ``k`` (score, id) of an item: highest score, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.zeros(0, dtype=np.int64)
        self.id = np.zeros(0, dtype=np.int64)
        self.nameless = np.zeros(0, dtype=bool)

    def floor(self) -> int:
        """A score below this one cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, id_: np.ndarray, nameless: np.ndarray) -> None:
        score, id_ = np.concatenate([self.score, score]), np.concatenate([self.id, id_])
        nameless = np.concatenate([self.nameless, nameless])
        at = np.lexsort((id_, nameless, -score))[: self.k]
        self.score, self.id, self.nameless = score[at], id_[at], nameless[at]


def _masks(code: np.ndarray, place: np.ndarray, docs: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct presence masks as rows of bits, and the mask of each document
    that holds a term.  ``place``: each posting's term among the item's."""
    bitmaps = np.zeros((terms, docs), dtype=bool)
    bitmaps[place, code] = True
    packed = np.ascontiguousarray(np.packbits(bitmaps, axis=0).T)
    held = np.flatnonzero(packed.any(axis=1))
    wide = np.zeros((len(held), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : packed.shape[1]] = packed[held]
    mask = wide.view(np.uint64)
    mask = mask[:, 0] if mask.shape[1] == 1 else wide.view(np.dtype((np.void, wide.shape[1])))[:, 0]
    _, one, of = np.unique(mask, return_index=True, return_inverse=True)
    return np.unpackbits(wide[one], axis=1)[:, :terms], held, of


def _searcher(vocab: pa.Array, item_terms: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in item_terms]
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            nameless = pc.is_null(ids).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(ids, 0).to_numpy()
            for begin, end in tw.slices(text):
                w, term = _term_ids(text.slice(begin, end - begin), vocab)
                code, tf = _distinct(w.doc, term, len(vocab))
                doc, term = code // max(1, len(vocab)), code % max(1, len(vocab))
                # whole numbers of any size: 50 * n * N may pass 64 bits
                m = np.array([50 + 50 * n * n_docs // n_terms for n in np.diff(w.first).tolist()], dtype=np.int64)
                share = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                order = np.argsort(term, kind="stable")
                bounds = np.searchsorted(term[order], np.arange(len(vocab) + 1))
                by_term, share_by_term = doc[order], share[order]
                for top, terms in zip(best, item_terms):
                    spans = [slice(bounds[t], bounds[t + 1]) for t in terms]
                    docs_of = np.concatenate([by_term[s] for s in spans]) if spans else by_term[:0]
                    if not len(docs_of):
                        continue
                    shares = np.concatenate([share_by_term[s] for s in spans])
                    sizes = [s.stop - s.start for s in spans]
                    most = np.array([share_by_term[s].max() if n else 0 for s, n in zip(spans, sizes)], dtype=np.int64)
                    place = np.repeat(np.arange(len(terms)), sizes)
                    bits, held, of = _masks(docs_of, place, end - begin, len(terms))
                    bound = bits.astype(np.int64) @ most
                    if bound.max(initial=0) < top.floor():
                        continue
                    go = np.argsort(-bound, kind="stable")
                    rank = np.empty_like(go)
                    rank[go] = np.arange(len(go))
                    held = held[np.argsort(rank[of], kind="stable")]
                    upper = np.sort(bound[of])[::-1]
                    score = None
                    for i in range(0, len(held), CHUNK):
                        if upper[i] < top.floor():
                            break
                        if score is None:
                            score = np.zeros(end - begin, dtype=np.int64)
                            np.add.at(score, docs_of, shares)
                        some = held[i : i + CHUNK]
                        some = some[score[some] >= top.floor()]
                        top.add(score[some], ids[begin:end][some], nameless[begin:end][some])
        for q, top in enumerate(best):
            if len(top.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top.score), q, dtype=np.int32)), pa.array(top.id, mask=top.nameless),
                     pa.array(top.score)], ["q", "doc_id", "score"])

    return search


def rank_documents(items: DataFrame, docs: DataFrame, k: int = 50, item_col: str = "item_id", item_text: str = "text",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's ``k`` highest documents."""
    util.require(items, item_col, item_text)
    util.require(docs, id_col, text_col)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    id_type = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for block in _item_blocks(items.select(item_col, item_text)):
        w = tw.split(pa.array([t for _, t in block], pa.string()), ~TERM, lower=True)
        coded = pc.dictionary_encode(w.array())
        vocab, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        item_terms = [np.unique(code[a:b]) for a, b in zip(w.first[:-1], w.first[1:])]
        counts = rows.select("text").mapInArrow(_counter(vocab), "t int, n long").groupBy("t").agg(F.sum("n").alias("n"))
        found = {r.t: r.n for r in counts.collect()}  # the block's terms at most
        n_docs, n_terms = found.get(-1, 0), found.get(-2, 0)
        if not n_docs:
            continue
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(vocab))],
                          dtype=np.int64)
        best = rows.mapInArrow(_searcher(vocab, item_terms, weight, n_docs, n_terms, k), ROWS)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        best = best.withColumn("g", F.spark_partition_id() % MERGERS)
        for by in (["q", "g"], ["q"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"q int, item_id {id_type}")
        best = best.join(F.broadcast(names), "q")  # at most the rows of one block
        out = out.unionByName(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
