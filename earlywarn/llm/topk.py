"""Exact top-k by inner product over vectors sorted by length.

Vectors lie in blocks of descending length.  Both sides are rotated into the
principal axes of all vectors (eigenvectors of the summed outer products,
the right singular vectors of the table), so a few leading coordinates carry
most of an inner product.  Within a block vectors come in runs, longest
first: a query leaves as soon as its length times the run's greatest length
is below its k-th best score; of the other pairs the partial sum over the
leading coordinates plus the product of the residual lengths (Cauchy-Schwarz)
must reach that score; only then the whole product is computed, exactly, in
whole numbers.  The block of the longest vectors is searched first, and its
k-th best scores start the pruning in all others.

Defined results: components become floor(scale * x); null vectors and those
with null or non-finite components take no part, nor do null ids; a query's
own row is every row of its id; a query id on several rows is searched once,
by its smallest vector; other repeated rows are candidates one by one;
shorter vectors count as padded with zeros; fewer candidates than k give all;
scores beyond a long saturate; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import util
from earlywarn.llm.vectors import dense, query_blocks, ranked, search_blocks, vectors

BLOCK_ROWS = 16384
RUN = 512  # vectors compared at a time
LEADING = 4  # a quarter of the coordinates form the partial sum
FOUND = "query_id long, vec_id long, score long"


def whole_numbers(matrix, scale: int):
    import numpy as np

    return np.floor(matrix * scale)


def gram(rows: DataFrame, width: int, scale: int):
    """Sum of the outer products of all vectors: width * width numbers."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = whole_numbers(dense(b.column(0), width), scale)
            total += m.T @ m
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "g"])

    out = np.zeros((width, width))
    for r in rows.select("vec").mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        out[r.i, r.j] = r.g
    return out


def exact_scores(a, b):
    """Inner products (rows of a x rows of b) of whole numbers, as int64."""
    import numpy as np

    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)  # no sum leaves the whole numbers of a double
    big = lambda m: np.vectorize(int, otypes=[object])(m)
    return np.clip(big(a) @ big(b).T, -(2**63), 2**63 - 1).astype(np.int64)


def search(qid, q, q_floor, vid, v, rotation, k: int):
    """Best k (query, vector, score) of each query; vectors by descending length."""
    import numpy as np

    lead = max(1, q.shape[1] // LEADING)
    qr, vr = q @ rotation, v @ rotation
    qn, vn = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    qres = np.linalg.norm(qr[:, lead:], axis=1)
    vres = np.linalg.norm(vr[:, lead:], axis=1)
    floor = q_floor.astype(np.int64)  # k-th best score so far
    keep = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for at in range(0, len(v), RUN):
        run = slice(at, at + RUN)
        slack = 1e-9 * qn * vn[run].max() + 1e-6  # rounding of the bounds
        active = np.flatnonzero(qn * vn[run].max() + slack >= floor)
        if not len(active):
            break  # later vectors are no longer
        bound = qr[active, :lead] @ vr[run, :lead].T + np.outer(qres[active], vres[run])
        near = bound + slack[active, None] >= floor[active, None]
        near &= qid[active, None] != vid[None, run]
        cols = np.flatnonzero(near.any(axis=0))
        if not len(cols):
            continue
        scores = exact_scores(q[active], v[run][cols])
        row, col = np.nonzero(near[:, cols] & (scores >= floor[active, None]))
        got = (active[row], vid[run][cols][col], scores[row, col])
        qi, vi, sc = (np.concatenate(x) for x in zip(keep, got))
        order = np.lexsort((vi, -sc, qi))
        qi, vi, sc = qi[order], vi[order], sc[order]
        begin = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
        place = np.arange(len(qi)) - np.repeat(begin, np.diff(np.r_[begin, len(qi)]))
        keep = (qi[place < k], vi[place < k], sc[place < k])
        last = place == k - 1
        floor[qi[last]] = np.maximum(floor[qi[last]], sc[last])
    return qid[keep[0]], keep[1], keep[2]


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest inner products.

    ``is_query`` is a condition on ``id``, the column ``id_col`` as a long.
    """
    import numpy as np

    rows = util.cut(vectors(df, id_col, vec_col), "topk-vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    queries = rows.filter(is_query)
    nq = queries.count()
    if not facts.n or not nq:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = facts.width
    axes = np.linalg.eigh(gram(rows, width, scale))[1][:, ::-1].copy()  # widest first

    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * scale).cast("double"), F.lit(2.0)))
    blocks = -(-facts.n // BLOCK_ROWS)
    # partitions of a range partitioning are numbered along the order: a block each
    sorted_ = rows.withColumn("len", length).repartitionByRange(blocks, F.desc("len"), "id")
    base = util.cut(sorted_.select(F.spark_partition_id().alias("block"), "id", "vec"), "topk-blocks")
    blocks = base.agg(F.max("block")).first()[0] + 1
    queries, qbs = query_blocks(queries, nq)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        names_ = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names_)
        q = whole_numbers(dense(left["vec"], width), scale)
        v = whole_numbers(dense(right["vec"], width), scale)
        vid = right["id"].to_numpy()
        order = np.lexsort((vid, -np.linalg.norm(v, axis=1)))
        found = search(left["id"].to_numpy(), q, left["floor"].to_numpy(), vid[order], v[order], axes, k)
        return pa.table([pa.array(x, pa.int64()) for x in found], names_)

    nothing = F.lit(-(2**63)).cast("long")
    start = search_blocks(queries.withColumn("floor", nothing), qbs, base.filter("block = 0"), 1, task, FOUND)
    start = util.cut(start, "topk-start")
    if blocks == 1:
        return ranked(start, k)
    kth = ranked(start, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    seeded = queries.join(kth, "id", "left").withColumn("floor", F.coalesce("kth", nothing)).drop("kth")
    others = base.filter("block > 0").withColumn("block", F.col("block") - 1)
    return ranked(start.union(search_blocks(seeded, qbs, others, blocks - 1, task, FOUND)), k)
