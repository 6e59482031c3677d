"""Exact k-nearest-neighbour join and k-NN vote.

No pair of rows is ever materialised.  Query rows are hashed into ``qb``
blocks and base rows into ``bb`` blocks; each query row is copied once per
base block and each base row once per query block, and the two sides are
co-grouped on the block pair.  Inside a group one matrix product scores the
block pair and only the best ``k`` per query leave the task, so the shuffle
after it carries at most ``bb * k`` candidates per query, which a final
window cuts to ``k``.  Block counts are chosen from the row counts so that a
block pair stays within ``block_rows`` rows on each side, and a task compares
``TILE`` x ``TILE`` rows at a time with a running top ``k``.

``knn_candidates`` is the approximate form for large tables: the pairs compared
are those that share a bucket of random projections.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from earlywarn.session import ship_package

OUT_SCHEMA = "q_id long, n_id long, score double, n_label double"


def _as_array(df: DataFrame, col: str):
    dt = df.schema[col].dataType
    if isinstance(dt, ArrayType):
        return F.col(col).cast("array<double>")
    return vector_to_array(F.col(col))


TILE = 2048  # rows of either side compared at a time


def smallest(key: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` smallest keys of each row, in order; ties in column order."""
    if key.shape[1] <= k:
        return np.argsort(key, axis=1, kind="stable")
    bound = np.partition(key, k - 1, axis=1)[:, k - 1 : k]
    within = key <= bound
    tied = within.sum(axis=1) > k
    for r in np.flatnonzero(tied):
        chosen = np.argsort(key[r], kind="stable")[:k]
        within[r] = False
        within[r, chosen] = True
    cols = np.nonzero(within)[1].reshape(len(key), k)
    order = np.argsort(np.take_along_axis(key, cols, 1), axis=1, kind="stable")
    return np.take_along_axis(cols, order, 1)


def _block_topk(k: int, metric: str, digits: int | None, exclude_self: bool):
    """Task function of a block pair: the ``k`` best base rows of every query row."""
    higher = metric == "ip"

    def block_topk(qdf: pd.DataFrame, bdf: pd.DataFrame) -> pd.DataFrame:
        if len(qdf) == 0 or len(bdf) == 0:
            return pd.DataFrame({"q_id": pd.Series(dtype="int64"), "n_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"),
                                 "n_label": pd.Series(dtype="float64")})
        Q = np.stack(qdf["_v"].to_numpy()).astype(np.float64)
        bdf = bdf.sort_values("_id", kind="stable")  # ties go to the smaller id: the earlier column
        B = np.stack(bdf["_v"].to_numpy()).astype(np.float64)
        qids, bids = qdf["_id"].to_numpy(), bdf["_id"].to_numpy()
        blab = bdf["_lab"].to_numpy(dtype=np.float64)
        out = []
        for qs in range(0, len(Q), TILE):  # at most TILE x (TILE + k) scores at a time
            q_, best, at = Q[qs : qs + TILE], None, None
            for bs in range(0, len(B), TILE):
                b_ = B[bs : bs + TILE]
                S = q_ @ b_.T
                if not higher:
                    S = np.sqrt(np.maximum((q_ * q_).sum(1)[:, None] + (b_ * b_).sum(1)[None, :] - 2.0 * S, 0.0))
                if digits is not None:
                    S = np.round(S, digits)
                key = -S if higher else S
                if exclude_self:
                    key = np.where(qids[qs : qs + TILE, None] == bids[None, bs : bs + TILE], np.inf, key)
                col = np.broadcast_to(np.arange(bs, bs + len(b_)), key.shape)
                if best is not None:
                    key, col = np.concatenate([best, key], axis=1), np.concatenate([at, col], axis=1)
                pick = smallest(key, k)
                best, at = np.take_along_axis(key, pick, 1), np.take_along_axis(col, pick, 1)
            row, place = np.nonzero(np.isfinite(best))
            got = at[row, place]
            score = -best[row, place] if higher else best[row, place]
            out.append(pd.DataFrame({"q_id": qids[qs + row], "n_id": bids[got], "score": score + 0.0, "n_label": blab[got]}))
        return pd.concat(out)

    return block_topk


def knn_join(queries: DataFrame, base: DataFrame, k: int, q_id: str, b_id: str, q_vec: str, b_vec: str,
             metric: str = "ip", exclude_self: bool = False, block_rows: int = 20000, digits: int | None = 6,
             b_label: str | None = None) -> DataFrame:
    """(q_id, n_id, rank, score): the ``k`` best base rows per query.

    ``metric='ip'``: inner product, higher first; ``'euclidean'``: distance,
    lower first.  Ties go to the smaller base id.  ``digits`` rounds scores
    before ranking so that engines agree on near ties.  ``b_label`` is carried
    along with each base row (``n_label``), so a vote needs no join back to the
    base table, where a "hub" row that neighbours many queries would be a hot key.
    """
    nq = queries.count()
    nb = base.count()
    qb = max(1, math.ceil(nq / block_rows))
    bb = max(1, math.ceil(nb / block_rows))
    q = queries.select(F.col(q_id).cast("long").alias("_id"), _as_array(queries, q_vec).alias("_v"))
    lab = F.col(b_label).cast("double") if b_label else F.lit(None).cast("double")
    b = base.select(F.col(b_id).cast("long").alias("_id"), _as_array(base, b_vec).alias("_v"), lab.alias("_lab"))
    q = q.withColumn("_qb", F.pmod(F.xxhash64("_id"), F.lit(qb))).select("*", F.explode(F.sequence(F.lit(0), F.lit(bb - 1))).alias("_bb"))
    b = b.withColumn("_bb", F.pmod(F.xxhash64("_id"), F.lit(bb))).select("*", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("_qb"))
    cand = q.groupBy("_qb", "_bb").cogroup(b.groupBy("_qb", "_bb")).applyInPandas(_block_topk(k, metric, digits, exclude_self), OUT_SCHEMA)
    return _ranked(cand, k, metric)


def _ranked(cand: DataFrame, k: int, metric: str) -> DataFrame:
    w = Window.partitionBy("q_id").orderBy(F.col("score").desc() if metric == "ip" else F.col("score").asc(), F.col("n_id"))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


BUCKET_ROWS = 64  # base rows a bucket of random projections holds on average


def _bucket_codes(dim: int, bits: int, tables: int, probes: int, seed: int, centre: np.ndarray):
    """Task function: (_id, _v, _lab, _t, _c) for every table and code of a row.
    The code has the signs of ``bits`` projections of the centred vector; a
    query also visits the buckets across its ``probes`` nearest planes."""
    flips = min(probes, bits)

    def codes(batches):
        planes = np.random.default_rng(seed).normal(size=(tables, dim, bits))
        place = np.int64(1) << np.arange(bits, dtype=np.int64)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            V = np.stack(pdf["_v"].to_numpy()).astype(np.float64) - centre
            for t in range(tables):
                side = V @ planes[t]
                code = (side > 0) @ place
                near = np.argsort(np.abs(side), axis=1, kind="stable")[:, :flips]
                for c in [code] + [code ^ place[near[:, j]] for j in range(flips)]:
                    yield pdf.assign(_t=np.int32(t), _c=c)

    return codes


def knn_candidates(queries: DataFrame, base: DataFrame, k: int, q_id: str, b_id: str, q_vec: str, b_vec: str,
                   metric: str = "ip", exclude_self: bool = False, tables: int = 12, probes: int = 3, bits: int | None = None,
                   seed: int = 42, block_rows: int = 20000, digits: int | None = 6, b_label: str | None = None) -> DataFrame:
    """J9, approximate: as ``knn_join``, but a query meets only the base rows
    that share one of its buckets; scores are exact.

    Each of ``tables`` hash tables cuts the space by ``bits`` random planes
    through the mean of the base (by default as many as leave ``BUCKET_ROWS``
    rows a bucket), and a query visits ``1 + probes`` buckets of a table.  Both
    sides are shuffled on (table, bucket) once per copy, so shuffle and compute
    grow in proportion to the rows.  Equal base vectors count once and carry
    their ``k + 1`` smallest ids, so a hot vector is no hot bucket; a bucket
    above ``block_rows`` rows is split into chunks and its queries visit all.
    More tables or probes, or fewer bits, raise the recall.  Rows with a null
    id or vector take no part; an empty side gives an empty result.
    """
    ship_package(queries.sparkSession)
    q = queries.select(F.col(q_id).cast("long").alias("_id"), _as_array(queries, q_vec).alias("_v"), F.lit(None).cast("double").alias("_lab"))
    lab = F.col(b_label).cast("double") if b_label else F.lit(None).cast("double")
    b = base.select(F.col(b_id).cast("long").alias("_id"), _as_array(base, b_vec).alias("_v"), lab.alias("_lab"))
    usable = F.col("_id").isNotNull() & F.col("_v").isNotNull()
    q, b = q.filter(usable), b.filter(usable)
    at = F.posexplode("_v").alias("i", "x")
    means = b.select(at).groupBy("i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()  # one row a dimension
    if not means:
        return _empty(base)
    centre = np.array([r.m for r in means])
    bits = bits if bits is not None else max(1, math.ceil(math.log2(max(2, means[0].n / BUCKET_ROWS))))

    # the k + 1 smallest ids of equal vectors: the tie rule never needs another (one may be the query itself)
    mark = F.struct(F.xxhash64("_v").alias("m1"), F.xxhash64(F.lit(1), "_v").alias("m2"))
    b = _smallest_ids(b.withColumn("_mark", mark), k + 1)

    side = "_id long, _v array<double>, _lab double, _t int, _c long"
    origin = np.zeros(len(centre)) if metric == "ip" else centre  # a shift of the base moves all products of a query alike
    q = q.mapInPandas(_bucket_codes(len(centre), bits, tables, probes, seed, origin), side)
    b = b.mapInPandas(_bucket_codes(len(centre), bits, tables, 0, seed, centre), side)
    key = ["_t", "_c"]
    chunks = [x.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias(n)).filter(F.col(n) > 1)
              for x, n in ((q, "_nq"), (b, "_nb"))]  # buckets above a block only
    heavy = chunks[0].join(chunks[1], key, "full_outer")

    def dealt(x: DataFrame, mine: str, others: str, own: str, other: str) -> DataFrame:
        x = x.join(heavy, key, "left").fillna(1, subset=["_nq", "_nb"])
        x = x.withColumn(mine, F.pmod(F.xxhash64("_id"), F.col(own)).cast("int"))
        return x.withColumn(others, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_nq", "_nb")

    keys = [*key, "_qc", "_bc"]
    q, b = dealt(q, "_qc", "_bc", "_nq", "_nb"), dealt(b, "_bc", "_qc", "_nb", "_nq")
    found = q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(_block_topk(k, metric, digits, exclude_self), OUT_SCHEMA)
    # a pair that meets in several buckets has one score
    pairs = found.groupBy("q_id", "n_id").agg(F.max("score").alias("score"), F.max("n_label").alias("n_label"))
    return _ranked(pairs, k, metric)


def _empty(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], OUT_SCHEMA + ", rank int")


def _smallest_ids(b: DataFrame, n: int) -> DataFrame:
    """Of the rows of one ``_mark`` those with the ``n`` smallest ids.  Ranked
    within 64 parts of a mark first, so a mark of very many rows is never in one task."""
    part = Window.partitionBy("_mark", F.pmod(F.xxhash64("_id"), F.lit(64))).orderBy("_id")
    whole = Window.partitionBy("_mark").orderBy("_id")
    for w in (part, whole):
        b = b.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    return b.drop("_mark")


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5, weights: str = "uniform", key: str = "row_id",
                 features: str = "features", label: str = "target", join=knn_join) -> DataFrame:
    """(key, y_prob, y_pred) by the vote of the ``k`` nearest training rows (Euclidean);
    ``join=knn_candidates`` takes the approximate neighbours.

    'distance' weights each neighbour by 1/d; neighbours at distance 0, if
    any, vote alone.  The predicted class is 1 when its share is above 0.5.
    """
    nn = join(test, train, k, key, key, features, features, metric="euclidean", digits=None, b_label=label)
    j = nn.withColumnRenamed("n_label", "_y")
    if weights == "distance":
        zero = F.max((F.col("score") == 0).cast("int")).over(Window.partitionBy("q_id"))
        wcol = F.when(zero == 1, (F.col("score") == 0).cast("double")).otherwise(F.lit(1.0) / F.col("score"))
    else:
        wcol = F.lit(1.0)
    j = j.withColumn("_w", wcol)
    p = j.groupBy("q_id").agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("y_prob"))
    return p.select(F.col("q_id").alias(key), "y_prob", (F.col("y_prob") > 0.5).cast("int").alias("y_pred"))
