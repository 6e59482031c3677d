"""Approximate nearest neighbours by vantage-point trees, one per shard.

A shard's vectors are parted into bands of similar length, each with a tree.
In a band, vectors get one more coordinate that brings all of them to the
band's greatest length, and a query is scaled to that length, so the largest
inner product with a query is the smallest Euclidean distance, and the
triangle inequality holds.  Distances then are those of directions, whatever
the lengths in other bands, and ``factor`` means the same in each band.  A
band is left out for a query whose k-th product so far exceeds the product
of both lengths (exact).  A node of a tree keeps a vantage point and, of each half of its points, the least and greatest
distance to it; leaves hold up to ``LEAF`` points.  A query first goes down
to the leaf nearest by the vantage distances, which bounds its k-th nearest
distance; then it walks the tree and leaves out a half when ``factor`` times
the half's triangle-inequality bound exceeds the k-th distance so far.
``factor`` one is exact; a larger one skips more.

The index, one row per shard, is a written table: it is built once and met
by every block of queries.  Every usable row is in it.

Defined results: null and zero vectors and those with null or non-finite
components take no part, nor do null ids; a query's own row is every row of
its id; a query id on several rows is searched once, by its smallest vector;
other repeated rows are candidates one by one; shorter vectors count as
padded with zeros; ties go to the smaller id; fewer candidates than k give
all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import util
from earlywarn.llm.vectors import dense, query_blocks, ranked, search_blocks, vectors

SHARD_ROWS = 16384
LEAF = 128
BAND = 1.1  # greatest ratio of two lengths in a band
FACTOR = 2.5
FOUND = "query_id long, vec_id long, score double"


def build_tree(ids, points, seed: int = 7) -> dict:
    """Arrays of a vantage-point tree over ``points`` (rows)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    order = np.arange(len(points))
    nodes: list[tuple] = []  # begin, end, inside node, outside node
    bounds: list[tuple] = []  # least and greatest distance of the inside, of the outside
    vantage: list[int] = []

    def grow(begin: int, end: int) -> int:
        me = len(nodes)
        nodes.append((begin, end, -1, -1))
        bounds.append((0.0, 0.0, 0.0, 0.0))
        vantage.append(-1)
        if end - begin <= LEAF:
            return me
        at = order[begin:end]
        v = int(at[rng.integers(len(at))])
        d = np.linalg.norm(points[at] - points[v], axis=1)
        by = np.argsort(d, kind="stable")
        order[begin:end] = at[by]
        d = d[by]
        half = len(d) // 2
        vantage[me] = v
        bounds[me] = (d[0], d[half - 1], d[half], d[-1])
        inside = grow(begin, begin + half)
        outside = grow(begin + half, end)
        nodes[me] = (begin, end, inside, outside)
        return me

    if len(points):
        grow(0, len(points))
    points_at = points[np.array(vantage, dtype=np.int64)] if nodes else points
    return {
        "ids": ids[order], "points": points[order], "nodes": np.array(nodes, dtype=np.int64).reshape(-1, 4),
        "bounds": np.array(bounds).reshape(-1, 4), "vantage": points_at,
    }


class TreeSearch:
    """Searches a block of queries, all of them together, node by node."""

    def __init__(self, tree: dict, qid, queries, k: int, factor: float):
        import numpy as np

        self.t, self.qid, self.q, self.k, self.factor = tree, qid, queries, k, factor
        self.slack = 1e-9 * float(tree.get("longest", 1.0))  # for rounding
        self.best = np.full((len(queries), k), np.inf)  # distances, nearest first
        self.who = np.full((len(queries), k), -1, dtype=np.int64)  # rows of the tree
        self.first = np.full(len(queries), -1, dtype=np.int64)

    def run(self) -> None:
        import numpy as np

        if not len(self.t["nodes"]):
            return
        everyone = np.arange(len(self.q))
        self.down(0, everyone)
        self.walk(0, everyone)

    def distance(self, node: int, who):
        import numpy as np

        return np.linalg.norm(self.q[who] - self.t["vantage"][node], axis=1)

    def down(self, node: int, who) -> None:
        begin, end, inside, outside = self.t["nodes"][node]
        if inside < 0:
            self.first[who] = node
            self.leaf(begin, end, who)
            return
        _, hi, lo, _ = self.t["bounds"][node]
        near = self.distance(node, who) <= (hi + lo) / 2
        for child, part in ((inside, who[near]), (outside, who[~near])):
            if len(part):
                self.down(child, part)

    def walk(self, node: int, who) -> None:
        import numpy as np

        begin, end, inside, outside = self.t["nodes"][node]
        if inside < 0:
            who = who[self.first[who] != node]
            if len(who):
                self.leaf(begin, end, who)
            return
        in_lo, in_hi, out_lo, out_hi = self.t["bounds"][node]
        d = self.distance(node, who)
        for child, lo, hi in ((inside, in_lo, in_hi), (outside, out_lo, out_hi)):
            bound = np.maximum(0, np.maximum(lo - d, d - hi))
            go = who[self.factor * bound <= self.best[who, -1] + self.slack]
            if len(go):
                self.walk(child, go)

    def leaf(self, begin: int, end: int, who) -> None:
        import numpy as np

        x, ids = self.t["points"][begin:end], self.t["ids"][begin:end]
        square = (x * x).sum(1)[None, :] + (self.q[who] ** 2).sum(1)[:, None] - 2 * self.q[who] @ x.T
        d = np.sqrt(np.maximum(square, 0))
        d[self.qid[who][:, None] == ids[None, :]] = np.inf
        some = (d <= self.best[who, -1][:, None]).any(axis=1)
        who, d = who[some], d[some]
        if not len(who):
            return
        dist = np.concatenate([self.best[who], d], axis=1)
        rows = np.concatenate([self.who[who], np.broadcast_to(np.arange(begin, end), d.shape)], axis=1)
        names = np.where(rows >= 0, self.t["ids"][rows], np.iinfo(np.int64).max)
        order = np.lexsort((names, dist), axis=1)[:, : self.k]
        self.best[who] = np.take_along_axis(dist, order, axis=1)
        self.who[who] = np.take_along_axis(rows, order, axis=1)


def build_trees(ids, m) -> list[dict]:
    """A tree per band of lengths, the longest first."""
    import numpy as np

    length = np.linalg.norm(m, axis=1)
    order = np.argsort(-length, kind="stable")
    trees, at = [], 0
    while at < len(order):
        longest = length[order[at]]
        to = max(at + 1, int(np.searchsorted(-length[order], -longest / BAND, side="right")))
        rows = np.sort(order[at:to])
        rest = np.sqrt(np.maximum(0, longest**2 - length[rows] ** 2))
        tree = build_tree(ids[rows], np.concatenate([m[rows], rest[:, None]], axis=1))
        trees.append(tree | {"longest": np.array(longest)})
        at = to
    return trees


def search_trees(trees: list[dict], qid, queries, k: int, factor: float):
    """Scores and ids (queries x k) of the best rows found, best first; the
    score of a missing row is minus infinity."""
    import numpy as np

    length = np.linalg.norm(queries, axis=1)
    score = np.full((len(queries), k), -np.inf)
    who = np.full((len(queries), k), np.iinfo(np.int64).max)
    for tree in trees:
        longest = float(tree["longest"])
        go = np.flatnonzero(score[:, -1] <= length * longest * (1 + 1e-9))
        if not len(go):
            continue
        q = queries[go]
        scaled = np.concatenate([q * (longest / length[go])[:, None], np.zeros((len(go), 1))], axis=1)
        found = TreeSearch(tree, qid[go], scaled, k, factor)
        found.run()
        row, col = np.nonzero(np.isfinite(found.best) & (found.who >= 0))
        at = found.who[row, col]
        new, names = np.full((len(go), k), -np.inf), np.full((len(go), k), np.iinfo(np.int64).max)
        new[row, col] = np.einsum("ij,ij->i", q[row], tree["points"][at, :-1])
        names[row, col] = tree["ids"][at]
        new, names = np.concatenate([score[go], new], axis=1), np.concatenate([who[go], names], axis=1)
        best = np.lexsort((names, -new), axis=1)[:, :k]
        score[go], who[go] = np.take_along_axis(new, best, axis=1), np.take_along_axis(names, best, axis=1)
    return score, who


def packed(trees: list[dict]) -> bytes:
    import numpy as np

    out = io.BytesIO()
    np.savez(out, **{f"{i}.{name}": x for i, tree in enumerate(trees) for name, x in tree.items()})
    return out.getvalue()


def unpacked(data: bytes) -> list[dict]:
    import numpy as np

    trees: dict[int, dict] = {}
    with np.load(io.BytesIO(data)) as arrays:
        for name in arrays.files:
            i, part = name.split(".")
            trees.setdefault(int(i), {})[part] = arrays[name]
    return [trees[i] for i in sorted(trees)]


def build_index(rows: DataFrame, n: int, width: int) -> tuple[DataFrame, int]:
    """One row per shard: ``block`` and the trees as bytes."""
    shards = max(1, -(-n // SHARD_ROWS))

    def grow(table: pa.Table) -> pa.Table:
        import numpy as np

        m, ids = dense(table["vec"], width), table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")  # the tree depends on the rows only, not on their order
        m, ids = m[order], ids[order]
        return pa.table([table["block"].slice(0, 1), pa.array([packed(build_trees(ids, m))], pa.binary())], ["block", "tree"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(shards)).cast("int"))
    return util.cut(dealt.groupBy("block").applyInArrow(grow, "block int, tree binary"), "ann-index"), shards


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    factor: float = FACTOR,
) -> DataFrame:
    """query_id, rank, vec_id, score (inner product) of each query's k nearest found.

    ``is_query`` is a condition on ``id``, the column ``id_col`` as a long.
    """
    rows = vectors(df, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0))
    rows = util.cut(rows, "ann-vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    queries = rows.filter(is_query)
    nq = queries.count()
    if not facts.n or not nq:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = facts.width
    index, shards = build_index(rows, facts.n, width)
    queries, qbs = query_blocks(queries, nq)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        q, qid = dense(left["vec"], width), left["id"].to_numpy()
        score, who = search_trees(unpacked(right["tree"][0].as_py()), qid, q, k, factor)
        row, col = np.nonzero(np.isfinite(score))
        return pa.table([pa.array(qid[row]), pa.array(who[row, col]), pa.array(score[row, col])], names)

    return ranked(search_blocks(queries, qbs, index, shards, task, FOUND), k)
