"""Exact contributions of a tree ensemble's margin (E1, boosting).

The value that a set S of features has for a row x is the mean margin over the
background rows z when the features in S are taken from x and the others from
z.  A leaf is reached by such a mixture exactly if every feature on its path
meets the path's conditions with the value it got.  So for one leaf and one
pair (x, z) only this counts: which path features x meets and which z meets.
Features that both meet are free; one that neither meets makes the leaf
unreachable; with a features met by x alone and b by z alone the Shapley value
of the leaf value v is v (a-1)! b! / (a+b)! for each of the former and
-v a! (b-1)! / (a+b)! for each of the latter.

Hence the background enters only by the number of its rows per (leaf, set of
met features): one aggregation over any number of rows, whose result is
bounded by the model (2^features on a path, for each leaf) and not by the
data.  Rows and background rows are never paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.operators.prep import feature_names
from earlywarn.session import scratch_path, ship_package

NODE_SCHEMA = ("tree int, weight double, node int, feature int, threshold double, left_categories array<double>, "
               "left int, right int, value double, cover long, gain double")
TABLED = 12  # features on a path up to which a leaf's sets are looked up by number
LOG_ODDS = 2.0  # Spark's boosting fits F for the loss log(1 + exp(-2 y F)): the log-odds are 2 F


def node_table(model) -> DataFrame:
    """The nodes of a fitted boosting model, one row a node (``NODE_SCHEMA``).

    ``feature`` is null at a leaf; a numeric split sends values up to
    ``threshold`` to the left, a categorical one those in ``left_categories``.
    Weights carry the factor from Spark's margin to log-odds.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "boosted-nodes")
    model.write().overwrite().save(path)
    weights = F.array(*[F.lit(LOG_ODDS * float(w)) for w in model.treeWeights])
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    numeric = n["split"]["numCategories"] < 0
    side = n["split"]["leftCategoriesOrThreshold"]
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.element_at(weights, F.col("treeID") + 1).alias("weight"), n["id"].alias("node"),
        F.when(inner, n["split"]["featureIndex"]).alias("feature"),
        F.when(inner & numeric, F.get(side, F.lit(0))).alias("threshold"),
        F.when(inner & ~numeric, side).alias("left_categories"),
        F.when(inner, n["leftChild"]).alias("left"), F.when(inner, n["rightChild"]).alias("right"),
        n["prediction"].alias("value"), n["rawCount"].alias("cover"), F.when(inner, n["gain"]).alias("gain"))


@dataclass
class Leaf:
    """A leaf: its weighted value, the features on its path, and for each of
    them the (split, side) pairs that a row must meet."""

    value: float
    features: list[int]
    steps: list[list[tuple[int, bool]]]


@dataclass
class Paths:
    splits: list[tuple[int, float | None, list[float] | None]]
    leaves: list[Leaf]


def leaf_paths(nodes: DataFrame) -> Paths:
    """All root-to-leaf paths of the node table (bounded by the model)."""
    rows = {(r["tree"], r["node"]): r for r in nodes.collect()}
    children = {(t, c) for (t, _), r in rows.items() if r["feature"] is not None for c in (r["left"], r["right"])}
    splits, leaves = [], []
    todo = [(key, []) for key in sorted(rows) if key not in children]
    while todo:
        (tree, node), path = todo.pop()
        r = rows[tree, node]
        if r["feature"] is not None:
            splits.append((r["feature"], r["threshold"], r["left_categories"]))
            for child, left in ((r["right"], False), (r["left"], True)):
                todo.append(((tree, child), [*path, (len(splits) - 1, left)]))
            continue
        met: dict[int, list[tuple[int, bool]]] = {}
        for split, left in path:
            met.setdefault(splits[split][0], []).append((split, left))
        leaves.append(Leaf(r["weight"] * r["value"], list(met), list(met.values())))
    return Paths(splits, leaves)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of doubles, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # a null element becomes NaN
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _met(paths: Paths, x: np.ndarray) -> Iterator[np.ndarray]:
    """Per leaf the set of path features that each row meets, as bits."""
    goes_left = []
    for feature, threshold, categories in paths.splits:
        v = x[:, feature]
        goes_left.append(np.isin(v, categories) if threshold is None else v <= threshold)  # NaN goes right
    for leaf in paths.leaves:
        bits = np.zeros(len(x), dtype=np.int64)
        for i, steps in enumerate(leaf.steps):
            ok = np.ones(len(x), dtype=bool)
            for split, left in steps:
                ok &= goes_left[split] if left else ~goes_left[split]
            bits |= ok.astype(np.int64) << i
        yield bits


def _counter(paths: Paths):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for i, bits in enumerate(_met(paths, _matrix(batch.column(0)))):
                for b, c in zip(*np.unique(bits, return_counts=True)):
                    seen[i, int(b)] = seen.get((i, int(b)), 0) + int(c)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(seen.values()), pa.int64())],
            ["leaf", "bits", "n"])
    return count


def _shares(leaf: Leaf, x: int, z: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf's features for a row that meets the set ``x``;
    the background meets the sets ``z`` with probabilities ``p``."""
    k = len(leaf.features)
    full = (1 << k) - 1
    live = (x | z) == full
    z, p = z[live], p[live]
    a, b = np.bitwise_count(x & ~z & full).astype(int), np.bitwise_count(z & ~x & full).astype(int)
    fact = np.array([math.factorial(i) for i in range(k + 1)], dtype=np.float64)
    out = np.zeros(k)
    for i in range(k):
        mine, theirs = bool(x >> i & 1), (z >> i & 1).astype(bool)
        if mine:
            s = ~theirs
            out[i] = (p[s] * fact[a[s] - 1] * fact[b[s]] / fact[a[s] + b[s]]).sum()
        else:
            out[i] = -(p * fact[a] * fact[b - 1] / fact[a + b]).sum()  # live, so the background meets it
    return leaf.value * out


def _explainer(paths: Paths, background: list[tuple[np.ndarray, np.ndarray]], base: float):
    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}  # one entry a leaf and set of met features
        for batch in batches:
            x = _matrix(batch.column(1))
            phi = np.zeros(x.shape[::-1])
            margin = np.zeros(len(x))
            for i, bits in enumerate(_met(paths, x) if len(x) else ()):
                leaf = paths.leaves[i]
                margin += leaf.value * (bits == (1 << len(leaf.features)) - 1)
                if not leaf.features:
                    continue
                if len(leaf.features) <= TABLED:  # one place for each set of met features
                    sets, which = np.flatnonzero(np.bincount(bits)), bits
                    shares = np.zeros((sets[-1] + 1, len(leaf.features)))
                    at = sets
                else:
                    sets, which = np.unique(bits, return_inverse=True)
                    shares = np.zeros((len(sets), len(leaf.features)))
                    at = np.arange(len(sets))
                for place, s in zip(at.tolist(), sets.tolist()):
                    if (i, s) not in known:
                        known[i, s] = _shares(leaf, s, *background[i])
                    shares[place] = known[i, s]
                for f, share in zip(leaf.features, shares.T):
                    phi[f] += share.take(which)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(phi.T.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.full(len(x), base)), pa.array(margin), lists],
                ["key", "x", "base", "margin", "phi"])
    return explain


def tree_contributions(df: DataFrame, background: DataFrame, nodes: DataFrame, features: Column, names: Sequence[str] | DataFrame,
                       key: str = "row_id") -> DataFrame:
    """(key, base, margin, position, feature, value, phi): exact interventional
    Shapley values of the ensemble of ``nodes`` for every row of ``df``.

    ``features`` is the array-of-doubles column that the splits index, found in
    both tables; ``names`` lists its features (or holds ``position``, from 0,
    and ``feature``).  ``base`` is the background's mean margin and
    base + sum(phi) = margin for each row.  A missing value goes to the right
    of a numeric split.  A null key is kept.  The background may have any
    number of rows but must have one: the counting job runs when this is called.
    """
    spark = df.sparkSession
    ship_package(spark)
    paths = leaf_paths(nodes)
    if not paths.leaves:
        raise ValueError("the node table is empty: there is no model to explain")
    counts = background.select(features.alias("x")).mapInArrow(_counter(paths), "leaf int, bits long, n long")
    seen: list[list[tuple[int, int]]] = [[] for _ in paths.leaves]
    for r in counts.groupBy("leaf", "bits").agg(F.sum("n").alias("n")).collect():  # bounded by the model
        seen[r["leaf"]].append((r["bits"], r["n"]))
    n = sum(c for _, c in seen[0])
    if not n:
        raise ValueError("the background has no rows")
    sets = [(np.array([b for b, _ in s], dtype=np.int64), np.array([c for _, c in s], dtype=np.float64) / n) for s in map(sorted, seen)]
    base = sum(leaf.value * float(p[z == (1 << len(leaf.features)) - 1].sum()) for leaf, (z, p) in zip(paths.leaves, sets))
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), features.alias("x")).mapInArrow(
        _explainer(paths, sets, base), f"key {key_type}, x array<double>, base double, margin double, phi array<double>")
    long = rows.select("key", "base", "margin", F.posexplode(F.arrays_zip("x", "phi")).alias("position", "c"))
    out = long.select(F.col("key").alias(key), "base", "margin", "position", F.col("c.x").alias("value"), F.col("c.phi").alias("phi"))
    if not isinstance(names, DataFrame):
        names = spark.createDataFrame(list(enumerate(names)), "position int, feature string")
    names = F.broadcast(names.select("position", "feature"))  # one row a feature of the vector
    return out.join(names, "position").select(
        key, "base", "margin", "position", "feature", "value", "phi")


# The boosting model that is explained where none was tuned.
EXPLAINED = {"n_estimators": 120, "learning_rate": 0.05, "max_depth": 2}


def fit_explained(df: DataFrame, label: str = "target", key: str = "row_id") -> PipelineModel:
    """The pipeline to explain if no tuned boosting model is at hand, fitted on all rows."""
    from earlywarn.operators.validate import fit_pipeline

    return fit_pipeline(df, "Gradient Boosting", EXPLAINED, label, key, ())


def boosting_contributions(df: DataFrame, model: PipelineModel, background: DataFrame, key: str = "row_id",
                           features: str = "features") -> DataFrame:
    """Contributions of a fitted preprocessing + boosting pipeline on its
    transformed features, on the log-odds scale (see ``tree_contributions``)."""
    prepared = PipelineModel(stages=list(model.stages[:-1]))
    rows, back = prepared.transform(df), prepared.transform(background)
    names = feature_names(rows, features)
    return tree_contributions(rows, back, node_table(model.stages[-1]), vector_to_array(F.col(features)), names, key)
