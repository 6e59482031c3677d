"""Sharding by a k-d tree with distributed weighted medians (DataFrame only).

The rows are points: one coordinate per metadata dimension, the size in bytes
as weight.  A node with more than one leaf is split along its widest
dimension (its extent relative to the whole table's) where the weight on the
left reaches its share of the leaves; halving goes on until a leaf holds the
target bytes.  All nodes of a level are split together.  A weighted median is
found exactly by histograms that close in on it: a pass gives each node
``BINS`` buckets, only the bucket that the median falls into is refined.
Equal coordinates are ordered by a hash of the group, so a tie of any size is
split as well, and rows of one group (equal texts) share a shard; the
coordinates must be functions of the group.

Only one row per node and pass reaches the driver.  Slots number the rows of
a shard without a task that holds the shard: rows are numbered in buckets,
and the buckets' sizes are summed up.

Defined results: a null text is a group of its own with one byte; null and NaN
coordinates count as 0; a group larger than a leaf stays whole, so its shard
exceeds the target; more shards than groups leave shards empty; repeated rows
get slots of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.llm import util

BINS = 4096
SLOT_ROWS = 20_000  # rows numbered by one task


def text_dimensions(text: Column) -> list[Column]:
    """Metadata of a text: log of its bytes, share of blanks, share of bytes
    beyond one per character."""
    octets, chars = F.octet_length(text), F.char_length(text)
    blanks = chars - F.char_length(F.replace(text, F.lit(" "), F.lit("")))
    size = F.greatest(octets, F.lit(1)).cast("double")
    return [F.log2(size + 1), blanks / size, (octets - chars) / size]


@dataclass
class _Node:
    node: int
    first: int  # first of its shards
    leaves: int


def _values(spark, rows: Sequence[tuple], names: str) -> DataFrame:
    """A small literal table."""

    def lit(x) -> str:
        if isinstance(x, float):
            return f"CAST('{x!r}' AS DOUBLE)"
        if isinstance(x, bool):
            return str(x).lower()
        return f"CAST('{x}' AS BIGINT)"

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def _crossing(points: DataFrame, states: dict[int, dict], value: str, exact: str) -> dict[int, dict]:
    """For each node the bucket of ``value`` in [lo, hi] where the weight
    reaches the node's target; exact bounds of the bucket's ``exact`` column."""
    table = _values(
        points.sparkSession,
        [(n, float(s["lo"]), float(s["hi"]), float(s["target"])) for n, s in states.items()],
        "node, lo, hi, target",
    )
    share = F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    bucket = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(share * BINS))).cast("int")
    hist = (
        points.join(F.broadcast(table), "node")
        .withColumn("bucket", bucket)
        .groupBy("node", "target", "bucket")
        .agg(F.sum("w").alias("w"), F.min(exact).alias("least"), F.max(exact).alias("most"))
    )
    run = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = (
        hist.withColumn("upto", F.sum("w").over(run))
        .filter("upto >= target")
        .groupBy("node")
        .agg(F.min_by(F.struct("upto", "w", "least", "most"), "bucket").alias("b"))
        .select("node", "b.*")
    )
    return {r.node: {"below": r.upto - r.w, "w": r.w, "least": r.least, "most": r.most} for r in hit.collect()}


def _split_level(points: DataFrame, nodes: list[_Node], extents: list[float], origin: dict) -> list[tuple]:
    """(node, dim, value, hash, with) of each node's split: a row goes left if
    its (coordinate, hash) is smaller, or equal and ``with`` is set."""
    dims = len(extents)
    stats = {}
    for r in (
        points.groupBy("node")
        .agg(
            F.sum("w").alias("w"),
            *[F.min(F.col("d")[i]).alias(f"lo{i}") for i in range(dims)],
            *[F.max(F.col("d")[i]).alias(f"hi{i}") for i in range(dims)],
        )
        .collect()
    ):
        stats[r.node] = r
    todo = {}
    for n in nodes:
        if n.node in stats:
            r = stats[n.node]
            width = [(r[f"hi{i}"] - r[f"lo{i}"]) / extents[i] if extents[i] > 0 else 0.0 for i in range(dims)]
            dim = max(range(dims), key=lambda i: (width[i], -i))
            todo[n.node] = {
                "dim": dim, "lo": r[f"lo{dim}"], "hi": r[f"hi{dim}"], "target": r.w * (n.leaves // 2) / n.leaves,
            }
    if not todo:
        return []

    def along(states: dict, value: Column, keep: Column | None, cols: list[tuple[str, str]]) -> DataFrame:
        rows = [(n, *[s[k] for k, _ in cols]) for n, s in states.items()]
        small = _values(points.sparkSession, rows, ", ".join(["node", *[c for _, c in cols]]))
        out = points.join(F.broadcast(small), "node")
        return (out.filter(keep) if keep is not None else out).select("node", "w", "h", value.alias("v"))

    coordinate = F.element_at("d", F.col("dim").cast("int") + 1)
    # close in on the coordinate where the weight reaches the target
    active, value = dict(todo), {}
    while active:
        near = (coordinate >= F.col("from")) & (coordinate <= F.col("to"))
        cols = [("dim", "dim"), ("lo", "from"), ("hi", "to")]
        hit = _crossing(along({n: s | {"lo": float(s["lo"]), "hi": float(s["hi"])} for n, s in active.items()}, coordinate, near, cols), active, "v", "v")
        again = {}
        for n, s in active.items():
            b = hit[n]
            s = s | {"lo": b["least"], "hi": b["most"], "target": s["target"] - b["below"]}
            if b["least"] == b["most"]:
                value[n] = s
            else:
                again[n] = s
        active = again
    # rows at that coordinate are ordered by the hash of their group
    active = {n: s | {"at": float(s["lo"]), "lo": -(2**63), "hi": 2**63 - 1} for n, s in value.items()}
    done = []
    while active:
        keep = (coordinate == F.col("at")) & (F.col("h") >= F.col("from")) & (F.col("h") <= F.col("to"))
        cols = [("dim", "dim"), ("at", "at"), ("lo", "from"), ("hi", "to")]
        hit = _crossing(along(active, F.col("h").cast("double"), keep, cols), active, "v", "h")
        again = {}
        for n, s in active.items():
            b = hit[n]
            s = s | {"lo": b["least"], "hi": b["most"], "target": s["target"] - b["below"]}
            if b["least"] == b["most"]:
                done.append((n, s["dim"], s["at"], b["least"], 2 * s["target"] >= b["w"]))
            else:
                again[n] = s
        active = again
    return done


def kd_shards(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_bytes: int | None = None,
    shards: int | None = None,
    dimensions: Sequence[Column] | None = None,
) -> DataFrame:
    """id, size, text_crc32, shard, slot of every row.

    The number of leaves is ``shards``, or as many as ``target_bytes`` asks for.
    """
    util.require(df, id_col, text_col)
    text = F.col(text_col)
    dims = list(dimensions) if dimensions is not None else text_dimensions(text)
    points = util.cut(
        df.select(
            F.col(id_col).cast("long").alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("w"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
            F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"),
            F.array(*[F.nanvl(F.coalesce(d.cast("double"), F.lit(0.0)), F.lit(0.0)) for d in dims]).alias("d"),
        ),
        "shard-points",
    )
    whole = points.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("w").alias("w"),
        *[(F.max(F.col("d")[i]) - F.min(F.col("d")[i])).alias(f"e{i}") for i in range(len(dims))],
    ).first()
    if shards is None:
        shards = max(1, math.ceil((whole.w or 0) / target_bytes)) if target_bytes else 1
    extents = [whole[f"e{i}"] or 0.0 for i in range(len(dims))]

    placed = points.withColumn("node", F.lit(0).cast("long"))
    level = [_Node(0, 0, shards)]
    leaf_of: dict[int, int] = {}
    while level:
        for n in level:
            if n.leaves == 1:
                leaf_of[n.node] = n.first
        level = [n for n in level if n.leaves > 1]
        if not level:
            break
        splits = _split_level(placed, level, extents, {}) if whole.n else []
        if splits:
            table = _values(points.sparkSession, splits, "node, dim, at, hash, takes")
            c = F.element_at("d", F.col("dim").cast("int") + 1)
            left = (c < F.col("at")) | (
                (c == F.col("at")) & ((F.col("h") < F.col("hash")) | ((F.col("h") == F.col("hash")) & F.col("takes")))
            )
            child = F.when(F.col("dim").isNull(), F.col("node")).when(left, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)
            placed = placed.join(F.broadcast(table), "node", "left").withColumn("node", child).drop("dim", "at", "hash", "takes")
        level = [
            x
            for n in level
            for x in (
                _Node(2 * n.node + 1, n.first, n.leaves // 2),
                _Node(2 * n.node + 2, n.first + n.leaves // 2, n.leaves - n.leaves // 2),
            )
        ]
    leaves = _values(points.sparkSession, list(leaf_of.items()), "node, shard")
    rows = placed.join(F.broadcast(leaves), "node").select(
        "id", F.col("w").alias("size"), F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard")
    )
    return with_slots(rows, whole.n)


def with_slots(rows: DataFrame, n: int) -> DataFrame:
    """Number the rows of every shard from 0, without gaps."""
    buckets = util.tasks_for(rows, n, SLOT_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(buckets)).cast("int"))
    order = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(order) - 1)
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    begins = util.prefix_sums(sizes, ["shard"], "bucket", "n", "begin").select("shard", "bucket", "begin")
    return numbered.join(begins, ["shard", "bucket"]).select(
        "id", "size", "text_crc32", "shard", (F.col("begin") + F.col("place")).cast("long").alias("slot")
    )
