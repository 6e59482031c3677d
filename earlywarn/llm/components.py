"""Connected components of a link table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import util


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the smallest node of its component) for every node with
    a link to another one; ``edges`` should be a written table.

    Alternating star contraction: each round hangs the larger neighbours of a
    node, then its smaller ones, onto the smallest node known to it, until
    every link points at its component's root.  Each round is one table in
    the shared folder, so a lost executor costs a part of one round.
    """
    links = util.cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "components"
    )
    state = None
    while True:
        # large star: the larger neighbours of u point at the smallest of u and its neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = util.cut(large.distinct(), "components-large")
        # small star: u and its smaller neighbours point at the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        links = util.cut(small, "components-small")
        now = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == (now.n, now.h):
            break
        state = (now.n, now.h)
    root = links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return util.cut(root, "components-roots")
