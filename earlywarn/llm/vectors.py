"""Vector tables: validity, dense blocks, and searches of query blocks
against blocks of all rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.llm import util

QUERY_ROWS = 2048  # queries held by one task


def usable(vec: Column) -> Column:
    """Vectors that take part: not null or empty, no null or non-finite component."""
    v = F.transform(vec, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite, F.lit(False))


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vec (doubles) of the rows that take part; a null id names no row."""
    util.require(df, id_col, vec_col)
    rows = df.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def query_blocks(queries: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The queries, one row per id, dealt to blocks of about ``QUERY_ROWS``."""
    blocks = max(1, -(-n // QUERY_ROWS))
    one = queries.groupBy("id").agg(F.min("vec").alias("vec"))
    return one.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), blocks


def dense(column: pa.Array, width: int):
    """Matrix (rows x width) of a list column; short lists end in zeros."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = values
    return out


def search_blocks(
    queries: DataFrame,
    query_blocks_: int,
    base: DataFrame,
    base_blocks: int,
    task: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """Every block of queries meets every block of ``base`` (column ``block``)
    in one task: ``task(queries, base) -> table``."""
    every = F.explode(F.sequence(F.lit(0), F.lit(base_blocks - 1)))
    left = queries.withColumn("block", every)
    right = base.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks_ - 1))))
    return left.groupBy("qb", "block").cogroup(right.groupBy("qb", "block")).applyInArrow(task, schema)


def ranked(found: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each query: rank from 1, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score)
