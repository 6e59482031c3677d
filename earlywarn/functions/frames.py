"""Small DataFrame helpers shared by operators."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def null_safe_join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the group keys, where a null key matches a null key: a group
    may be the one of the missing values."""
    hidden = {c: f"__right_{c}" for c in by}
    right = right.withColumnsRenamed(hidden)
    cond = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(h)) for c, h in hidden.items()])
    return left.join(right, cond, how).drop(*hidden.values())


def join_on(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the group keys; with no keys ``right`` is a global aggregate
    (exactly one row), attached by broadcast."""
    by = list(by)
    if by:
        return null_safe_join(left, right, by, how)
    return left.crossJoin(F.broadcast(right))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (for stable comparisons and reports)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


BROADCAST_GROUPS = 200_000  # rows of a per-group statistics table that may be broadcast


def join_group_stats(df: DataFrame, stats: DataFrame, by: Sequence[str], limit: int = BROADCAST_GROUPS) -> DataFrame:
    """Attach per-group statistics (one row per group) to every row of ``df``.

    A hot group must not meet its statistics in one task, so the statistics
    side is broadcast once its row count - checked here, on the cached
    aggregate - is within ``limit``; a larger one goes through a shuffle join
    (AQE splits skewed partitions).
    """
    by = list(by)
    if not by:
        return df.crossJoin(F.broadcast(stats))
    stats = stats.cache()
    n = stats.count()
    return null_safe_join(df, F.broadcast(stats) if n <= limit else stats, by)
