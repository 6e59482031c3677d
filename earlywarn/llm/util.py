"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.session import scratch_path, ship_package

NONSPACE = r"[^\x20\x09-\x0D]+"  # a word: a run of characters other than ASCII white space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table in the cluster's shared folder and
    read it back: lineage ends there, and a lost executor costs no rework."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, rows: int, rows_per_task: int) -> int:
    """Partitions that hold about ``rows_per_task`` rows, never fewer than the
    session's shuffle partitions."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(conf, -(-rows // rows_per_task))


THINNED = 1 << 20


def thinned(hash_: Column, wanted: int, n: int | Column) -> Column:
    """Condition that keeps about twice ``wanted`` of ``n`` rows, evenly by a
    hash, so that a sample is picked from a set of bounded size."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(hash_, F.lit(THINNED)) * n < F.lit(2 * wanted * THINNED)


def require(df: DataFrame, *names: str) -> None:
    """Check the columns an operator reads and make this package importable in its tasks."""
    ship_package(df.sparkSession)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def prefix_sums(df: DataFrame, keys: Sequence[str], order: str, value: Column | str, out: str) -> DataFrame:
    """Exclusive running total of ``value`` along ``order`` within ``keys``.

    For tables of per-bucket totals only (one row per bucket), whose size is
    set by the number of buckets and not by the rows beneath them.
    """
    from pyspark.sql import Window

    value = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


@functools.lru_cache(maxsize=1)
def popcount_table():
    import numpy as np

    return np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)
