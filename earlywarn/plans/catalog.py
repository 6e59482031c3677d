"""Named queries: each is ``fn(spark, sf_dir) -> DataFrame`` over the driver
tables, with an optional DuckDB oracle SQL producing the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from earlywarn.functions.frames import round_doubles

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int | None = 6):
    """Register ``fn`` under ``name``; doubles are rounded to ``digits`` places."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df, digits) if digits is not None else df

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from earlywarn.plans import q_explore, q_evaluate, q_decide, q_stats, q_models, q_score, q_io  # noqa: F401
