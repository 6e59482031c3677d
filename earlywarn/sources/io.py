"""Delimited text and table sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


SNIFFED_LINES = 20


def sniff_separator(spark: SparkSession, path: str, seps: Sequence[str] = (",", ";", "\t", "|")) -> str:
    """The separator of a delimited file, from its first lines.

    A separator stands in every line equally often, outside quotes; of such
    characters the most frequent one wins, then the first of ``seps``, then
    any other mark.  Without one, the most frequent of ``seps`` in the header.
    """
    lines = [re.sub(r'"[^"]*"', "", r[0]) for r in spark.read.text(path).limit(SNIFFED_LINES).collect() if r[0]]
    if not lines:
        return seps[0]
    marks = [*seps, *sorted({c for c in lines[0] if not c.isalnum() and c not in " _-.'\"/" and c not in seps})]
    even = [(lines[0].count(m), -i, m) for i, m in enumerate(marks) if m in lines[0] and len({x.count(m) for x in lines}) == 1]
    header = [(lines[0].count(m), -i, m) for i, m in enumerate(seps)]
    return max(even or header)[2]


def read_delimited(spark: SparkSession, path: str, seps: Sequence[str] = (",", ";", "\t", "|"), schema: StructType | None = None) -> DataFrame:
    """Delimiter-tolerant CSV with a header; header names trimmed,
    ``unnamed*`` columns dropped."""
    sep = sniff_separator(spark, path, seps)
    r = spark.read.option("header", True).option("sep", sep)
    df = r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)
    trimmed = [c.strip() for c in df.columns]
    df = df.toDF(*trimmed)
    return df.drop(*[c for c in trimmed if c.lower().startswith("unnamed")])


def persist_base(df: DataFrame) -> DataFrame:
    """Keep the base table across the many jobs that read it."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """S3: CSV with a header, no index column."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] | None = None) -> None:
    """Result table to Parquet or CSV, optionally partitioned."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def save_model(model, path: str) -> None:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def resolve_model(candidates):
    """The first saved pipeline that exists, in precedence order: (label, model).

    Only a path that is not there is passed over; a model that cannot be read is an error.
    """
    from pyspark.ml import PipelineModel

    errors = []
    for label, path in candidates:
        try:
            return label, PipelineModel.load(path)
        except Exception as e:  # noqa: BLE001 - Spark has no one type for a missing path
            if not re.search("does not exist|PATH_NOT_FOUND|No such file", str(e)):
                raise
            errors.append(f"{label}: not found")
    raise FileNotFoundError("no saved model found (" + "; ".join(errors) + ")")
