"""Score a stream of new records, append-only and stateless.

New records arrive as Parquet files in a folder; each micro-batch is scored
with the same scorer as the batch path (a fitted pipeline or fixed
coefficients) and appended to a Parquet sink.  Progress lives in a
checkpoint under the cluster's shared folder, so a restarted query (or a
lost executor) resumes without duplicates: the file sink is exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from earlywarn.operators.score import Scorer, score_batch


def score_stream(spark: SparkSession, source: str, schema: StructType, scorer: Scorer, t: float, sink: str,
                 checkpoint: str, model_name: str = "model", available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the streaming scorer; returns the ``StreamingQuery``.

    ``available_now`` processes everything present and stops (a scheduled
    job); otherwise the query keeps running on new files.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    stream = reader.parquet(source)
    scored = score_batch(stream, scorer, t, model_name)
    w = scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_to_end(query) -> None:
    """Wait for an available-now query and surface its failure."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def read_sink(spark: SparkSession, sink: str, schema: StructType | None = None) -> DataFrame:
    r = spark.read
    return (r.schema(schema) if schema is not None else r).parquet(sink)
