"""Token files: Parquet with one row per document and its ids as a list.

Documents lie in ascending id order, within and across files.  ``ids`` is a
dictionary-encoded list column, the whole numbers beside it are delta-encoded
(Parquet version 2 pages), row groups and pages have set sizes, and the page
indexes that the writer adds let a reader fetch the pages of a few documents
only; reads that need counts alone never touch the ids.

Defined results: a null text counts as empty (its list holds the end id
alone); null document ids come first; repeated rows are kept, equal ids
stand next to each other; an empty table gives an empty file set; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.llm import util
from earlywarn.llm.textwords import slices
from earlywarn.llm.tokens import encoder

SCHEMA = "doc_id long, part int, before long, n_tokens long, ids array<int>"
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#before": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}


def write_tokens(
    df: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    leading: bool = False,
    layout: dict[str, str] | None = None,
) -> None:
    """Encode every text, append ``end_id`` and write the token files to ``path``.

    The files are ranges of (id, hash of the text): one id with very many
    rows spreads over several files.
    """
    util.require(df, id_col, text_col)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        enc = encoder(tokenizer, leading)
        part, before = TaskContext.get().partitionId(), 0
        for batch in rows:
            ids = batch.column(0)
            for a, b in slices(batch.column(1)):
                flat, counts = enc.encode_column(batch.column(1).slice(a, b - a))
                full = np.insert(flat, np.cumsum(counts), end_id)
                n = counts + 1
                edge = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array(np.full(b - a, part), pa.int32()),
                        pa.array(before + edge[:-1], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(full, pa.int32())),
                    ],
                    ["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(edge[-1])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ordered.mapInArrow(run, SCHEMA).write.options(**(LAYOUT | (layout or {}))).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token files; selecting and filtering columns prunes pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and start (ids of all documents before it), read
    without the ids: one total per file is summed along the file number."""
    meta = read_tokens(spark, path).select("doc_id", "part", "before", "n_tokens")
    return with_start(meta, meta).drop("part", "before")


def with_start(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Add ``start`` to rows that carry ``part`` and ``before``."""
    totals = meta.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    begins = util.prefix_sums(totals.withColumn("all", F.lit(0)), ["all"], "part", "total", "begin").select("part", "begin")
    # one row per file: a size known from the plan, not from the data
    return rows.join(F.broadcast(begins), "part").withColumn("start", F.col("begin") + F.col("before")).drop("begin")


def id_digests(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by their crc32 as little-endian unsigned 32-bit integers."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        for batch in batches_:
            lists = batch.column(batch.schema.get_field_index("ids"))
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            off = lists.offsets.to_numpy()
            view = memoryview(np.ascontiguousarray(flat)).cast("B") if len(flat) else b""
            crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            kept = batch.drop_columns(["ids"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(crc, pa.int64())], [*kept.schema.names, "ids_crc32"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([f for f in rows.schema if f.name != "ids"]).add("ids_crc32", LongType())
    return rows.mapInArrow(run, schema)
