"""Packing by concatenate-and-cut.

All documents, each followed by an end id, form one long stream of ids that
is cut into windows of ``length``.  Pass one tokenizes every partition and
records, per document, how many ids of its partition stand before it; the
totals of the partitions, summed along the partition number, turn that into
the document's place in the whole stream.  Pass two cuts every document at
the window edges and emits one boundary record per piece.  Only one total per
task travels between the passes, so no task sees more than its own rows.

Defined results: a null text counts as empty (its document is the end id
alone); a null document id is kept; repeated rows are documents of their own;
an empty table gives no pieces; other columns are ignored, whatever their
names; a long text spans as many windows as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import util
from earlywarn.llm.textwords import slices
from earlywarn.llm.tokens import encoder

ENCODED = "id long, part int, before long, n long, ids binary"
PIECES = "id long, start long, length long, sequence_id long, offset long, doc_tokens long, ids binary"


def encode_documents(df: DataFrame, id_col: str, text_col: str, tokenizer: str, leading: bool, end_id: int) -> DataFrame:
    """Pass one: per document its ids (little-endian unsigned 16 or 32 bits,
    by the size of the vocabulary), its partition and the ids before it there."""
    util.require(df, id_col, text_col)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        enc = encoder(tokenizer, leading)
        kind = "<u2" if enc.tok.get_vocab_size() <= 1 << 16 else "<u4"
        part, before = TaskContext.get().partitionId(), 0
        for batch in rows:
            ids = batch.column(0)
            for a, b in slices(batch.column(1)):
                flat, counts = enc.encode_column(batch.column(1).slice(a, b - a))
                ends = np.cumsum(counts)
                full = np.insert(flat, ends, end_id).astype(kind)  # the end id after each document
                n = counts + 1
                edge = np.concatenate([[0], np.cumsum(n)])
                blob = [full[s:e].tobytes() for s, e in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a).cast(pa.int64()),
                        pa.array(np.full(b - a, part), pa.int32()),
                        pa.array(before + edge[:-1], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(blob, pa.binary()),
                    ],
                    ["id", "part", "before", "n", "ids"],
                )
                before += int(edge[-1])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def cut_windows(encoded: DataFrame, length: int, wide: bool) -> DataFrame:
    """Pass two: the pieces of every document.

    ``encoded`` must be a written table, so that its partition numbers and
    running counts stay as they are however often a task is repeated.
    """
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    # one row per task of pass one: a size known from the plan, not from the data
    begins = util.prefix_sums(totals.withColumn("all", F.lit(0)), ["all"], "part", "total", "begin").select("part", "begin")
    placed = encoded.join(F.broadcast(begins), "part").select("id", (F.col("begin") + F.col("before")).alias("at"), "n", "ids")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        kind = "<u4" if wide else "<u2"
        names = ["id", "start", "length", "sequence_id", "offset", "doc_tokens", "ids"]
        for batch in rows:
            out: list[tuple] = []
            size = 0
            for doc, at, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(blob, dtype=kind).astype("<u4")
                first, last = at // length, (at + n - 1) // length
                for seq in range(first, last + 1):
                    s, e = max(0, seq * length - at), min(n, (seq + 1) * length - at)
                    out.append((doc, s, e - s, seq, at + s - seq * length, n, ids[s:e].tobytes()))
                size += n
                if size > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names)

    return placed.mapInArrow(run, PIECES)


TYPES = [pa.int64()] * 6 + [pa.binary()]


def pack(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    length: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    leading: bool = True,
) -> DataFrame:
    """Pieces of all documents of ``df`` in windows of ``length`` ids: id,
    start (ids of the document before the piece), length, sequence_id, offset
    (in the window), doc_tokens, and the ids as little-endian unsigned 32-bit
    integers.  Every window but the last is full; the last is padded."""
    wide = encoder(tokenizer, leading).tok.get_vocab_size() > 1 << 16
    encoded = util.cut(encode_documents(df, id_col, text_col, tokenizer, leading, end_id), "pack-ids")
    return cut_windows(encoded, length, wide)
