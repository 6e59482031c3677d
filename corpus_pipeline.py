"""The corpus pipeline over ``documents``: language ID, line dedup, SimHash
near-dedup, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir) and returns a table, which is written
and read again before the next one.  All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.llm import langid, lines, mix, pack, simhash
from earlywarn.llm.queries import WEIGHTS, mix_levels
from earlywarn.llm.tokens import tokenizer_path
from earlywarn.llm.util import cut, table

MIX = {"budget_share": 0.8, "max_epochs": 1, "seed": 7}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay, and a missing label is filled
    in; those without a letter, or in phrases of fewer than two characters, go."""
    model = langid.fit(docs.filter(~langid.held_out()))
    found = docs.withColumn("__found", langid.language(model, F.col("text"), spark))
    go = langid.rejected(F.col("__found.lang_pred"), F.col("__found.bits"), model.most_bits())
    lang = F.coalesce("lang", "__found.lang_pred").alias("lang")
    return found.filter(~go).select(*[lang if c == "lang" else c for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one go; ``n_chars`` follows the text."""
    out = lines.dedup_lines(docs, threshold=0.8).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of the smallest id,
    null ids last, then of the smallest text hash, then any one."""
    return simhash.one_of_each(docs, shingle=4, max_bits=4)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, each once."""
    return mix.mix(docs, mix_levels(), WEIGHTS, **MIX)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-id sequences, with their ids."""
    return pack.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, length=1024)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None  # SQL has no automata, shingle hashes or tokenizers; the tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
