"""A corpus pipeline of five stages, each applying one of the corpus operators.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talusgrid.llm import bpe, contamination, lang_zstd, line_spread, simhash_anchor
from talusgrid.llm.common import clear_scratch, materialize, scratch_mark, table
from talusgrid.llm.registry import byte_bpe_files, fit_language_model


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the compression model can tell."""
    return lang_zstd.keep_identified(docs, fit_language_model(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines spread over many sites, but for their first occurrence; ``n_chars`` follows the text."""
    cleaned = line_spread.clean(docs)
    size = F.when(F.col("_n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", size).select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    return simhash_anchor.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold an item of ``benchmark``."""
    return contamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of ids and of the bytes they decode to."""
    return bpe.encode(docs, *byte_bpe_files())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: The compression sizes and fingerprints have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    mark = scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear_scratch(mark, keep=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
