"""The corpus pipeline: stages that each call one operator, over the table of documents.

Every stage keeps all columns but the last, takes empty tables, and lets the driver give back what
the plans of the stage before it held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seekstone.llm import decontamination, ngram_join, packing, pii, queries, toxicity
from seekstone.shared import release, stage
from seekstone.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine rejects go; null and empty texts stay."""
    release(spark)
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays; null ids and empty texts stay."""
    release(spark)
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each by its own text, null ids too."""
    release(spark)
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; no row goes, and null texts become empty."""
    release(spark)
    return pii.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents that are left, repeated and empty ones too."""
    release(spark)
    return packing.pack_documents(docs, queries.TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("pii", redact), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage_function in STAGES[:-1]:
        docs = stage(stage_function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
