"""Corpus pipeline: five stages from ``documents`` to shards.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir)
and returns a DataFrame; each result is written as Parquet to the shared
folder and read again as the next stage's input. All stages but the last
return the columns of documents; the last adds size, text_crc32, shard and
slot. An empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowsmith.llm.common import lean_batches, table
from rowsmith.llm.decontaminate import clean
from rowsmith.llm.mixing import mix_documents
from rowsmith.llm.ngram_jaccard import keep_one
from rowsmith.llm.quality_rules import keep_documents, learn_references
from rowsmith.llm.vector_packing import pack
from rowsmith.session import delete_path, scratch_path, temporary

N_SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    lean_batches(spark)
    return keep_documents(docs, learn_references(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a Jaccard similarity of 0.8 of 5-word shingles."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a 10-word window of a benchmark item occurs."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Choose documents by the target weights; one that is taken in several epochs comes several times."""
    return mix_documents(docs).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents into shards of nearly equal bytes, tokens and rows."""
    return pack(docs, N_SHARDS, docs.columns)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# The divergences, the links and the packing are not expressible in SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's input, and what it wrote on the way, goes when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline_{name}")
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
