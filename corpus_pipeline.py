"""From raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
``documents``; the last returns the packed pieces. Stages are written as Parquet and read again, so a
lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matforge.llm import exact_dedup, langid, ledger, near_dup, packing
from matforge.runtime import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy. Null and short texts go; repeated rows are judged alike; ids and other columns do not matter. An empty table gives no rows."""
    return ledger.keep_passing(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, by a model fitted on these documents. Null texts and texts without a letter go; without any labelled row all go. An empty table gives no rows."""
    return langid.keep_identified(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (white space apart): that of the smallest id. A null text counts as empty; null ids lose to others; of repeated rows one stays. An empty table gives no rows."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id. Null and blank texts and rows with null ids stay. An empty table gives no rows."""
    return near_dup.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens. A null text is one closing id; repeated rows are packed as documents of their own. An empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("exact_dedup", exact_copies), ("minhash_near_dedup", near_copies), ("packing", pack)]
#: Language scores, similarity classes and tokenisation have no SQL form; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
