"""Corpus pipeline: documents to packed training sequences.

Stages: quality resampling, near-duplicate removal, mixing to target weights, packing. Each stage works on all rows that the
one before it kept, and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from taxolink.llm import mixing, packing, resampling, set_join
from taxolink.session import table_path, write_and_read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the quality resampling rejects go."""
    labels = spark.read.parquet(table_path(sf_dir, "labels")).select("doc_id", "quality")
    model, _ = resampling.fit(docs, labels)
    return resampling.keep_sampled(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of documents that share four fifths of their 5-word shingles, directly or by others, one stays."""
    return set_join.one_of_each(docs, n=5, num=80, den=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: sources mixed to their target weights; a document is there as often as it is taken."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: all documents of the mix packed into sequences of 2048 tokens; one row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0, spaced=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packed", packed)]

#: No stage from the first on can be told in SQL: hashed n-gram models, knapsack counts and token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` to the packed pieces."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = write_and_read(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
