"""The corpus pipeline: quality classifier, exact dedup, MinHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet into the shared
folder and reads it again as the next stage's docs, so a lost executor costs no more than the stage that runs. All
stages but the last return the columns of documents; the last returns the packed parts of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import exact_dedup, near_dedup, packing, quality, substring_dedup
from tesserae.session import make_importable, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier keeps; it learns from the labels of those documents."""
    make_importable(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those whose text one of a smaller doc_id has."""
    make_importable(spark)
    return exact_dedup.keep_first(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id."""
    make_importable(spark)
    return near_dedup.keep_one(docs)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each passage of 50 words or more left only where it occurs first."""
    make_importable(spark)
    return substring_dedup.cut(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, part, start_token, n_tokens, cost, sequence_id): where each part of each document goes."""
    make_importable(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("minhash_near_dedup", near_deduplication),
    ("substring_dedup", substring_deduplication),
    ("packing", packed_sequences),
]

#: SQL can express neither the classifier nor near duplicates nor packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
