"""Queries of the corpus operators over the synthetic tables, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tesserae.llm import bpe, exact_dedup, fingerprints, near_dedup, packing, quality, substring_dedup, token_counts, toxicity, url_filter


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    """(doc_id, start_word, end_word, n_words) of every stretch of 50 words or more that occurs twice in the documents."""
    return substring_dedup.repeated(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    """(doc_id, keeper_id) of each document that repeats an earlier text; the lower half of the ids is the snapshot."""
    return exact_dedup.exact_duplicates(*exact_dedup.halves(_table(spark, sf_dir, "documents")))


def op3_bpe(spark, sf_dir):
    """(doc_id, n_tokens, token_ids, exact) of every document."""
    return bpe.encoded(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    """(doc_id, score, keep) of every document."""
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_counts(spark, sf_dir):
    """(doc_id, n_tokens) of every document."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark, sf_dir):
    """(doc_id, block_size, signature, double_signature, group_id) of every document."""
    return fingerprints.grouped(_table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    """(doc_id, part, start_token, n_tokens, cost, sequence_id) of every part of every document."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    """(page_id, host, n_labelled, bad_rate, upper, keep) of every page."""
    pages = _table(spark, sf_dir, "pages")
    return url_filter.scored_urls(pages, url_filter.page_outcomes(pages, _table(spark, sf_dir, "labels")))


def op9_minhash_near_dedup(spark, sf_dir):
    """(doc_id, group_id) of each document that has a near copy."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    """(doc_id, score) of the documents that the model finds toxic, out of all."""
    return toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP2_SQL = """
SELECT doc_id, keeper_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keeper_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
) WHERE doc_id <> keeper_id
"""

QUERIES = (
    op1_substring_dedup,
    op2_exact_dedup,
    op3_bpe,
    op4_quality_classifier,
    op5_token_counts,
    op6_fingerprints,
    op7_packing,
    op8_url_filter,
    op9_minhash_near_dedup,
    op10_toxicity,
)


def queries():
    return {q.__name__: q for q in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    every = {"op2_exact_dedup": OP2_SQL, "op8_url_filter": url_filter.sql(), "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: text for name, text in every.items() if text is not None}
