"""Corpus pipeline: from raw documents to the tokens of a deduplicated mix.

Each stage gets the rows its predecessor kept and, but for the last, returns rows with
the columns of documents.  A null or empty text is judged by the quality model's bias and has
no language, so the second stage drops it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quorumlake.llm import bpe_fst, jaccard_join, lang_mix, mixing, quality, queries
from quorumlake.llm.common import Scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, learned from the labels: documents scored under the threshold go."""
    return quality.keep_good(docs, queries.quality_model(spark, sf_dir))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language mixture: documents without letters, or in which no language prevails, go."""
    return lang_mix.keep_determined(docs, queries.language_model(spark, sf_dir))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join over five-word shingles at 0.8: the least doc_id of each group stays.

    Rows with a null doc_id stay; rows that share a doc_id stay or go together.
    """
    found = jaccard_join.jaccard_components(docs, k=5, percent=80)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    # merged at every size: what is gone grows with the corpus
    return docs.hint("merge").join(gone, "doc_id", "left_anti").select(docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix to target weights: a row for each time the mix takes a document; others go.

    Rows that share an id, or have none, are decided one by one; equal keys are ordered by id, size and the
    text's hash.  An empty table stays empty.
    """
    return mixing.mixed_rows(docs, queries.quality_weights(spark, sf_dir))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ``doc_id, n_tokens, ids`` (little-endian 32-bit), with hashes of the ids and of what they decode to.

    A row for each row of ``docs``, repeated ones included; a null text has no ids; an empty table stays empty.
    """
    return bpe_fst.round_trip(docs, queries.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near duplicates", no_near_duplicates),
    ("mix", mixed_sources),
    ("encode", encoded),
]
#: Models, shingle components and BPE can't be stated in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
        if i > 0:
            scratch.drop(f"stage-{i - 1}")
    return docs
