"""A corpus pipeline over documents: quality, near copies, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes every
stage's rows to the shared folder and reads them again.  All but the last return the columns of documents.

Null and empty texts score as the empty text in the quality stage, are nobody's near copy, and pack as an end mark
alone.  A row with a null doc_id passes the linking stages unchanged.  Rows with equal doc_id and equal words are copies of
each other, of which one stays; rows with equal doc_id and other texts are judged each by itself.  Of near copies the smallest
doc_id stays; of repeated passages the first, by doc_id.  Texts are read whole, whatever their length.  Other columns pass
through all stages but the last, whatever their names.  Empty tables give empty results; without labels the quality stage keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import jaccard, packing, quality, secrets, substrings, tokens
from ledgerlark.llm.common import saved, table

#: Words of a shingle and per cent of shared shingles from which documents are near copies.
NEAR_WORDS, NEAR_PCT = 5, 80
#: Words of a passage that counts as repeated.
PASSAGE = 50


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return jaccard.distinct(docs, NEAR_WORDS, NEAR_PCT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that also stand earlier; a text that is all repeats goes."""
    return substrings.trimmed(docs, PASSAGE)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each secret."""
    return secrets.masked(docs, secrets.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 1024 tokens."""
    return packing.pack(packing.cut(docs, tokens.vocabulary("byte_bpe_50k.json"), 1024, end_id=2), 1024)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_of_near_copies),
    ("repeats", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Trained models and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
