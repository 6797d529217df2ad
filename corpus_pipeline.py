"""The corpus pipeline: toxicity, language, near duplicates, mixture, tokens.

``STAGES`` are (name, function of (spark, docs, sf_dir)); each works on all rows the one before
it kept.  All but the last return the columns they were given.  ``run`` writes every stage's
result below the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.llm import langid, mixing, prefix_bpe, simhash, toxicity
from benchloom.session import cut

TOXIC_FROM = 0.5
ENTROPY = 0.97
DEDUP_SHINGLE = 3
DEDUP_PRINTS = 4
DEDUP_SIMILARITY = 0.8  # of the sets of five-word shingles


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC_FROM`` stay; the model learns from those of ``docs`` that are labelled."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.score(F.col("text"), model) < TOXIC_FROM)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language score reaches the model's floor stay; where no language could be learned, all with letters.  Null texts go."""
    return docs.filter(langid.accepted(F.col("text"), langid.learn(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id.

    Texts link if their sets of five-word shingles are alike to ``DEDUP_SIMILARITY`` or more, by
    exact count.  Candidates are texts with fingerprints within 4 bits, which alone miss some of
    these pairs and hold others below it, and texts that share a band of least hashes.
    """
    return simhash.keep_one(docs, shingle=DEDUP_SHINGLE, prints=DEDUP_PRINTS, similarity=DEDUP_SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture deals them."""
    return mixing.mix(docs, entropy=ENTROPY)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every row dealt."""
    ids = prefix_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: SQL has none of the models, hashes and merges above; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
