"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from benchloom.functions.variants import let
from benchloom.llm import anchors, dac, jump, langid, mixing, periods, postings, prefix_bpe, pstable, resampling, simhash, toxicity, warc
from benchloom.llm.common import table
from benchloom.llm.oracles import ORACLE  # noqa: F401
from benchloom.session import scratch_path

SHARDS = 16
ENTROPY = 0.97  # of the greatest entropy


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written as directly addressable codes and read back."""
    path = scratch_path(spark, "codes")
    dac.write_segments(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), special_as_text=False)
    return dac.document_digests(dac.read_segments(spark, path))


def op2_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and its near-duplicate component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture deals it, with its epoch, block and place."""
    rows, totals = mixing.source_totals(table(spark, sf_dir, "documents"))
    return mixing.realise(rows, mixing.weights(totals, entropy=ENTROPY))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return langid.classify(docs, langid.learn(docs))


def op5_pstable_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and near-duplicate component."""
    return pstable.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of each twentieth vector."""
    return postings.search(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, slot and shard after one more is appended."""
    return jump.assign(table(spark, sf_dir, "documents"), SHARDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = scratch_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by prefix dynamic programming and decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = prefix_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op11_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand in a document with a smaller id."""
    stripped = anchors.remove_repeats(table(spark, sf_dir, "documents"))
    return stripped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _with_period(doc_id, text):
    """A tenth of the texts, chosen by the CRC of the id: from a word on, the words up to there repeated to the end."""

    def repeated(v):
        n, g = F.size(v["words"]).cast("bigint"), v["g"]
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("bigint")
        at = lambda s: F.transform(s["words"], lambda w, i: F.get(s["words"], F.when(i >= s["a"], s["a"] + F.pmod(i - s["a"], s["p"])).otherwise(i).cast("int")))
        return F.when(n > 0, let(F.struct(v["words"].alias("words"), a.alias("a"), p.alias("p")), lambda s: F.array_join(at(s), " "))).otherwise(F.lit(""))

    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = let(F.struct(words.alias("words"), F.floor(h / 10).cast("bigint").alias("g")), repeated)
    return F.when(F.pmod(h, F.lit(10)) == 0, planted).otherwise(text)


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of every document, with those planted in a tenth of them."""
    docs = table(spark, sf_dir, "documents")
    found = periods.find_runs(docs.select("doc_id", _with_period(F.col("doc_id"), F.col("text")).alias("text")))
    # of all runs the longest, then the first, then that of the smallest period
    best = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"].alias("size"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.size").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.size") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_prefix_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance for the benchmark's texts, and its place in the draw."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OPERATORS = [op1_token_codes, op2_covering_simhash, op3_mixing, op4_language_id, op5_pstable_dedup, op6_posting_lists, op7_toxicity, op8_jump_shards, op9_warc, op10_prefix_bpe, op11_difference_cover, op12_word_runs, op13_prefix_crc]
QUERIES = {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}
