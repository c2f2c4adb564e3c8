"""The registered queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import toxicity
from tallymill.llm.decontaminate import contamination
from tallymill.llm.kneser_ney import score_documents
from tallymill.llm.merkle import manifest, tampered
from tallymill.llm.oracles import SQL
from tallymill.llm.packing import pack_documents
from tallymill.llm.quality import judged
from tallymill.llm.runtime import table
from tallymill.llm.sharding import shard_rows
from tallymill.llm.simhash import fingerprint_hex, near_groups
from tallymill.llm.sketch import fingerprint_edits
from tallymill.llm.substring import remove_repeats
from tallymill.llm.urlfilter import judge_urls
from tallymill.llm.vectorcodes import compress
from tallymill.llm.warc import read_index, write_archive


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13, join_words=" ")
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"), words=3, radius=3)
    return out.select(F.col("id").alias("doc_id"), fingerprint_hex(F.col("code")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"), shards=24)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The contract's rules.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(table(spark, sf_dir, "pages"), least=0)
    return read_index(spark, archive).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=2048, per_source=4).withColumnRenamed("id", "doc_id")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"), least=1)
    return out.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    """The categories that the labels have: low quality first, then toxic."""
    return toxicity.train(docs, table(spark, sf_dir, "labels"), categories={"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity_chain(spark, docs, sf_dir)
    out = toxicity.score(docs, chain)
    return out.select(F.col("id").alias("doc_id"), "p_low_quality", "p_toxic", (F.col("p_toxic") >= chain.reject).alias("toxic"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", F.array_join("failed", ", ").alias("failed"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), present=tampered()).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc": op2_warc,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_fingerprints": op8_fingerprints,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_sharding": op10_sharding,
    "op11_quality": op11_quality,
    "op12_vector_codes": op12_vector_codes,
    "op13_merkle_manifest": op13_merkle_manifest,
}

__all__ = ["QUERIES", "SQL"]
