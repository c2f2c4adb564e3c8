"""A cleaning pipeline over documents: each stage takes what the one before kept.

All stages but the last return the columns of documents. Special cases, in every stage: a null text counts as empty and stays
null; an empty text, which is neither toxic nor contaminated, is a near-duplicate of other empty texts; a null doc_id is
never a copy of another row, so it stays; rows that repeat a doc_id are judged by their texts; empty tables give
empty results; columns beyond those of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import toxicity
from tallymill.llm.decontaminate import contamination
from tallymill.llm.packing import pack_documents
from tallymill.llm.queries import toxicity_chain
from tallymill.llm.runtime import new_path, table
from tallymill.llm.similar import keep_one
from tallymill.llm.substring import remove_repeats


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain rejects."""
    chain = toxicity_chain(spark, docs, sf_dir)
    scored = toxicity.score(docs, chain, keep_columns=True)
    return scored.where(F.col("p_toxic") < chain.reject).select("rest.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints within three bits, or five-word shingles alike by 0.8."""
    return keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that smaller documents have too; the other texts stay byte for byte."""
    out = remove_repeats(docs, window=13, keep_columns=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("rest").getField("text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("rest").getField("n_chars"))}
    return out.select(*[changed.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which benchmark windows cover a twentieth or more."""
    out = contamination(docs, table(spark, sf_dir, "benchmark"), keep_columns=True)
    return out.where(~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))).select("rest.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return pack_documents(docs, capacity=2048, per_source=4).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("substring_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: No SQL has the trained models of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = new_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
