"""The corpus pipeline: quality rules, SimHash near-dedup, secret scans, mixing, BPE. Each stage calls its operator in quillon.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, jaccard, mixing, quality_rules, secrets
from quillon.llm.util import discard, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, all columns as they were. Rows that share a null doc_id and rows that repeat an id are judged by their own text."""
    trees = quality_rules.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_rules.keep(docs, trees)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that Jaccard similarities of 0.8 or more over five-word shingles join, proposed by SimHash and by shared rare shingles: a row of the group's smallest doc_id (of several such rows, the least fingerprint and text hash)."""
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark; n_chars, where docs has it, is the new text's length."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, whole."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens and decoded (the text that the ids give again) of each document."""
    return bpe.encode_and_decode(docs)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("secret scan", secret_scan), ("mixing", mixture), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
            if before:
                discard(before)  # the stage after it is written whole
            before = docs
    return docs
