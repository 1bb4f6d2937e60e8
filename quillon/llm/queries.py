"""The registered queries of the training-data operators: whole tables, production parameters, digests of the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, media, mixing, quality_cnn, quality_rules, secrets, url_filter
from .simhash import near_duplicates
from .substring_dedup import substring_dedup
from .util import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express."""
    return op3_quality_rules(spark, sf_dir).drop("kept", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), radius=4, shingle=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.from_media(media.to_media(table(spark, sf_dir, "documents", "doc_id", "text")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can express."""
    return op5_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _base_columns():
    count = lambda name: F.size(F.filter("base", lambda s: s["name"] == name)).cast("long").alias(f"n_{name}")
    return count("assign"), count("access"), count("hex"), F.sha2(secrets.joined("base"), 256).alias("base_sha256")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", *_base_columns(), secrets.joined("spans").alias("spans"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can express."""
    return secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", *_base_columns())


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def queries():
    ops = (op1_substring_dedup, op2_bpe, op3_quality_rules, op4_simhash, op5_media, op6_mixing, op7_html_text, op8_url_filter, op9_secrets, op10_quality_cnn, quality_counts, media_payload, secrets_base)
    return {f.__name__: f for f in ops}


def oracle_sql():
    from . import oracles

    return {k: v for k, v in vars(oracles).items() if k in queries()}
