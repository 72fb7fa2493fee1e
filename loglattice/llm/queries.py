"""Queries over the driver's tables, one for each training-data operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact, mixing, packing, pii, quality, simhash, suffix, tokens, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = quality.classify(docs.select("doc_id", "text"), quality.fitted(docs, labels))
    return scored.where("p_clean >= 0.5").select("doc_id", "p_clean", "p_toxic")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to given weights."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), targets=mixing.TARGETS, other=mixing.OTHER, copy_col="copy").select("doc_id", "source", "copy")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the files written."""
    return warc.write_warc(_table(spark, sf_dir, "pages"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.fitted(docs))


_ALL = (op1_quality_classifier, op2_token_counts, op3_best_fit_packing, op4_exact_dedup, op5_suffix_array_dedup, op6_embedding_near_dedup, op7_mix_sources, op8_warc, op9_simhash_near_dedup, op10_pii)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES = {"op4_exact_dedup": exact.EXACT_SQL, "op7_mix_sources": mixing.MIX_SQL}
