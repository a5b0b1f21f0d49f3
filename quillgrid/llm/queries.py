"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import balance, decontam, langid, licences, mainext, merkle, neardup, packing, passages, pii, tokencount, turns, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; profiles come from the labelled ones that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    profiles = langid.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    asked = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return langid.identify(asked, profiles).drop("text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of unigram tokens of all documents."""
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of the shingles of a benchmark item, with the items."""
    return decontam.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all documents."""
    docs = _table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(spark, docs)).drop("body")


def op5_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, with the terms that disclose it."""
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets overlap by at least 85 in 100."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), threshold=85)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return mainext.extract(_table(spark, sf_dir, "pages"))


def op8_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of all documents and of their edited texts."""
    return merkle.fingerprints_with_edits(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents."""
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces of at most 1024 tokens, packed into few sequences."""
    return packing.best_fit(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repairs of all conversations after damage to their turns."""
    return turns.repaired_after_damage(_table(spark, sf_dir, "conversations"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 16 whitened components of all embeddings."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces in unpadded sequences of levelled attention cost."""
    pieces = balance.balanced(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_cost")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_counts": op2_token_counts,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_license_scans": op4_license_scans,
    "op5_pii_sanitisation": op5_pii_sanitisation,
    "op7_html_extraction": op7_html_extraction,
    "op8_merkle_fingerprints": op8_merkle_fingerprints,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_cost_balanced_packing": op13_cost_balanced_packing,
}
ORACLES: dict[str, str] = {
    "op3_benchmark_decontamination": decontam.ORACLE,
}
