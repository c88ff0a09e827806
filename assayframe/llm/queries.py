"""Registered queries of the document operators; ORACLES has their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hard_negatives, lines, near_dedup, oracles, packing, pieces, pii, prefix_trie, quality, substring, suffix_array, token_counts, token_store


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.byte_dedup(documents(spark, sf_dir)).drop("kept_text")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_tokens(documents(spark, sf_dir))
    return token_store.token_digest(token_store.read_tokens(spark, path))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), key="assay-2024")
    count = lambda kind: F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long")
    kinds = [count(k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"), *kinds, F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.expr("n_hit > 0 AND 20 * n_hit >= n_words")
    items = F.size("item_ids").cast("long").alias("n_items")
    return out.select("doc_id", "n_words", "n_hit", items, F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), hit.alias("contaminated"))


def near_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of op4's operator: items that a document holds nearly, within three words."""
    out = decontam.contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=3)
    return out.select("doc_id", F.size("near_ids").cast("long").alias("n_near"), F.array_join("near_ids", ",").alias("near_ids"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle=2)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_template_lines", "n_dropped", "copied", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(documents(spark, sf_dir)).drop("kept_text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), carry=["doc_id"]).drop("distance2")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_token_store, op3_pii_surrogates, op4_decontamination, near_contamination, op5_near_dedup, op6_line_dedup, op7_token_counts, op8_best_fit_packing, op9_substring_dedup, op10_quality_rules, op11_hard_negatives, op12_sentencepiece, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op4_decontamination": oracles.contamination_sql(), "op6_line_dedup": oracles.line_sql(), "op10_quality_rules": oracles.quality_sql(), "op11_hard_negatives": oracles.negatives_sql(), "op13_prefix_trie": oracles.trie_sql()}
