"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, html, metric_tree, near_duplicates, passages, periodic_runs, pii, pitman_yor, quality_model, quality_rules, sharding, vector_codes
from .common import table


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op2_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    got = quality_model.classify(docs, table(spark, sf_dir, "labels"), keep=["doc_id", "source", "lang"])
    return got.select("doc_id", "source", "lang", "junk_probability", "toxic_probability", "rejected", (~F.col("rejected")).alias("kept"))


def op4_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.leaks(docs, table(spark, sf_dir, "benchmark"))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    got = quality_rules.apply_rules(docs, table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"), pii.key_of(spark))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.search(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.looped(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_delta_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_dart_minhash, op2_tree_bpe, op3_site_quality, op4_seeded_alignment, op5_pitman_yor, op6_controlled_rules, op7_hash_tree_shards, op8_feistel_pseudonyms, op9_repeated_passages, op10_template_text, op11_metric_tree, op12_periodic_runs, op13_delta_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op6_controlled_rules": quality_rules.SQL, "op7_hash_tree_shards": sharding.SQL, "op11_metric_tree": metric_tree.SQL, "op13_delta_codes": vector_codes.SQL}
