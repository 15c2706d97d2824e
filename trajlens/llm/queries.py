"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, license_scan, lm_score, mixing, near_dups, pii, quality_classifier, quality_rules, repeats, sentencepiece, topk, url_filter, whitening
from .common import read
from .sql import DIVERGENCE_SQL, MIXING_SQL, NEAR_DEDUP_SQL, QUALITY_RULES_SQL, REPEATS_SQL, TOPK_SQL


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(read(spark, sf_dir, "documents"), sentencepiece.read_model(spark))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pii.replace_entities(read(spark, sf_dir, "documents"), pii.session_key(spark, pii.TRIAL_KEY), "entity_kinds")
    return df.select("doc_id", "text", F.size("entity_kinds").cast("long").alias("n_entities"), F.array_join("entity_kinds", ",").alias("kinds"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"), lm_score.held_out(F.col("doc_id")))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = near_dups.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)
    return df.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mixing.mixed(read(spark, sf_dir, "documents"))
    return df.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("times")).alias("taken"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules.judge(read(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return df.select("doc_id", *base)


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = whitening.whiten(read(spark, sf_dir, "embeddings"))
    return df.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_sentencepiece, op2_pii, op3_exact_topk, op4_license_scan, op5_lm_score, op6_minhash_near_dedup, op7_quality_classifier, op8_url_filter, op9_mixing, op10_quality_rules, op11_suffix_array_dedup, op12_source_divergence, op13_embedding_whitening)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": TOPK_SQL, "op6_minhash_near_dedup": NEAR_DEDUP_SQL, "op9_mixing": MIXING_SQL, "op10_quality_rules": QUALITY_RULES_SQL, "op11_suffix_array_dedup": REPEATS_SQL, "op12_source_divergence": DIVERGENCE_SQL}
