"""The thin contract queries opN_<name>: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm import language_id, oracles, pii, quality_trees, secret_scan
from veridex.llm._spark import read
from veridex.llm.decontaminate import contaminated
from veridex.llm.html_extract import main_text
from veridex.llm.jaccard_join import jaccard_components
from veridex.llm.packing import retrieval_packing
from veridex.llm.quality import quality_rules
from veridex.llm.repeats import substring_dedup, suffix_array_dedup
from veridex.llm.spelling import spelling_variants
from veridex.llm.token_alignment import token_alignment


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secret_scan(read(spark, sf_dir, "documents"))
    counts = [secret_scan.counted(k).alias(f"n_{k}") for k in secret_scan.KINDS]
    base = F.sha2(secret_scan.joined(secret_scan.BASE_KINDS), 256).alias("base_sha256")
    return out.select("doc_id", *counts, base, secret_scan.joined(secret_scan.KINDS).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pii_spans(read(spark, sf_dir, "documents"))
    counts = [secret_scan.counted(k).alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(secret_scan.joined(pii.BASE_KINDS, True), 256).alias("base_sha256")
    return out.select("doc_id", *counts, base, secret_scan.joined(pii.KINDS, True).alias("spans"), F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(read(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", F.col("n_all").alias("n_bytes"), "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", F.col("n_all").alias("n_words"), "n_removed", F.col("kept").cast("string").alias("kept_sha256"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = language_id.identify(docs, language_id.fit(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "chars_per_piece", "fallback_share", "entropy")


def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("distance")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = quality_trees.quality_scores(docs, quality_trees.fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", quality_trees.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_pii, op3_suffix_array_dedup, op4_jaccard_join, op5_substring_dedup, op6_html_extract, op7_language_id, op8_quality_rules, op9_retrieval_packing, op10_decontamination, op11_spelling_variants, op12_quality_classifier, op13_token_alignment)}
ORACLES: dict[str, str] = {"op3_suffix_array_dedup": oracles.OP3, "op4_jaccard_join": oracles.OP4, "op5_substring_dedup": oracles.OP5, "op10_decontamination": oracles.OP10, "op11_spelling_variants": oracles.OP11}
