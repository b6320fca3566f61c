"""The registered queries ``opN_*``: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskgraph.llm import bpe, cotraining, html_extract, licenses, minhash, oracle, packing, pii, pivots, quality_rules, secrets


#: Key of the pseudonyms in the registered query; a deployment passes its own secret.
PII_KEY = "registered-query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_html(table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), want_text=False).drop("masked")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), want_text=False).drop("clean_text")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), want_ids=False).drop("ids")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def base_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op2``."""
    return op2_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def base_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op4``."""
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op6``."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_html_extraction, op2_secret_scan, op3_quality_classifier, op4_license_scan, op5_minhash_dedup,
            op6_quality_rules, op7_embedding_dedup, op8_bpe, op9_pii, op10_packing,
            base_secret_scan, base_license_scan, base_quality_rules,
        )
    }


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
