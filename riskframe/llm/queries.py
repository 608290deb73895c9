"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import bpe, conv_repair, decontam, exact_dedup, filter_audit, id_records, license_scan, line_dedup, near_dedup, pii, substring_dedup, toxicity, url_filter
from riskframe.llm.common import load

# The key of the pseudonyms is the session's; the default is for tests.
PII_KEY_CONF, PII_TEST_KEY = "spark.riskframe.pii.key", "corpus-key-1"
MIN_SITES = 10
END_ID = 2


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(load(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(load(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, spark.conf.get(PII_KEY_CONF, PII_TEST_KEY)).drop("found")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_spread_lines(docs, min_sites=MIN_SITES).select("doc_id", "text", "n_lines", "n_removed")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_repeats(load(spark, sf_dir, "documents")).drop("th")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(load(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort_dedup(load(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_repair.repair_conversations(conv_repair.damaged(load(spark, sf_dir, "conversations")))


def op13_id_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = id_records.write_records(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID)
    return id_records.read_digests(manifest).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_license_scan": op2_license_scan,
        "op3_decontamination": op3_decontamination,
        "op4_bpe": op4_bpe,
        "op5_pii": op5_pii,
        "op6_line_dedup": op6_line_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_near_dedup": op9_near_dedup,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_id_records": op13_id_records,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_line_dedup": line_dedup.ORACLE,
        "op9_near_dedup": near_dedup.ORACLE,
        "op10_exact_dedup": exact_dedup.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE,
    }
