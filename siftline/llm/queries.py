"""Queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftline.llm import quality_rules as rules
from siftline.llm.best_fit_packing import best_fit_packing
from siftline.llm.common import read_documents
from siftline.llm.context_mixing import score_texts
from siftline.llm.direct_access_codes import token_id_roundtrip
from siftline.llm.licence_scan import scan_licences
from siftline.llm.line_crf import quality_scores
from siftline.llm.order_minhash import order_minhash_report
from siftline.llm.pii_spans import find_pii
from siftline.llm.simhash_dedup import simhash_groups
from siftline.llm.soft_mixing import mixing_rates


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_documents(spark, sf_dir))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash_report(read_documents(spark, sf_dir))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.quality_rules(read_documents(spark, sf_dir)).select("doc_id", *names)


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_documents(spark, sf_dir))


def op8_token_id_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_roundtrip(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read_documents(spark, sf_dir))


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_simhash_dedup, op2_order_minhash, op3_line_crf, op4_soft_mixing, op5_best_fit_packing, op6_quality_rules, op7_context_mixing, op8_token_id_codes, op9_licence_scan, op10_pii_spans)}
ORACLE_SQL: dict[str, str] = {"op6_quality_rules": rules.oracle_sql()}
