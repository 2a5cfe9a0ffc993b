"""The corpus pipeline: quality rules, near-dedup, personal data, mixing, packing.

Each stage takes all that the one before kept, as a written table, and its decisions take effect in the
rows it returns; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftline.llm.best_fit_packing import best_fit_packing
from siftline.llm.common import delete_path, read_documents, scratch, shared_dir
from siftline.llm.pii_spans import redact_pii
from siftline.llm.quality_rules import keep_good
from siftline.llm.simhash_dedup import one_of_each_group
from siftline.llm.soft_mixing import mix
from siftline.session import ship_package

#: Shares of tokens after the quality rules: (toxic,) to target.
TARGETS = {(0,): 0.95, (1,): 0.05}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail them; n_chars is renewed.

    Null and empty texts have no words and go; repeated rows are judged each and stay repeated; very long texts
    are judged whole; an empty table stays empty; columns of any names come back.
    """
    return keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of least doc_id, a null doc_id last.

    Null and empty texts are near-duplicates of one another; of repeated rows one stays; ties go by fingerprint and
    text hash; an empty table stays empty; columns of any names come back.
    """
    ship_package(spark)
    return one_of_each_group(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in the texts; n_chars is renewed. Every row stays, a null text null, an empty one empty."""
    ship_package(spark)
    return redact_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate for the target weights says; equal rows fare alike.

    Null and empty texts have no tokens and a rate by their posterior; an empty table stays empty; columns of any
    names come back.
    """
    ship_package(spark)
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS, ("toxic",))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row for each piece of a document.

    A null or empty text is one piece of the end id alone; repeated rows are packed each; an empty table stays empty;
    columns other than doc_id and text are not read.
    """
    ship_package(spark)
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("personal data", pii_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Several stages (models, near-duplicates, packing) are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written in the shared folder and read again.

    What a stage reads or makes on its way is deleted once its result is written.
    """
    docs, before = read_documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark).rstrip('/')}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
            made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs
