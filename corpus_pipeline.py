"""From raw documents to packed training windows: five stages, each a table in the shared folder for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from tallyloom.sources.scratch import cut

VOCABULARY = "word_bpe_49k.json"
#: Percent of shared shingles from which on two documents are near copies; op2's own limit is 85.
NEAR_PERCENT = 80


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without letters, or foreign to all of these languages, go.

    Where no document is labelled there is nothing to reject by, and all stay. Null, empty and blank texts go. Repeated rows go or stay
    together; of rows that repeat an id with different texts, or have none, each goes or stays by its own text. Texts are read
    whole, an empty table stays one, and other columns, whatever their names, pass.
    """
    return language_id.keep_known(docs, language_id.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal but for white space.

    The one with the most code points stays, then the smallest id; a row without an id loses every tie, and one of repeated
    rows stays. Null, empty and blank texts are equal to each other. Texts are compared whole.
    """
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near duplicates, the one with the smallest id.

    Rows that repeat an id stay or go together. Rows without an id stay. Null, empty and blank texts are near to nothing and stay.
    """
    return near_dedup.drop_near(docs, percent=NEAR_PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars brought up to date.

    Null texts stay null, with a null n_chars; repeated rows and rows without an id are masked like any other.
    """
    masked = secret_scan.redact(docs, secret_scan.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in windows of 2048; a null or empty text has its end id alone, repeated rows are packed each."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Neither the fitted models nor the library's tokens can be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
