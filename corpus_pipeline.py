"""A training corpus from documents: five stages, each an operator of argusframe.llm over whole texts.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. A text that a stage changes has its
n_chars counted anew. Nulls, empty tables, ties and extra columns: see the operators' docstrings.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe.checkpoints import discard, materialize, scratch
from argusframe.llm import language, line_dedup, near_dedup, packing, pii


def recount(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, where the table has that column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go."""
    return language.keep_recognised(docs, language.train(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them."""
    return recount(line_dedup.dedup_lines(docs).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds."""
    return recount(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that fill training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("pii", hide_personal_data), ("packing", pack)]

#: A trained classifier, minimum hashing and a tokenizer have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch() as held:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            before, docs = docs, materialize(stage(spark, docs, sf_dir), f"corpus-{name}")
            if k:
                discard(before)
        held.pass_on(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
