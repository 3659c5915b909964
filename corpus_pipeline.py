"""Corpus preparation from raw documents to token shards, stage by stage.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``.  No stage minds further columns, whatever their names, or an empty table;
what each does with nulls, empty and repeated texts is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.functions.names import spare
from lorespark.llm import decontaminate, language, mixing, queries, simhash
from lorespark.llm.common import Scratch, scratch_scope


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the machines know are rejected: null texts, texts without a letter, and those of a low score.

    The machines learn every labelled language of ``docs``; repeated rows are judged alike.
    """
    names = spare(docs.columns, "lang_pred", "score")
    return language.accept(spark, docs, names=tuple(names)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Texts without words are one group; of rows that repeat an id within a group one stays.
    """
    return simhash.keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go; null and empty texts contain none, and repeated rows go or stay together."""
    return decontaminate.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is one like any other, and a source without words gives none."""
    return mixing.mixture(spark, docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, digested from what is read back: a row for each row of ``docs``, of one end id if its text is null or empty."""
    return queries.tokens(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Linear machines, fingerprints, hashes and tokenizers aren't SQL; the tests hold ``run`` against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote goes once the next one has read it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with scratch_scope():
            after = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return docs


query = run
