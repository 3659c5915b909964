"""Intents of phrases by similarity to reference phrases, and typed values out of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text, vectors
from lorespark.operators import retrieval

# Schemas of what a model is asked for.
EXPENSE = "amount decimal(12,2), currency string, category string, description string, date string, account string"
TRANSFER = "amount decimal(12,2), currency string, from_account string, to_account string, date string"
DEPOSIT = "amount decimal(12,2), currency string, account string, source string, date string"
TASK = "text string, priority string, due string, people array<string>, status string"


def references(phrases: DataFrame) -> DataFrame:
    """Unit mean vector of each intent's phrases (``intent``, ``phrase``)."""
    embedded = phrases.withColumn("v", vectors.character_embedding(F.col("phrase")))
    return retrieval.centroids(embedded, "intent", "v").withColumn("centroid", vectors.unit(F.col("centroid")))


def classify(spark: SparkSession, phrases: DataFrame, known: DataFrame, least: float = 0.35) -> DataFrame:
    """``phrase_id``, ``best``, ``score``, ``label`` (null if unknown) and ``confidence`` of ``phrase``."""
    embedded = phrases.withColumn("v", vectors.character_embedding(F.col("phrase")))
    return retrieval.classify(spark, embedded, known, "intent", least, "phrase_id", "v")


def dispatch(label: str | None, handlers: dict[str, Callable], *args, fallback: Callable | None = None):
    """Calls the handler of an intent; an unknown one goes to the fallback."""
    handler = handlers.get(label, fallback)
    if handler is None:
        raise KeyError(f"no handler for {label!r}; there are: {', '.join(sorted(handlers))}")
    return handler(*args)


def extracted(answer: Column, schema: str) -> Column:
    """Rows of a schema out of a model's answer; null if it holds no JSON."""
    return F.from_json(text.repaired_json(answer), f"array<struct<{schema}>>")
