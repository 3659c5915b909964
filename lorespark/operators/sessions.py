"""Gaps and islands: segments that are merged, and turns of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.names import spare


def islands(rows: DataFrame, by: list[str], order: list[str], gap: Column, most: float) -> DataFrame:
    """Number of the island of each row: a new one begins where ``gap`` to the row before is above ``most``.

    ``gap`` is an expression over ``_prev``, the row before as a struct; ``rows`` must not
    have a column of that name.
    """
    (apart,) = spare([*rows.columns, "_prev"], "_gap")
    run = Window.partitionBy(*by).orderBy(*order)
    marked = rows.withColumn("_prev", F.lag(F.struct("*")).over(run)).withColumn(apart, gap)
    return marked.withColumn("island", F.sum(F.when(F.col(apart) > most, 1).otherwise(0)).over(run).cast("long")).drop("_prev", apart)


def merge_segments(segments: DataFrame, by: list[str], most_gap: float = 0.3) -> DataFrame:
    """Speech segments (``start``, ``end``) with small gaps between them, put together."""
    cut = islands(segments, by, ["start", "end"], F.col("start") - F.col("_prev.end"), most_gap)
    return cut.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
