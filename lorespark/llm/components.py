"""Connected components of an edge table, without leaving the cluster.

Alternating large-star and small-star rounds: every round is a pre-aggregated
minimum per node and a join, both of which Spark can split when a node is hot.
Edges are written to the shared folder after each round, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or tied to just one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("tied"), F.lit(0).alias("centre"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("tied"), F.lit(1).alias("centre")))
    return ends.groupBy("x").agg(F.sum("tied").alias("tied"), F.max("centre").alias("centre")).where("tied + centre > 1").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Label of every node that has an edge: columns ``node`` and ``root`` (the smallest node).

    ``edges`` has integer columns ``u`` and ``v``; loops, nulls and repeated edges are
    allowed.  The roots themselves are listed too.
    """
    now = scratch.save(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    while not _stars(now):
        # large star: every neighbour above a node is tied to the least one around it
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: lower neighbours and the node itself are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = scratch.save(small, "edges")
        scratch.drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
