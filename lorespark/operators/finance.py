"""Expenses: ranges, summaries, and the account that a phrase means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import vectors
from lorespark.operators.automata import contained
from lorespark.operators.tables import saved
from lorespark.operators.vector_index import VectorIndex

MONEY = "decimal(12,2)"


def select_range(rows: DataFrame, user, start=None, end=None, category: str | None = None, day: str = "day") -> DataFrame:
    """A user's rows, optionally of a range of days and a category, newest first."""
    out = rows.where(F.col("user_id") == user)
    for value, keep in ((start, lambda v: F.col(day) >= F.lit(v).cast("date")), (end, lambda v: F.col(day) <= F.lit(v).cast("date")), (category, lambda v: F.col("category") == v)):
        if value is not None:
            out = out.where(keep(value))
    return out.orderBy(F.desc(day), F.desc("created"))


def summary(rows: DataFrame) -> DataFrame:
    """Number and sum of each category and currency, with the currency's whole sum."""
    sums = rows.groupBy("category", "currency").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast(MONEY)).alias("total"))
    return sums.withColumn("grand_total", F.sum("total").over(Window.partitionBy("currency")))


def resolve_accounts(queries: DataFrame, accounts: DataFrame, synonyms: DataFrame, default: str | None = None, least: float = 0.45) -> DataFrame:
    """The account of each ``query``: ``account_id``, ``name``, ``confidence`` and ``how``.

    The first that fits of: a synonym, the very name, the query inside a name (one hit, or
    the shortest of many), the longest name inside the query, the most similar name, and
    the default.  Synonyms and very names are joined by equality; only queries without
    either are searched, in names and for names, by an automaton each, and by the nearest
    vector of a name; nothing is set beside every account.
    """
    q = queries.select("query").distinct().withColumn("_q", F.lower(F.trim("query")))
    a = accounts.select(F.col("id").alias("account_id"), "name", F.lower(F.trim("name")).alias("_name"))
    named = synonyms.select(F.lower("word").alias("_q"), F.lower("name").alias("_name")).join(a, "_name")
    out = ["query", "account_id", "name", "confidence", "how", "_step", "_order", "_id"]

    def found(frame: DataFrame, how: str, confidence, step: int, order) -> DataFrame:
        return frame.withColumns({"confidence": confidence, "how": F.lit(how), "_step": F.lit(step), "_order": order.cast("long"), "_id": by_id}).select(out)

    by_id = F.col("account_id").cast("long")
    none = F.lit(0)
    without = lambda left, right: left.join(right.select("query"), "query", "left_anti")
    synonym, exact = q.join(named, "_q"), q.join(a, F.col("_q") == F.col("_name"))
    left = without(without(q, synonym), exact)
    spark = queries.sparkSession
    names = a.select(F.col("_name").alias("pattern")).distinct()
    asked = left.select("_q").distinct()
    # both ways by automata: what is asked inside names, and names inside what is asked
    in_names = contained(spark, names.withColumnRenamed("pattern", "_name"), asked, key="_name", text="_name", pattern="_q").select(F.col("pattern").alias("_q"), "_name")
    in_asked = contained(spark, asked, names, key="_q", text="_q").select("_q", F.col("pattern").alias("_name"))
    inside = left.join(in_names, "_q").join(a, "_name").withColumn("_hits", F.count("*").over(Window.partitionBy("query")))
    around = left.join(in_asked, "_q").join(a, "_name")
    # only what no plainer step finds is embedded
    rest = saved(spark, without(without(left, inside), around).select("query", F.monotonically_increasing_id().alias("_row"), vectors.character_embedding(F.col("_q")).alias("embedding")))
    near = spark.createDataFrame([], "_row long, account_id long, _sim double")
    if not rest.isEmpty():
        hits, _ = VectorIndex.build(spark, saved(spark, account_vectors(accounts)), "id").nearest(rest, 1, "_row", skip_self=False)
        near = hits.where(F.col("score") >= least).select(F.col("query_id").alias("_row"), F.col("id").alias("account_id"), F.col("score").alias("_sim"))
    similar = rest.select("query", "_row").join(near, "_row").join(a, "account_id")
    default_rows = a.where(F.col("_name") == F.lower(F.lit(default))) if default else a.orderBy("account_id").limit(1)
    steps = [
        found(synonym, "synonym", F.lit(1.0), 1, none),
        found(exact, "exact", F.lit(1.0), 2, none),
        found(inside, "part", F.when(F.col("_hits") == 1, 0.8).otherwise(0.6), 3, F.length("name")),
        found(around, "whole", F.lit(0.5), 4, -F.length("name")),
        found(similar, "similar", F.col("_sim"), 5, F.round(-F.col("_sim") * 1_000_000)),
        found(left.join(F.broadcast(default_rows)), "default", F.lit(0.3), 6, none),
    ]
    every = reduce(DataFrame.union, steps)
    best = every.groupBy("query").agg(F.min_by(F.struct("account_id", "name", "confidence", "how"), F.struct("_step", "_order", "_id")).alias("b"))
    return best.select("query", "b.*")


def account_vectors(accounts: DataFrame) -> DataFrame:
    """``id``, ``name`` and ``embedding`` of every account's name, as similar names are searched by."""
    return accounts.select("id", "name", vectors.character_embedding(F.lower(F.trim("name"))).alias("embedding"))
