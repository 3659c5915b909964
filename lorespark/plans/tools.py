"""Tools of an assistant, one function each, over the tables of a session.

A tool takes the session's tables by name and its own arguments, and returns a DataFrame
(or, for edits, the changed notes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import vectors
from lorespark.operators import acl, blocks, clustering, concepts, graph, notes, retrieval, topics
from lorespark.plans.dag import Registry

TOOLS = Registry("tool")


@TOOLS.register("parse_document")
def parse_document(t: dict[str, DataFrame], markdown: bool = False) -> DataFrame:
    return blocks.html_blocks(t["files"], "text", markdown)


@TOOLS.register("build_tree")
def build_tree(t) -> DataFrame:
    return clustering.summary_tree(t["chunks"], clustering.character_vector)


@TOOLS.register("search")
def search(t, spark: SparkSession, queries: list[str], k: int = 10) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate(queries, -len(queries))), "vec_id long, phrase string").withColumn("embedding", vectors.character_embedding(F.col("phrase")))
    return retrieval.fuse(retrieval.knn(spark, t["points"], asked, k)).orderBy(F.desc("weighted"), "vec_id")


@TOOLS.register("build_concepts")
def build_concepts(t, least: float = 0.75) -> tuple[DataFrame, DataFrame]:
    return concepts.build(t["members"], t["edges"], least)


@TOOLS.register("expand_concepts")
def expand_concepts(t, spark, direct: float = 0.85, candidate: float = 0.7) -> DataFrame:
    return concepts.expand(spark, t["words"], t["concepts"], direct, candidate)


@TOOLS.register("dry_run")
def dry_run(t) -> DataFrame:
    return concepts.dry_run(t["keywords"])


@TOOLS.register("inspect_concept")
def inspect_concept(t) -> DataFrame:
    return concepts.inspect(t["concepts"], t["has_keyword"])


@TOOLS.register("list_articles")
def list_articles(t) -> DataFrame:
    counts = t["has_keyword"].groupBy("article_id").agg(F.countDistinct("word").alias("keywords"))
    refs = t["references"].groupBy("article_id").agg(F.count("*").alias("refs"))
    zero = {"keywords": 0, "refs": 0}
    return t["articles"].join(counts, "article_id", "left").join(refs, "article_id", "left").na.fill(zero).withColumn("has_summary", F.coalesce(F.trim("summary") != "", F.lit(False)))


@TOOLS.register("similar_articles")
def similar_articles(t, part: str, most: int = 5) -> DataFrame:
    hit = F.contains(F.lower("article_id"), F.lit(part.lower())) | F.contains(F.lower("name"), F.lit(part.lower()))
    return t["articles"].where(hit).orderBy("article_id").limit(most)


@TOOLS.register("list_concepts")
def list_concepts(t, domain: str | None = None, article: str | None = None) -> DataFrame:
    return concepts.list_concepts(t["concepts"], domain, article)


@TOOLS.register("walk")
def walk(t, spark, start: str, most: int = 20, hops: int = 5) -> DataFrame:
    return graph.bfs(spark, t["references"].select(F.col("article_id").alias("a"), F.col("target").alias("b")), spark.createDataFrame([(start,)], "node string"), hops, most)


@TOOLS.register("train_topics")
def train_topics(t, k: int = 10) -> DataFrame:
    return topics.model(t["documents"], k)


@TOOLS.register("topic_sizes")
def topic_sizes(t) -> DataFrame:
    return topics.sizes(t["topics"])


@TOOLS.register("vault_tasks")
def vault_tasks(t, **conditions) -> DataFrame:
    return notes.filter_tasks(t["tasks"], **conditions)


@TOOLS.register("vault_search")
def vault_search(t, query: str) -> DataFrame:
    return notes.filter_tasks(t["tasks"], query=query)


@TOOLS.register("vault_stats")
def vault_stats(t) -> DataFrame:
    return notes.status_counts(t["tasks"])


@TOOLS.register("vault_wellness")
def vault_wellness(t, last: int = 7) -> DataFrame:
    return notes.wellness_footer(t["days"], last)


@TOOLS.register("add_task")
def add_task(t, section: str, line: str) -> DataFrame:
    return notes.append_to_section(notes.lines(t["notes"]), section, [line])


@TOOLS.register("update_task")
def update_task(t, part: str, old: str, new: str) -> DataFrame:
    return notes.change_first_task(notes.lines(t["notes"]), part, lambda c: F.replace(c, F.lit(old), F.lit(new)))


@TOOLS.register("delete_task")
def delete_task(t, part: str) -> DataFrame:
    return notes.change_first_task(notes.lines(t["notes"]), part)


@TOOLS.register("check_access")
def check_access(t) -> DataFrame:
    return acl.can(t["checks"], t["rules"], t["roles"])
