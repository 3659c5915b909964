"""Property-graph operators: upserts, merges, traversal, components, cluster edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.operators.tables import drop, saved


def undirected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Both directions of every edge, distinct."""
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b), F.col(a))).distinct()


def unordered_pairs(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct pairs without direction; loops are dropped."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def bfs(spark: SparkSession, edges: DataFrame, start: DataFrame, most_hops: int, most_nodes: int | None = None) -> DataFrame:
    """``node`` and ``hop`` of what is reached from ``start`` (column ``node``), breadth first.

    With ``most_nodes`` the first ones by hop, then by node, are kept.
    """
    both = saved(spark, undirected(edges))
    seen = saved(spark, start.select("node").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, most_hops + 1):
        near = both.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = saved(spark, near.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if most_nodes is not None and seen.count() >= most_nodes:
            break
    return seen if most_nodes is None else seen.orderBy("hop", "node").limit(most_nodes)


class _Looked:
    """Neighbours of one node at a time, out of a table that is sorted by node."""

    def __init__(self, both: DataFrame):
        self.both = both

    def get(self, node, _) -> list:
        return [r.b for r in self.both.where(F.col("a") == node).select("b").collect()]


def dfs(edges: DataFrame, start, most_nodes: int, most_edges: int = 1_000_000) -> list:
    """Depth-first order from one node, smaller neighbours first, marked when visited.

    Sequential by its nature.  Up to ``most_edges`` edges are collected; of a larger graph
    the neighbours of each visited node are looked up as it is reached, ``most_nodes`` times.
    """
    both = undirected(edges)
    rows = both.limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        both = saved(edges.sparkSession, both.repartitionByRange("a").sortWithinPartitions("a"))
        near = _Looked(both)
    else:
        near = {}
        for a, b in rows:
            near.setdefault(a, []).append(b)
    out, seen, stack = [], set(), [start]
    while stack and len(out) < most_nodes:
        node = stack.pop()
        if node not in seen:
            seen.add(node)
            out.append(node)
            stack += sorted((n for n in near.get(node, ()) if n not in seen), reverse=True)
    return out


#: Edges of a graph whose components one task finds.
ONE_TASK_EDGES = 1 << 20


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a small graph of edges between ``u`` and ``v``, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def _in_one_task(batches):
    held = [b for b in batches if b.num_rows]
    if held:
        found = least_nodes(*(np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("u", "v")))
        kind = held[0].schema.field("u").type
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in found], ["u", "v"])


def components(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest node; a node without an edge is its own.

    Alternating star rounds: every node's neighbours are tied to the least around it, above
    it first and then below it, until nothing changes.  The rounds are few (logarithmic in
    the longest path), and each writes at most one edge a node.  A graph of up to
    ``ONE_TASK_EDGES`` edges takes one task in place of rounds.
    """
    now = saved(spark, unordered_pairs(edges).select(F.col("b").alias("u"), F.col("a").alias("v")))
    mark = lambda frame: tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1_000_003)), F.max(F.xxhash64("u", "v"))).first())
    before = mark(now)
    if before[0] <= ONE_TASK_EDGES:
        now, before = now.coalesce(1).mapInArrow(_in_one_task, now.schema), (0,)
    while before[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, saved(spark, tied.union(low.select("u", "m")).distinct())
        drop(last)
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def is_connected(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> bool:
    """Whether the subgraph that the nodes induce is connected."""
    inside = semi_both(edges, nodes)
    return components(spark, nodes, inside).select("component").distinct().limit(2).count() <= 1


def semi_both(edges: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges with both ends among the nodes."""
    for end in (a, b):
        edges = edges.join(nodes.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return edges


def select_explicit(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Wanted keys that are known; an error if none is."""
    found = wanted.join(known.select(key).distinct(), key, "left_semi").distinct()
    if found.isEmpty():
        raise ValueError("none of the wanted keys is known")
    return found


def find_or_make(wanted: DataFrame, articles: DataFrame) -> DataFrame:
    """The article of each wanted ``name``, by its name or else its id in any case: ``name``, ``article_id``, ``placeholder``.

    Of several the first id counts; a name without any gets a placeholder whose id is the name.
    """
    asked = wanted.select("name").distinct().withColumn("key", F.lower(F.trim("name")))
    known = articles.select(F.lower("name").alias("key"), "article_id", F.lit(0).alias("way")).unionByName(articles.select(F.lower("article_id").alias("key"), "article_id", F.lit(1).alias("way")))
    best = known.groupBy("key").agg(F.min(F.struct("way", "article_id")).alias("b"))
    found = asked.join(best, "key", "left")
    return found.select("name", F.coalesce("b.article_id", "name").alias("article_id"), F.col("b").isNull().alias("placeholder"))


def upsert(state: DataFrame, delta: DataFrame, key: list[str], merge: str = "fill") -> DataFrame:
    """State with the delta's rows put over it by key.

    ``fill`` keeps the old value where the new one is null, ``overwrite`` takes the
    delta's rows whole.  The delta has one row for each key.
    """
    if merge == "overwrite":
        return state.join(delta.select(*key), key, "left_anti").unionByName(delta.select(state.columns))
    joined = state.alias("s").join(delta.alias("d"), key, "full_outer")
    rest = [c for c in state.columns if c not in key]
    return joined.select(*key, *(F.coalesce(F.col(f"d.{c}"), F.col(f"s.{c}")).alias(c) for c in rest))


def merge_edges(mentions: DataFrame, key: list[str], chunk: str = "chunk_id", confidence: str = "confidence") -> DataFrame:
    """One edge for each key: highest confidence, and the distinct chunks in order."""
    return mentions.groupBy(*key).agg(F.max(confidence).alias("confidence"), F.array_sort(F.collect_set(chunk)).alias("chunk_ids"))


def merge_links(links: DataFrame, key: list[str], order: Column, fields: list[str]) -> DataFrame:
    """Reference edges: the last one's fields, and all chunks of all links put together, repeats included."""
    last = [F.max_by(f, order).alias(f) for f in fields]
    chunks = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("chunk_ids")))), lambda x: x["chunk_ids"])).alias("chunk_ids")
    return links.groupBy(*key).agg(*last, chunks)


def upsert_keywords(mentions: DataFrame, order: Column) -> DataFrame:
    """Last category of each word; its original words only replaced by ones that aren't empty."""
    filled = F.when(F.size("original_words") > 0, order)
    return mentions.groupBy("word").agg(F.max_by("category", order).alias("category"), F.max_by("original_words", filled).alias("original_words"))


def delete_article(article: str, has_keyword: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and keywords after an article is gone: only keywords that nothing else has go with it."""
    left = has_keyword.where(F.col("article_id") != article)
    touched = has_keyword.where(F.col("article_id") == article).select("word").distinct()
    orphans = touched.join(left.select("word").distinct(), "word", "left_anti")
    return left, keywords.join(orphans, "word", "left_anti")


def roots(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """Nodes that are no one's child."""
    return nodes.join(children.select(F.col("child").alias("node")).distinct(), "node", "left_anti")


def tree_paths(spark: SparkSession, edges: DataFrame, start: DataFrame, most_depth: int = 10) -> DataFrame:
    """``node``, ``depth`` and ``path`` from the roots downwards (columns ``parent``, ``child``)."""
    level = start.select("node", F.lit(0).alias("depth"), F.col("node").cast("string").alias("path"))
    out = level
    for depth in range(1, most_depth + 1):
        level = saved(spark, level.join(edges, level["node"] == edges["parent"]).select(F.col("child").alias("node"), F.lit(depth).alias("depth"), F.concat_ws("/", "path", F.col("child").cast("string")).alias("path")))
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def classify_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges with the cluster of both ends, and whether they stay inside one (columns ``a``, ``b``; ``node``, ``cluster``)."""
    ends = edges.join(clusters.select(F.col("node").alias("a"), F.col("cluster").alias("cluster_a")), "a").join(clusters.select(F.col("node").alias("b"), F.col("cluster").alias("cluster_b")), "b")
    return ends.withColumn("kind", F.when(F.col("cluster_a") == F.col("cluster_b"), "intra").otherwise("inter"))


def cluster_relations(edges: DataFrame, most_predicates: int = 3) -> DataFrame:
    """One relation for each unordered pair of clusters: count, first predicates in order, highest confidence."""
    inter = edges.where("kind = 'inter'").withColumns({"x": F.least("cluster_a", "cluster_b"), "y": F.greatest("cluster_a", "cluster_b")})
    return inter.groupBy("x", "y").agg(
        F.count("*").alias("n_edges"), F.concat_ws(", ", F.slice(F.array_sort(F.collect_set("predicate")), 1, most_predicates)).alias("predicates"), F.max("confidence").alias("confidence")
    )


def counts_of(edges: DataFrame, a: str = "a") -> DataFrame:
    """Number of distinct nodes at the other end of each node ``a`` (``a``, ``n``)."""
    return edges.distinct().groupBy(a).agg(F.count("*").alias("n"))


def with_counts(nodes: DataFrame, key: str, edges: dict[str, DataFrame]) -> DataFrame:
    """Every node with the number of its edges of each kind, 0 where it has none; ``edges`` have the column ``key``."""
    for name, own in edges.items():
        counts = own.groupBy(key).agg(F.count("*").alias(name))
        nodes = nodes.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return nodes


def by_chunk(edges: DataFrame, chunks: str = "chunk_ids") -> DataFrame:
    """Number of edges of each source chunk; those without one are together."""
    flat = edges.select(F.explode_outer(chunks).alias("chunk_id")).select(F.coalesce("chunk_id", F.lit("(no chunk)")).alias("chunk_id"))
    return flat.groupBy("chunk_id").agg(F.count("*").alias("n"))


def edges_of_clusters(classified: DataFrame) -> DataFrame:
    """Edges by ``cluster``: one inside a cluster is its own, one between two is listed with both."""
    ends = F.when(F.col("kind") == "intra", F.array("cluster_a")).otherwise(F.array("cluster_a", "cluster_b"))
    return classified.withColumn("cluster", F.explode(ends))


def cross_relations(classified: DataFrame, order: list[str], articles: str = "article_id", most_predicates: int = 3, most_triples: int = 5) -> DataFrame:
    """One relation for each unordered pair of clusters, as its edges come in the order given.

    ``source`` and ``target`` are the clusters of the first edge; ``predicate`` has the
    first distinct predicates and ``description`` the first triples; ``confidence`` is the
    highest, ``articles`` are put together, and ``n_edges`` counts the edges.
    """
    inter = classified.where("kind = 'inter'").withColumns({"x": F.least("cluster_a", "cluster_b"), "y": F.greatest("cluster_a", "cluster_b"), "o": F.struct(*order)})
    first = inter.groupBy("x", "y").agg(F.min_by(F.struct("cluster_a", "cluster_b"), "o").alias("d"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(articles)).alias("articles"), F.count("*").alias("n_edges"))
    run = Window.partitionBy("x", "y").orderBy("o")
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("o", c))), lambda r: r["v"])
    named = inter.groupBy("x", "y", F.col("predicate").alias("v")).agg(F.min("o").alias("o")).withColumn("k", F.row_number().over(run)).where(F.col("k") <= most_predicates)
    predicates = named.groupBy("x", "y").agg(F.array_join(ordered("v"), ", ").alias("predicate"))
    triple = F.concat_ws(" ", F.col("a").cast("string"), "predicate", F.col("b").cast("string")).alias("v")
    triples = inter.withColumn("k", F.row_number().over(run)).where(F.col("k") <= most_triples).select("x", "y", "o", triple)
    described = triples.groupBy("x", "y").agg(F.array_join(ordered("v"), "; ").alias("description"))
    joined = first.join(predicates, ["x", "y"]).join(described, ["x", "y"])
    return joined.select(F.col("d.cluster_a").alias("source"), F.col("d.cluster_b").alias("target"), "predicate", "description", "confidence", "articles", "n_edges")


def reached_of(seen: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted nodes that were reached, and those that weren't (columns ``node``)."""
    ids = wanted.select("node")
    return ids.intersect(seen.select("node")), ids.subtract(seen.select("node"))
