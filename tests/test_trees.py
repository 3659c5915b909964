"""Trees of large articles, level by level: every node has one parent at most, none is lost, groups are bounded."""

import random
from functools import partial

import numpy as np
from pyspark.sql import functions as F

from lorespark.operators import clustering


def leaves(spark, sizes, dimensions=4, seed=1):
    rng = random.Random(seed)
    rows = [(a, f"{a}{k:06d}", f"Sentence {k} of {a}. More.", [rng.gauss(k % 7, 0.1) for _ in range(dimensions)]) for a, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "article_id string, node_id string, text string, embedding array<double>")


embed = partial(clustering.character_vector, dimensions=4)


def check(rows, sizes, stop=3):
    for article, n in sizes.items():
        own = [r for r in rows if r.article_id == article]
        names = [r.node_id for r in own]
        held = [c for r in own for c in r.children_ids]
        assert len(set(names)) == len(names) and len(set(held)) == len(held) and set(held) <= set(names)
        assert sum(r.level == 0 for r in own) == n
        level_of = {r.node_id: r.level for r in own}
        assert all(level_of[c] == r.level - 1 and len(r.children_ids) >= 2 for r in own if r.level for c in r.children_ids)
        assert n <= stop or max(level_of.values()) >= 1


def test_small_articles_are_as_before_and_large_ones_go_by_level(spark):
    sizes = {"a": 30, "b": 2, "c": 200, "d": 90}
    frame = leaves(spark, sizes)
    mixed = clustering.summary_tree(frame, embed, most=40).collect()
    check(mixed, sizes)
    whole = {r.node_id: r for r in clustering.summary_tree(frame.where("article_id in ('a', 'b')"), embed).collect()}
    assert whole == {r.node_id: r for r in mixed if r.article_id in ("a", "b")}
    again = clustering.summary_tree(frame.repartition(5), embed, most=40).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))


def test_parts_are_bounded_whatever_the_vectors(spark):
    """Nodes that are all alike, and nodes in two far places."""
    frame = leaves(spark, {"a": 700, "b": 300}).withColumn("embedding", F.when(F.col("article_id") == "a", F.array(*[F.lit(1.0)] * 4)).otherwise(F.col("embedding")))
    found = clustering.parted(spark, frame, 20)
    assert found.count() == 1000 and found.select("node_id").distinct().count() == 1000
    assert found.groupBy("article_id", "part").count().agg(F.max("count")).first()[0] <= 20


def test_a_large_article(spark):
    sizes = {"a": 6000}
    rows = clustering.summary_tree(leaves(spark, sizes), embed, most=32, levels=2).collect()
    check(rows, sizes)
    assert np.mean([len(r.children_ids) for r in rows if r.level == 1]) < 6
