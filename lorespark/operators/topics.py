"""Topics: vectors of word counts, projected and clustered; words, sizes, inference."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import text
from lorespark.functions.names import spare
from lorespark.operators import clustering, density, graph, keywords, projection, retrieval
from lorespark.operators.tables import saved, spread


def model(docs: DataFrame, topics: int = 10, by: str = "doc_id", least_similarity: float = 0.1, words: int = 3, features: int = 1 << 12) -> DataFrame:
    """``doc_id``, ``topic`` (-1 for outliers), ``similarity`` and ``label``, the topic's first words.

    Hashed word weights are clustered by cosine; a document that is less similar than
    ``least_similarity`` to its centre is an outlier, and so is one without words of any
    weight, which takes no part in the clustering.  Of fewer than three texts all are outliers.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(by, "text")).select(by, F.coalesce(text.words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    # texts are cut into words once, for all that follows
    counted = saved(spark, HashingTF(inputCol="w", outputCol="tf", numFeatures=features).transform(rows).drop("w"))
    none = counted.select(by, F.lit(-1).alias("topic"), F.lit(0.0).alias("similarity"), F.lit(None).cast("string").alias("label"))
    # too few texts make no topics: all are outliers
    if counted.where(F.size(F.unwrap_udt("tf")["indices"]) > 0).limit(3).count() < 3:
        return none
    weighted = IDF(inputCol="tf", outputCol="idf").fit(counted).transform(counted)
    marked = Normalizer(inputCol="idf", outputCol="v").transform(weighted).select(by, "v", F.exists(F.unwrap_udt("idf")["values"], lambda x: x > 0).alias("_usable"))
    unit = marked.where("_usable").drop("_usable")
    if unit.limit(3).count() < 3:
        return none
    fitted = KMeans(k=topics, seed=42, featuresCol="v", predictionCol="topic", distanceMeasure="cosine", maxIter=10).fit(unit)
    # a table of centres is joined: small, and bounded by topics and features
    centres = [[float(x) for x in c] for c in fitted.clusterCenters()]
    table = F.broadcast(spark.createDataFrame([(k, c, math.sqrt(sum(x * x for x in c))) for k, c in enumerate(centres)], "topic int, c array<double>, size double"))
    found = fitted.transform(unit).join(table, "topic")
    # only the words that a document has: the others add 0
    v = F.unwrap_udt("v")
    dot = F.aggregate(F.zip_with(v["indices"], v["values"], lambda i, x: x * F.get("c", i)), F.lit(0.0), lambda s, x: s + x)
    scored = found.withColumn("similarity", F.round(F.when(F.col("size") == 0, 0.0).otherwise(dot / F.col("size")), 6))
    topic = F.when(F.col("similarity") >= least_similarity, F.col("topic")).otherwise(-1)
    without = marked.where("not _usable").select(by, F.lit(-1).alias("topic"), F.lit(0.0).alias("similarity"))
    assigned = saved(spark, scored.select(by, topic.alias("topic"), "similarity").union(without))
    return assigned.join(F.broadcast(labels(docs, assigned, by, words)), "topic", "left").select(by, "topic", "similarity", "label")


def density_model(docs: DataFrame, least_size: int = 5, neighbours: int = 3, dimensions: int = 5, by: str = "doc_id", least_documents: int = 2, words: int = 3) -> DataFrame:
    """``by``, ``topic`` (from 0 by size, -1 for outliers) and ``label`` of every document.

    Weighted words and pairs of words are projected, and the projections are clustered by
    density: their number is found, and documents in no dense place are outliers.  Of equal
    sizes the topic with the smaller id comes first.  Fewer than three texts with a common
    word, null and empty texts are outliers; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    points = saved(spark, projection.project(spark, docs, dimensions, by, least_documents))
    every = docs.select(by).distinct()
    if points.limit(3).count() < 3:
        return every.select(by, F.lit(-1).alias("topic"), F.lit(None).cast("string").alias("label"))
    found, _ = density.density_tree(spark, points, density.Settings(least_size, neighbours, 0.0), by)
    found = saved(spark, found.where("not noise").select(by, "cluster"))
    order = Window.orderBy(F.desc("n"), "cluster")  # a row a topic
    numbers = found.groupBy("cluster").agg(F.count("*").alias("n")).select("cluster", (F.row_number().over(order) - 1).cast("int").alias("topic"))
    assigned = saved(spark, found.join(numbers, "cluster").select(by, "topic"))
    out = every.join(assigned, by, "left").select(by, F.coalesce("topic", F.lit(-1)).alias("topic"))
    return out.join(labels(docs, assigned, by, words), "topic", "left").select(by, "topic", "label")


#: Words and pairs of words a label is chosen from.
CANDIDATES = 20


def labels(docs: DataFrame, assigned: DataFrame, by: str = "doc_id", words: int = 3, least_documents: int = 2, diversity: float = 0.3, embed=None) -> DataFrame:
    """The label of each topic: its first words or pairs of words, joined by a bar; topic -1 has none.

    Candidates are those in at least ``least_documents`` documents with the highest
    class-based weight; of them the first is taken, and then those that add most beside
    the ones before (maximal marginal relevance).  ``embed`` maps a text to a vector.
    """
    embed = embed or clustering.character_vector
    # an id that repeats gives its rows every topic it has
    topics = assigned.where("topic >= 0").groupBy(by).agg(F.collect_list(F.col("topic").cast("int")).alias("topics"))
    counts = keywords.counts_by_class(docs.select(by, "text").join(topics, by, "left"), "topics", grams=2)
    # one shuffle by word, which is what all sums need
    words_ = counts.repartition("word").groupBy("word", "topic").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    own = Window.partitionBy("word")
    words_ = words_.withColumns({"df": F.sum("df").over(own), "f": F.sum(F.when(F.col("topic") >= 0, F.col("tf"))).over(own)})
    each = saved(docs.sparkSession, words_.where((F.col("df") >= least_documents) & (F.col("topic") >= 0)).select("word", "topic", "tf", "f"))
    scored = keywords.class_scores(each, each.groupBy("topic").agg(F.sum("tf").alias("n")))
    best = keywords.top_words(scored, CANDIDATES, "topic")

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("rank").to_pylist()
        score = np.array([r["score"] for r in rows])
        chosen = keywords.diverse(np.array([embed(r["word"]) for r in rows]), score / (score.max() or 1.0), words, diversity)
        return pa.table({"topic": pa.array([rows[0]["topic"]], pa.int32()), "label": pa.array([" | ".join(rows[k]["word"] for k in chosen)], pa.string())})

    chosen = best.select(F.col("topic").cast("int").alias("topic"), "word", "score", "rank")
    return chosen.groupBy("topic").applyInArrow(run, "topic int, label string")


def infer(spark: SparkSession, points: DataFrame, centres: DataFrame, least: float = 0.1, by: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """``by``, ``topic`` and ``score`` of new points: the topic with the nearest centre (``topic``, ``centroid``), -1 if none is near."""
    near = retrieval.classify(spark, points, centres, "topic", least, by, vector)
    return near.select(by, F.coalesce(F.col("label").cast("int"), F.lit(-1)).alias("topic"), "score")


def sizes(assigned: DataFrame) -> DataFrame:
    """Documents of each topic; the outliers are topic -1."""
    return assigned.groupBy("topic").agg(F.count("*").alias("n"))


def reassign(spark: SparkSession, assigned: DataFrame, points: DataFrame, least: float = 0.1, by: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """Outliers (topic -1) moved to the topic whose mean vector is nearest, if it is at least so near.

    ``assigned`` has ``by`` and ``topic``, ``points`` has ``by`` and the vector; documents
    without a vector stay where they are.
    """
    joined = assigned.join(points.select(by, vector), by)
    centres = retrieval.centroids(joined.where("topic >= 0"), "topic", vector)
    near = retrieval.classify(spark, joined.where("topic = -1").select(by, vector), centres, "topic", least, by, vector)
    (new,) = spare(assigned.columns, "_near")
    moved = near.select(by, F.col("label").cast("int").alias(new))
    return assigned.join(moved, by, "left").withColumn("topic", F.when(F.col("topic") == -1, F.coalesce(new, F.lit(-1))).otherwise(F.col("topic"))).drop(new)


def upsert(state: DataFrame, found: DataFrame) -> DataFrame:
    """Topics by their number with the found ones over them (``topic``, ``label``)."""
    return graph.upsert(state, found.select(state.columns), ["topic"], "overwrite")


def links(assigned: DataFrame, by: str = "doc_id") -> DataFrame:
    """Edges of documents to their topic; an outlier has none."""
    return assigned.where("topic >= 0").select(by, "topic").distinct()
