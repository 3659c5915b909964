"""Queries on the embeddings."""

from pyspark.sql import functions as F

from lorespark.functions import vectors
from lorespark.operators import clustering, density, retrieval
from lorespark.operators.vector_index import VectorIndex
from lorespark.plans.registry import query, table

#: Every fiftieth row is a query.
_KNN = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE {asked}),
s AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS score
      FROM embeddings, q WHERE vec_id <> query_id {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
t AS (SELECT * FROM r WHERE rank <= 10)
"""
_ASKED = "vec_id % 50 = 0"
#: Fusion is of the variants of one question, of which there are three.
_VARIANTS = "vec_id IN (0, 1, 2)"


def _search(spark, sf_dir, where="true", asked=_ASKED):
    points = table(spark, sf_dir, "embeddings")
    return retrieval.knn(spark, points.where(where), points.where(asked), 10)


@query(_KNN.format(asked=_ASKED, where="") + "SELECT query_id, vec_id, score, rank FROM t")
def knn_topk(spark, sf_dir):
    return _search(spark, sf_dir)


@query(_KNN.format(asked=_ASKED, where="") + "SELECT query_id, vec_id, score, rank FROM t")
def knn_indexed(spark, sf_dir):
    """The same search through the exact index: only cells that can hold one of the ten are opened."""
    points = table(spark, sf_dir, "embeddings")
    hits, _ = VectorIndex.build(spark, points).nearest(points.where(_ASKED), 10)
    return hits.withColumnRenamed("id", "vec_id")


@query(_KNN.format(asked=_ASKED, where="AND label IN (3, 4, 5)") + "SELECT query_id, vec_id, score, rank FROM t")
def knn_filtered_by_label(spark, sf_dir):
    return _search(spark, sf_dir, "label in (3, 4, 5)")


@query(_KNN.format(asked=_VARIANTS, where="") + "SELECT vec_id, any_value(label) AS label, max(score) AS score, count(*) AS hit_count, round(max(score) * count(*), 6) AS weighted FROM t GROUP BY vec_id")
def retrieval_fusion(spark, sf_dir):
    fused = retrieval.fuse(_search(spark, sf_dir, asked=_VARIANTS)).drop("scores_by_query")
    return fused.join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").select("vec_id", "label", "score", "hit_count", "weighted")


@query(_KNN.format(asked=_ASKED, where="") + "SELECT query_id, count(*) AS hits FROM t GROUP BY query_id")
def retrieval_hits_by_query(spark, sf_dir):
    return retrieval.hits_by_query(retrieval.fuse(_search(spark, sf_dir)))


_CENTROIDS = """
WITH f AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS p FROM embeddings),
m AS (SELECT label, p, avg(x) AS x FROM f GROUP BY label, p),
c AS (SELECT label, list(x ORDER BY p) AS centroid FROM m GROUP BY label)
"""


@query("WITH f AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS place FROM embeddings) SELECT label, place::INTEGER AS place, round(avg(x), 6) AS x FROM f GROUP BY label, place")
def label_centroids(spark, sf_dir):
    means = retrieval.centroids(table(spark, sf_dir, "embeddings"), "label")
    return means.select("label", F.posexplode("centroid").alias("place", "x")).withColumn("x", F.round("x", 6))


_NEAREST = (
    _CENTROIDS
    + """, s AS (SELECT vec_id, c.label::VARCHAR AS best, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS score, c.label AS k FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, k) AS n FROM s)
"""
)


@query(_NEAREST + "SELECT vec_id, best, score, CASE WHEN score >= 0.35 THEN best END AS label, CASE WHEN score >= 0.35 THEN score ELSE round(1 - score, 6) END AS confidence FROM r WHERE n = 1")
def nearest_centroid_classify(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    return retrieval.classify(spark, points, retrieval.centroids(points, "label"), "label")


#: Matching to concepts has a small number in the denominator.
_MATCHED = _NEAREST.replace(
    "list_cosine_similarity(embedding::DOUBLE[], centroid)",
    "list_dot_product(embedding::DOUBLE[], centroid) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(centroid, centroid)) + 1e-8)",
)


@query(_MATCHED + "SELECT vec_id, best, score, CASE WHEN score >= 0.5 THEN 'direct' WHEN score >= 0.3 THEN 'candidate' ELSE 'unmatched' END AS kind FROM r WHERE n = 1")
def match_direct_candidate_unmatched(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    return retrieval.match_concepts(spark, points, retrieval.centroids(points, "label"), "label", 0.5, 0.3)


_PAIRS = "WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) "


@query(_PAIRS + "SELECT a, b, score FROM p WHERE score >= 0.3")
def similar_pairs(spark, sf_dir):
    return retrieval.similar_pairs(table(spark, sf_dir, "embeddings"), 0.3)


@query(_PAIRS + "SELECT a, b, score FROM p WHERE score >= 0.3")
def similar_pairs_indexed(spark, sf_dir):
    """The same join through the exact index, which larger tables take by themselves."""
    return retrieval.similar_pairs(table(spark, sf_dir, "embeddings"), 0.3, indexed=True)


@query(_PAIRS + "SELECT a, b, score FROM p ORDER BY score DESC, a, b LIMIT 10")
def allpairs_similarity_top10(spark, sf_dir):
    return retrieval.first_pairs(table(spark, sf_dir, "embeddings"), 10)


@query(_PAIRS + "SELECT a, b, score FROM p ORDER BY round(abs(score - 0.3), 6), a, b LIMIT 10")
def near_threshold_pairs(spark, sf_dir):
    return retrieval.first_pairs(table(spark, sf_dir, "embeddings"), 10, 0.3)


@query(
    _PAIRS
    + "SELECT count(*) AS n, "
    + ", ".join(f"round(quantile_cont(score, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 90, 95, 99))
    + ", round(min(score), 6) AS lowest, round(max(score), 6) AS highest, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS deviation FROM p"
)
def similarity_percentiles(spark, sf_dir):
    """The distribution over all pairs, from the counts of rounded scores."""
    return retrieval.counted_distribution(retrieval.score_counts(table(spark, sf_dir, "embeddings")))


_GROUPS = """
WITH l AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS sim FROM embeddings),
c AS (SELECT vec_id, label, sum(CASE WHEN round(sim, 6) < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS grp FROM l)
"""


@query(_GROUPS + "SELECT label, grp, min(vec_id) AS first_id, max(vec_id) AS last_id, count(*) AS n FROM c GROUP BY label, grp")
def semantic_groups(spark, sf_dir):
    from lorespark.operators import chunking

    cut = chunking.semantic_groups(table(spark, sf_dir, "embeddings"), 0.05, ["label"], ["vec_id"])
    return cut.groupBy("label", "grp").agg(F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"), F.count("*").alias("n"))


@query(
    """WITH RECURSIVE e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.35),
w AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node)
SELECT node AS vec_id, min(root) AS cluster FROM w GROUP BY node"""
)
def density_clusters(spark, sf_dir):
    """Connected components of the neighbour graph: the density clustering with single points kept."""
    return clustering.neighbour_clusters(spark, table(spark, sf_dir, "embeddings"), 0.35)


#: Distances at length 1, from rounded cosines.
_CORES = """WITH d AS (SELECT a.vec_id, round(sqrt(greatest(0, 2 - 2 * round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6))), 6) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM d)
SELECT vec_id, d AS core FROM r WHERE k = 3"""


@query(_CORES)
def core_distances(spark, sf_dir):
    return density.core_distances(spark, table(spark, sf_dir, "embeddings"), 3)


@query()
def density_tree(spark, sf_dir):
    """Hierarchical density clusters with noise; a plain version is in the tests."""
    return density.density_tree(spark, table(spark, sf_dir, "embeddings"), density.Settings(least_size=5, neighbours=3))[0]


@query()
def greedy_clusters(spark, sf_dir):
    return clustering.greedy(table(spark, sf_dir, "embeddings"), 0.3, keep=("label",))


@query("SELECT vec_id, text_norm FROM (SELECT vec_id, round(sqrt(list_sum([x * x for x in embedding::DOUBLE[]])), 4) AS text_norm FROM embeddings)")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 4).alias("text_norm"))


@query()
def threshold_sweep(spark, sf_dir):
    return clustering.sweep(table(spark, sf_dir, "embeddings"), [0.2, 0.3, 0.4, 0.5])
