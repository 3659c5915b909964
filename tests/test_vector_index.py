"""The index against scans in numpy: with lengths of 0, ties, nulls, few points, hot cells and clear clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import vector_index
from lorespark.operators.retrieval import similar_pairs
from lorespark.operators.vector_index import Cells, VectorIndex

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(seed=3, clusters=12, each=60, size=8, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    return np.concatenate([c / np.linalg.norm(c) + rng.normal(size=(each, size)) * spread for c in centres]).astype(np.float32)


def cosines(x):
    x = x.astype(np.float64)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    return np.round(unit @ unit.T, 6) + 0.0


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA).repartition(3)


def brute_nearest(x, asked, k):
    scores = cosines(x)
    return sorted((q, i, rank) for q in asked for rank, i in enumerate(sorted((i for i in range(len(x)) if i != q), key=lambda i: (-scores[q, i], i))[:k], 1))


@pytest.mark.parametrize("k", [1, 5, 40])
def test_nearest_is_a_scan_that_opens_few_cells(spark, k):
    x = clustered()
    x[::50] = 0  # lengths of 0, whose scores are all 0
    x[7] = x[8]
    points = frame(spark, x)
    hits, opened = VectorIndex.build(spark, points).nearest(points.where("vec_id % 7 = 0"), k)
    assert sorted((r.query_id, r.id, r["rank"]) for r in hits.collect()) == brute_nearest(x, range(0, len(x), 7), k)
    index_cells = VectorIndex.build(spark, points).held.cells
    share = {r.query_id: r.opened / len(index_cells) for r in opened.collect()}
    assert len(share) == len(range(0, len(x), 7)) and np.median(list(share.values())) < 0.4


@pytest.mark.parametrize("least", [0.95, 0.2, 0.0, -0.3])
def test_pairs_within_a_cosine(spark, least, monkeypatch):
    monkeypatch.setattr(vector_index, "TASK_POINTS", 16)  # cells dealt to several tasks on both sides
    monkeypatch.setattr(vector_index, "TASK_QUERIES", 16)
    monkeypatch.setattr(vector_index, "RING_POINTS", 2)
    x = clustered(each=12)
    x[5], x[6], x[9] = 0, 0, x[10]
    scores = cosines(x)
    want = sorted((i, j, scores[i, j]) for i in range(len(x)) for j in range(i + 1, len(x)) if scores[i, j] >= least)
    for indexed in (True, False):
        got = sorted((r.a, r.b, r.score) for r in similar_pairs(frame(spark, x), least, indexed=indexed).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


def test_share_of_cell_pairs_that_a_join_skips(spark):
    index = VectorIndex.build(spark, frame(spark, clustered()))
    asked = index._asked(index.members, 0.9, "id", "v").agg(F.sum(F.size("cells")).alias("n")).first().n
    assert asked < 0.35 * len(clustered()) * len(index.held.cells)


def test_queries_of_their_own_and_a_threshold(spark):
    x = clustered(each=20)
    index, scores = VectorIndex.build(spark, frame(spark, x[:200])), cosines(x)
    queries = frame(spark, x).where("vec_id >= 200")
    got = sorted((r.query_id, r.id) for r in index.within(queries, 0.9).collect())
    assert got == sorted((q, i) for q in range(200, len(x)) for i in range(200) if scores[q, i] >= 0.9)


def test_few_null_and_uneven_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, None, 0), (3, [None, 1.0], 0), (None, [1.0, 1.0], 0), (4, [1.0, 1.0], 0)]
    points = spark.createDataFrame(rows, SCHEMA)
    hits, _ = VectorIndex.build(spark, points).nearest(points, 3)
    assert sorted((r.query_id, r.id, r.score) for r in hits.collect()) == [(1, 4, 0.707107), (4, 1, 0.707107)]
    empty = points.limit(0)
    index = VectorIndex.build(spark, empty)
    assert index.nearest(points, 3)[0].collect() == [] and index.pairs(0.1).collect() == [] and similar_pairs(empty, 0.5).collect() == [] == similar_pairs(empty, 0.5, indexed=True).collect()
    with pytest.raises(ValueError, match="different lengths"):
        VectorIndex.build(spark, spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], SCHEMA))


def test_bound_never_shuts_a_cell_with_a_hit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[:5]
    own = vector_index._distances(x, centres)
    lists, far = own.argmin(1), own.min(1)
    held = Cells(centres, np.arange(5, dtype=np.int32), np.arange(5), np.array([far[lists == c].min() for c in range(5)]), np.array([far[lists == c].max() for c in range(5)]), np.bincount(lists))
    radius = rng.uniform(0, 1.5, 300)
    shut = ~held.open_within(x, radius)
    apart = np.linalg.norm(x[:, None] - x, axis=2)
    for c in range(5):
        assert not (apart[shut[:, c]][:, lists == c] <= radius[shut[:, c], None]).any()
    assert shut.any()


def test_a_query_goes_once_to_a_block(spark):
    """However many cells are open: blocks don't get more with the points, up to their bound."""
    x = np.random.default_rng(5).normal(size=(3000, 8)).astype(np.float32)
    index = VectorIndex.build(spark, frame(spark, x))
    open_ = index._asked(index.members, 0.1, "id", "v").agg(F.avg(F.size("cells"))).first()[0]
    met = index.meet(index._ranged(index.members, 0.1, "id", "v"), Cells.open_within, lambda: lambda points=None, asked=None: None if points is None else vector_index.pa.table({"id": asked["id"]}), "id long")
    most = met.groupBy("id").count().agg(F.max("count"), F.count("*")).first()
    assert most[0] <= vector_index.BLOCKS < open_ and most[1] == len(x)


def test_blocks_hold_cells_in_order_and_share_large_ones():
    assert vector_index._blocks([3, 4, 5, 25, 2, 2], 10) == [(0, 1), (0, 1), (1, 1), (2, 3), (5, 1), (5, 1)]
    assert sorted(vector_index._near_order(np.random.default_rng(0).normal(size=(37, 4)))) == list(range(37)) and vector_index._near_order(np.zeros((5, 2))) is not None


def test_links_connect_what_pairs_connect_and_are_few(spark, monkeypatch):
    from lorespark.operators import graph, retrieval

    monkeypatch.setattr(retrieval, "MOST_LINKS", 100)
    x = clustered(each=30)
    points = frame(spark, x)
    pairs = [(r.a, r.b) for r in similar_pairs(points, 0.9, indexed=False).collect()]
    found = [(r.a, r.b) for r in retrieval.links(points, 0.9, indexed=True).collect()]
    least = lambda edges: dict(zip(*(v.tolist() for v in graph.least_nodes(*np.array(edges).T))))
    assert least(found) == least(pairs) and len(found) < len(x) < len(pairs) / 5


def test_all_pairs_meet_in_few_blocks(spark):
    """Tiles don't say how often a point is sent: counts and first pairs are those of a scan, from a bounded number of blocks."""
    from lorespark.operators import retrieval

    x = clustered(each=30)
    points, (i, j) = frame(spark, x), np.triu_indices(len(x), 1)
    scores = cosines(x)[i, j]
    counted = {r.score: r.n for r in retrieval.score_counts(points, block=8).collect()}
    values, n = np.unique(scores, return_counts=True)
    assert sum(counted.values()) == len(scores) and sum(counted.get(v, 0) != m for v, m in zip(values, n)) <= 4  # roundings of the last digit
    for near in (None, 0.3):
        far = -scores if near is None else np.round(np.abs(scores - near), 6)
        want = [(i[k], j[k]) for k in np.lexsort((j, i, far))[:10]]
        assert [(r.a, r.b) for r in retrieval.first_pairs(points, 10, near, block=8).collect()] == want
    groups = retrieval._products(points, lambda tiles: [retrieval.pa.table({"n": [sum(1 for _ in tiles)]})], "n long", "vec_id", "embedding", 8)
    assert groups.count() <= retrieval.BLOCKS * (retrieval.BLOCKS + 1) // 2
