"""Short vectors lie in boxes: searches equal scans, inside a component nothing is compared, and one task selects as the rounds do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import density, vector_index
from lorespark.operators.vector_index import Boxes, Cells, Halves, VectorIndex


def clumps(n=1500, d=5, seed=4):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(size=(1, d)) + rng.normal(size=(n // 5, d)) * s for s in (0.0, 1e-4, 0.01, 0.05, 1.0)])
    x[7] = 0
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_POINTS", 40)
    monkeypatch.setattr(vector_index, "BLOCKS", 1 << 20)
    monkeypatch.setattr(vector_index, "TASK_POINTS", 150)


def scores(x):
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    return np.round(unit @ unit.T, 6) + 0.0


def test_nearest_equals_a_scan(spark, small):
    """Also where hundreds of points are as near as each other, and one box of equal points takes several blocks."""
    x = clumps()
    index = VectorIndex.build(spark, frame(spark, x))
    assert isinstance(index.held, Boxes) and len(index.held.cells) > 15 and index.held.parts.max() > 1
    hits, opened = index.nearest(index.members, 4, "id", "v")
    want, got = scores(x), {}
    for r in hits.collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    differ = 0
    for i in range(len(x)):
        own = sorted((-s, j) for j, s in enumerate(want[i]) if j != i)[:4]
        assert [got[i][k + 1][1] for k in range(4)] == pytest.approx([-s for s, _ in own], abs=1.1e-6)
        differ += [got[i][k + 1][0] for k in range(4)] != [j for _, j in own]
    assert differ <= 3  # a cosine that lies on the border of two roundings
    assert np.median([r.opened for r in opened.collect()]) < 0.5 * len(index.held.cells)


def test_leaves_hold_like_shares():
    x = np.random.default_rng(1).normal(size=(3000, 3))
    for leaves in (1, 3, 7, 16):
        found = np.bincount(Halves(x, leaves).of(x))
        assert len(found) == leaves and found.min() > 0.8 * len(x) / leaves
    assert Halves(np.ones((9, 2)), 4).of(np.ones((5, 2))).tolist() == [0] * 5 and Halves(np.zeros((0, 2)), 4).of(x[:, :2]).max() == 0


def test_a_component_is_shut_to_its_own_points(spark, small):
    index = VectorIndex.build(spark, frame(spark, clumps()))
    members = index.members.withColumns({"label": F.lit(-1).cast("long"), "core": F.lit(0.0)})
    one = {r.cell: -1 for r in members.select("cell").distinct().collect()}
    asked = members.withColumn("radius", F.lit(0.5))
    run = lambda held: index.meet(asked, Cells.open_within, lambda: lambda points=None, asked=None: None if points is None else vector_index.pa.table({"n": [len(asked["id"]) * len(points["id"])]}), "n long", members, held=held)
    assert run(index.held.labelled(one)).count() == 0 and run(index.held.labelled({})).count() > 0


def test_one_task_selects_as_the_rounds_do(spark, monkeypatch):
    index = VectorIndex.build(spark, frame(spark, clumps(400, 3, 1)))
    edges, _ = density.spanning_tree(spark, index, density.Settings(3, 2))
    clusters, _ = density.condensed(spark, index.members.select("id"), edges, 3)
    run = lambda epsilon: {(r.cluster, r.top) for r in density.selected(spark, clusters, epsilon).collect()}
    whole = {e: run(e) for e in (0.0, 0.03, 3.0)}
    monkeypatch.setattr(density, "ONE_TASK_CLUSTERS", 0)
    assert all(run(e) == found and found for e, found in whole.items())
