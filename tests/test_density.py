"""The distributed density tree against one that is cut from the top, edge by edge."""

import numpy as np
import pytest

from lorespark.operators import density
from lorespark.operators.density import Settings

SCHEMA = "vec_id long, embedding array<double>"


def weights(x, neighbours):
    x = np.asarray(x, dtype=np.float64)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    d = np.round(np.sqrt(np.maximum(0, 2 - 2 * (np.round(unit @ unit.T, 6) + 0.0))), 6)
    others = np.where(np.eye(len(x), dtype=bool), np.inf, d)
    core = np.sort(others, axis=1)[:, min(neighbours, len(x) - 1) - 1]
    return np.maximum(np.maximum(d, core[:, None]), core), core


def span(w):
    """Kruskal, with the ends as tie-breakers."""
    n = len(w)
    top, out = list(range(n)), []

    def find(c):
        while top[c] != c:
            c = top[c]
        return c

    for wt, a, b in sorted((w[a, b], a, b) for a in range(n) for b in range(a + 1, n)):
        if find(a) != find(b):
            top[find(b)] = find(a)
            out.append((wt, a, b))
    return out


def brute(x, settings):
    w, core = weights(x, settings.neighbours)
    edges = span(w)
    label, tree = {}, []

    def sides(members, held, cut):
        near = {m: [] for m in members}
        for e in held:
            if e != cut:
                near[e[1]].append(e[2])
                near[e[2]].append(e[1])

        def reach(s):
            seen, stack = {s}, [s]
            while stack:
                for o in near[stack.pop()]:
                    if o not in seen:
                        seen.add(o)
                        stack.append(o)
            return seen

        return reach(cut[1]), reach(cut[2])

    def descend(members, held, birth_w):
        """Best selections below and the node itself, going down from its birth."""
        birth = 0.0 if birth_w is None else 1 / max(birth_w, 1e-6)
        size, stability, points, children = len(members), 0.0, [], []
        while True:
            if not held:
                left = members
                break
            cut = max(held)
            lam = 1 / max(cut[0], 1e-6)
            a, b = sides(members, held, cut)
            big = [s for s in (a, b) if len(s) >= settings.least_size]
            own = lambda s: [e for e in held if e != cut and e[1] in s]
            if len(big) == 2:
                stability += (lam - birth) * len(members)
                children = [descend(s, own(s), cut[0]) for s in (a, b)]
                left = set()
                break
            gone = [s for s in (a, b) if len(s) < settings.least_size]
            stability += sum((lam - birth) * len(s) for s in gone)
            points += [m for s in gone for m in s]
            if not big:
                left = set()
                break
            members, held = big[0], own(big[0])
        node = {"points": points + list(left), "children": children, "w": birth_w, "stability": stability, "size": size}
        below = sum(c["best"] for c in children)
        node["flag"] = birth_w is not None and not (children and below > stability)
        node["best"] = stability if node["flag"] else below
        tree.append(node)
        return node

    def every(node):
        return node["points"] + [p for c in node["children"] for p in every(c)]

    def pick(node, path):
        """Selected nodes from the top, moved up by epsilon."""
        if node["flag"]:
            at = node
            if node["w"] < settings.epsilon:
                for k, up in enumerate(reversed(path)):
                    if up["w"] is None:
                        break
                    at = up
                    if up["w"] > settings.epsilon:
                        break
            for p in every(at):
                label[p] = min(every(at))
            return
        for c in node["children"]:
            pick(c, [*path, node])

    if len(x) >= settings.least_size and edges:
        pick(descend(set(range(len(x))), edges, None), [])
    rows = [(i, label.get(i, i), i not in label, core[i]) for i in range(len(x))]
    return rows, sorted((n["size"], round(n["stability"], 4), n["flag"]) for n in tree)


def blobs(seed, sizes, spread=0.08, noise=12, dimensions=6):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=dimensions) * 2 + rng.normal(size=(n, dimensions)) * spread * (k + 1) for k, n in enumerate(sizes)]
    return np.concatenate([*parts, rng.normal(size=(noise, dimensions))])


@pytest.mark.parametrize(
    "seed, settings, batch",
    [(1, Settings(5, 3, 0.0), 10**6), (2, Settings(2, 1, 0.15), 17), (3, Settings(4, 2, 0.3), 30)],
)
def test_equals_the_tree_cut_from_the_top(spark, seed, settings, batch):
    x = blobs(seed, [14, 20, 9])
    x[3], x[5] = x[4], 0  # a copy, and a length of 0
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(3)
    found, tree = density.density_tree(spark, points, settings, batch=batch)
    rows, clusters = brute(x, settings)
    got = sorted(tuple(r) for r in found.collect())
    assert [g[:3] for g in got] == [r[:3] for r in rows]
    assert np.allclose([g[3] for g in got], [r[3] for r in rows], atol=2e-6)
    assert sorted((r.size, round(r.stability, 4), r.flag) for r in tree.collect()) == clusters
    assert len({r[1] for r in rows if not r[2]}) >= 2


def test_spanning_tree_searches_beyond_the_lists(spark, monkeypatch):
    """Lists of two points, in tight groups of more, leave the way out to the index."""
    monkeypatch.setattr(density, "LIST", 2)
    x = blobs(7, [10, 10, 10], spread=0.01, noise=0)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    edges, _ = density.spanning_tree(spark, density.VectorIndex.build(spark, points), Settings(3, 1, 0.0))
    want = sorted((a, b, w) for w, a, b in span(weights(x, 1)[0]))
    got = sorted((r.lo, r.hi, r.w) for r in edges.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_points(spark, n):
    points = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)] + [(9, None)], SCHEMA)
    found, tree = density.density_tree(spark, points, Settings(2, 1, 0.0))
    assert sorted((r.vec_id, r.cluster, r.noise) for r in found.collect()) == [(i, i, True) for i in range(n)]
    assert tree.count() == (n == 2)


def test_one_representative_and_one_task_change_nothing(spark, monkeypatch):
    """Components learn of an edge that leaves them from points that all tasks hold; with one of these the tree is the same."""
    from lorespark.operators import graph

    monkeypatch.setattr(density, "REPRESENTATIVES", 1)
    monkeypatch.setattr(density, "LIST", 2)
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", 4)
    x = blobs(11, [9, 9], spread=0.01, noise=3)
    x[2] = x[1]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    edges, _ = density.spanning_tree(spark, density.VectorIndex.build(spark, points), Settings(3, 1, 0.0))
    assert sorted((r.lo, r.hi) for r in edges.collect()) == sorted((a, b) for _, a, b in span(weights(x, 1)[0]))
