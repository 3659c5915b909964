"""Hierarchical density clustering of vectors, with noise.

The steps are those of the published method: core distances, the minimum spanning tree of
mutual reachability, a tree condensed to clusters of a least size, and the selection of
the most stable clusters.  Vectors are compared at length 1.

Spanning tree: Borůvka rounds.  Every point keeps a list of its nearest points from the
exact index; a component's lightest outgoing edge is taken from these lists wherever they
prove it, and only points whose list could hide a lighter one search the index again.
Condensed tree: edges are merged from the lightest on, in batches of a bounded number.
Within a batch the components that its edges form are independent, so each is a group of
its own; what a component carries into the next batch is a row, with the points that
have not yet made a cluster, fewer than the least size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.operators import graph
from lorespark.operators.tables import drop, saved
from lorespark.operators.vector_index import Cells, VectorIndex, arrays, least_score, near

DIGITS = 6
#: Nearest points that every point keeps, at least.
LIST = 8
#: Components of which a point is held by all tasks, so that each component knows an edge that leaves it.
REPRESENTATIVES = 512
#: Edges that are merged in one batch.
BATCH_EDGES = 1_000_000
#: Distances of 0 count as this one where a density is taken.
LEAST_DISTANCE = 1e-6


@dataclass(frozen=True)
class Settings:
    """Least points of a cluster, neighbours of the core distance, and the distance below which clusters aren't split."""

    least_size: int = 2
    neighbours: int = 1
    epsilon: float = 0.15


def _distance(score):
    return F.round(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * score)), DIGITS)


def _lists(spark: SparkSession, index: VectorIndex, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Each point's nearest points (``a``, ``b``, ``d``), and ``id``, ``core`` and ``bound``: no point outside the list is nearer."""
    size = max(LIST, settings.neighbours)
    hits, _ = index.nearest(index.members, size, "id", "v")
    near = saved(spark, hits.select(F.col("query_id").alias("a"), F.col("id").alias("b"), _distance(F.col("score")).alias("d"), "rank"))
    mine = F.when(F.col("rank") <= settings.neighbours, F.col("d"))
    cores = near.groupBy(F.col("a").alias("id")).agg(F.max(mine).alias("core"), F.max("d").alias("last"), F.count("*").alias("n"))
    # a list that isn't full holds all points there are
    bound = F.when(F.col("n") < size, F.lit(float("inf"))).otherwise(F.greatest("last", "core"))
    return near.drop("rank"), saved(spark, cores.select("id", "core", bound.alias("bound")))


def core_distances(spark: SparkSession, points: DataFrame, neighbours: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and ``core``: the distance from each point to its ``neighbours``-th nearest; of fewer points the farthest counts."""
    _, cores = _lists(spark, VectorIndex.build(spark, points, key, vector), Settings(neighbours=neighbours))
    return cores.select(F.col("id").alias(key), "core")


_EDGE = "comp long, other long, w double, lo long, hi long"


def _least(i: np.ndarray, *rest: np.ndarray, by: np.ndarray | None = None):
    """Of the entries of each query, which lie together, those with the least ``by``, or the least of the last array, which is then left out."""
    *rest, last = rest if by is None else (*rest, by)
    if not len(i):
        return (i, *rest)
    begin = np.flatnonzero(np.diff(i, prepend=-1))
    keep = last == np.repeat(np.minimum.reduceat(last, begin), np.diff(np.append(begin, len(i))))
    return tuple(x[keep] for x in (i, *rest))


def _lightest(points=None, asked=None):
    """The lightest edge from each query to a point of another component, within its radius."""
    if points is None:
        return None
    i, j, scores = near(points, asked, least_score(asked), apart=True)
    w = np.round(np.sqrt(np.maximum(0.0, 2 - 2 * scores)), DIGITS)
    w = np.maximum(np.maximum(w, asked["core"][i]), points["core"][j])
    i, j, w = _least(i, j, w, w)
    # of equally light ones the edge with the smaller ends
    low, high = np.minimum(asked["id"][i], points["id"][j]), np.maximum(asked["id"][i], points["id"][j])
    i, j, w, low, high = _least(i, j, w, low, high, by=low)
    i, j, w, low, high = _least(i, j, w, low, high, by=high)
    first = np.flatnonzero(np.diff(i, prepend=-1))
    return pa.table({"comp": asked["label"][i[first]], "other": points["label"][j[first]], "w": w[first], "lo": low[first], "hi": high[first]})


def _to_some(spark: SparkSession, asked: DataFrame, some: pa.Table) -> DataFrame:
    """The lightest edge from each point to one of ``some`` in another component: it bounds how far a component has to search."""
    shared = spark.sparkContext.broadcast(some)

    def run(batches):
        points = arrays(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield from _lightest(points, arrays(pa.Table.from_batches([batch.slice(at, 1024)]))).combine_chunks().to_batches()

    return asked.mapInArrow(run, _EDGE)


def spanning_tree(spark: SparkSession, index: VectorIndex, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Edges ``lo``, ``hi``, ``w`` of the minimum spanning tree of mutual reachability, and ``id``, ``core`` of the points.

    Equally long edges are ordered by their ends, so that there is just one tree.  A round
    takes the lightest edge out of each component but the largest.
    """
    near, cores = _lists(spark, index, settings)
    core = lambda side: cores.select(F.col("id").alias(side), F.col("core").alias(f"core_{side}"))
    heavy = near.join(core("a"), "a").join(core("b"), "b")
    lists = saved(spark, heavy.select("a", "b", F.greatest("d", "core_a", "core_b").alias("w")))
    labels = saved(spark, cores.select("id", F.col("id").alias("label")))
    tree: list[DataFrame] = []
    points = cores.count()
    edge = F.struct("w", "lo", "hi", "other")
    while True:
        mark = lambda side, label: labels.select(F.col("id").alias(side), F.col("label").alias(label))
        apart = lists.join(mark("a", "comp"), "a").join(mark("b", "other"), "b").where("comp <> other")
        lists_left = saved(spark, apart)  # edges inside a component are never asked for again
        # the largest component waits: the others' lightest edges join it
        largest = labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").first()
        if largest is None or largest.n == points:
            break
        waits = F.col("label") == F.lit(largest.label)
        members = saved(spark, index.members.join(labels, "id").join(cores, "id"))
        fields = lambda radius: ["id", "v", radius.alias("radius"), "label", "core", F.lit(0).alias("near")]
        some = members.where("id = label").orderBy(F.xxhash64("id"), "id").limit(REPRESENTATIVES).union(members.where(F.col("id") == F.lit(largest.label)))
        reached = _to_some(spark, members.where(~waits).select(*fields(F.lit(None).cast("double"))), some.select(*fields(F.lit(None).cast("double"))).toArrow())
        known = lists_left.where(F.col("comp") != F.lit(largest.label)).select("comp", "w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "other")
        best = saved(spark, known.unionByName(reached.select(known.columns)).groupBy("comp").agg(F.min(edge).alias("e")))
        # points whose list may hide a lighter edge than their component has found
        open_ = members.where(~waits).join(best.select(F.col("comp").alias("label"), F.col("e.w").alias("most")), "label")
        open_ = open_.where(F.col("bound") <= F.col("most"))
        wider = F.sqrt(F.col("most") * F.col("most") + 8e-6)  # scores are rounded
        # cells with one label alone are shut to queries of that label: inside a large component nothing is compared
        one = {r.cell: r.label for r in members.groupBy("cell").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").collect()}
        found = index.meet(open_.withColumn("radius", wider), Cells.open_within, lambda: _lightest, _EDGE, members, held=index.held.labelled(one))
        chosen = best.select("comp", "e").unionByName(found.select("comp", edge.alias("e"))).groupBy("comp").agg(F.min("e").alias("e"))
        round_ = saved(spark, chosen.select("comp", F.col("e.w").alias("w"), F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"), F.col("e.other").alias("other")))
        drop(best, lists, members)
        lists = lists_left.select("a", "b", "w")
        lists.table_path = lists_left.table_path
        tree.append(round_)
        merged = graph.components(spark, labels.select(F.col("label").alias("node")).distinct(), round_.select(F.col("comp").alias("a"), F.col("other").alias("b")))
        after = saved(spark, labels.join(merged.select(F.col("node").alias("label"), "component"), "label").select("id", F.col("component").alias("label")))
        drop(labels)
        labels = after
    edges = spark.createDataFrame([], "lo long, hi long, w double")
    for part in tree:
        edges = edges.unionByName(part.select("lo", "hi", "w"))
    return saved(spark, edges.distinct()), cores.select("id", "core")


# --- condensed tree -------------------------------------------------------------------

_FOUND = "kind string, comp long, id long, cluster long, parent long, density double, w double, size long, stability double, flag boolean, members array<long>, total double, below double, split boolean"
_FIELDS = [f.rsplit(" ", 1)[0].strip() for f in _FOUND.split(",")]
_SCHEMA = pa.schema([("kind", pa.string()), ("comp", pa.int64()), ("id", pa.int64()), ("cluster", pa.int64()), ("parent", pa.int64()), ("density", pa.float64()), ("w", pa.float64()), ("size", pa.int64()), ("stability", pa.float64()), ("flag", pa.bool_()), ("members", pa.list_(pa.int64())), ("total", pa.float64()), ("below", pa.float64()), ("split", pa.bool_())])
_STATE = ["comp", "size", "members", "cluster", "total", "below", "split"]


@dataclass
class _Part:
    """A component as it grows: its points while they are too few for a cluster, then the cluster that they are in."""

    size: int
    members: list[int]
    cluster: int | None = None
    #: Sum of the densities at which points left the cluster, and of what is selected below it; whether it splits.
    total: float = 0.0
    below: float = 0.0
    split: bool = False


def _closed(part: _Part, w: float, parent: int | None) -> dict:
    """The row of a cluster that begins at distance ``w``, or that is the root."""
    density = 0.0 if parent is None else 1 / max(w, LEAST_DISTANCE)
    stability = part.total - part.size * density
    flag = parent is not None and not (part.split and part.below > stability)
    return {"kind": "cluster", "cluster": part.cluster, "parent": parent, "density": density, "w": None if parent is None else w, "size": part.size, "stability": stability, "flag": flag, "below": stability if flag else part.below}


def merge(parts: dict[int, _Part], edges: list[tuple[int, float, int, int]], least: int) -> tuple[dict[int, _Part], list[dict]]:
    """Components after the ``edges`` (number, weight, two components) in their order, and the points and clusters settled by them."""
    top = {c: c for c in parts}

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    rows: list[dict] = []
    for number, w, a, b in edges:
        a, b = sorted((find(a), find(b)))
        x, y = parts[a], parts.pop(b)
        top[b] = a
        density = 1 / max(w, LEAST_DISTANCE)
        if x.cluster is not None and y.cluster is not None:  # two clusters begin here, and a larger one goes on
            closed = [_closed(p, w, number) for p in (x, y)]
            rows += closed
            parts[a] = _Part(x.size + y.size, [], number, (x.size + y.size) * density, sum(c["below"] for c in closed), True)
            continue
        big, small = (x, y) if x.cluster is not None else (y, x)
        if big.cluster is None:
            big.members = big.members + small.members
            big.size += small.size
            if big.size < least:
                parts[a] = big
                continue
            big.cluster, leaving = number, big.members
        else:
            big.size += small.size
            leaving = small.members
        rows += [{"kind": "point", "id": i, "cluster": big.cluster, "density": density} for i in leaving]
        big.total += len(leaving) * density
        big.members = []
        parts[a] = big
    return parts, rows


def _merged(least: int):
    def run(_, edges: pa.Table, states: pa.Table) -> pa.Table:
        parts = {s["comp"]: _Part(*(s[c] for c in _STATE[1:])) for s in states.select(_STATE).to_pylist()}
        own = edges.sort_by("number").select(["number", "w", "a", "b"])
        parts, rows = merge(parts, list(zip(*(own.column(c).to_pylist() for c in own.column_names))), least)
        rows += [{"kind": "state", "comp": c, **{n: getattr(p, n) for n in _STATE[1:]}} for c, p in parts.items()]
        return pa.Table.from_pylist(rows, _SCHEMA)

    return run


def numbered(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """The edges with their place in the order of length and ends, in a column ``number``, by ranges side by side."""
    order = ["w", "lo", "hi"]
    ranges = edges.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = saved(spark, ranges.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    offsets = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    return saved(spark, placed.join(F.broadcast(offsets), "part").select(*order, (F.col("before") + F.col("place")).alias("number")))


def condensed(spark: SparkSession, points: DataFrame, edges: DataFrame, least_size: int, batch: int = BATCH_EDGES) -> tuple[DataFrame, DataFrame]:
    """Clusters (``cluster``, ``parent``, ``density``, ``w``, ``size``, ``stability``, ``flag``) and the cluster that each point leaves last.

    ``points`` has ``id``.  A cluster is named by the number of the edge that made it; ``w``
    and ``density`` are those at which it parts from its parent.  ``flag`` says that it is
    more stable than what can be selected below it.
    """
    edges = numbered(spark, edges)
    labels = points.select("id", F.col("id").alias("comp"))
    states = points.select(F.col("id").alias("comp"), F.lit(1).cast("long").alias("size"), F.array("id").alias("members"), F.lit(None).cast("long").alias("cluster"), F.lit(0.0).alias("total"), F.lit(0.0).alias("below"), F.lit(False).alias("split"))
    n, settled, before = edges.count(), [], []
    for at in range(0, n, batch):
        own = edges.where((F.col("number") >= at) & (F.col("number") < at + batch))
        name = lambda side, end: labels.select(F.col("id").alias(end), F.col("comp").alias(side))
        own = saved(spark, own.join(name("a", "lo"), "lo").join(name("b", "hi"), "hi").select("number", "w", "a", "b"))
        ends = own.select(F.col("a").alias("node")).union(own.select("b")).distinct()
        groups = saved(spark, graph.components(spark, ends, own.select("a", "b")))
        named = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias("root"))
        touched, mine = states.join(named("comp"), "comp"), own.join(named("a"), "a")
        found = saved(spark, mine.groupBy("root").cogroup(touched.groupBy("root")).applyInArrow(_merged(least_size), _FOUND))
        settled.append(found)
        rest = states.join(named("comp"), "comp", "left_anti").select(_STATE)
        states = saved(spark, rest.unionByName(found.where("kind = 'state'").select(_STATE)))
        renamed = labels.join(named("comp"), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
        labels = saved(spark, renamed) if at + batch < n else labels
        drop(own, groups, *before)
        before = [f for f in (states, labels) if hasattr(f, "table_path")]
    root = spark.createDataFrame([], "cluster long, size long, total double, below double, split boolean") if not settled else states.where("cluster is not null").select("cluster", "size", "total", "below", "split")
    columns = ["cluster", "parent", "density", "w", "size", "stability", "flag"]
    # the root begins at no distance, and is never selected
    clusters = root.select("cluster", F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("density"), F.lit(None).cast("double").alias("w"), "size", F.col("total").alias("stability"), F.lit(False).alias("flag"))
    left = spark.createDataFrame([], "id long, cluster long, density double")
    for found in settled:
        clusters = clusters.unionByName(found.where("kind = 'cluster'").select(columns))
        left = left.unionByName(found.where("kind = 'point'").select("id", "cluster", "density"))
    return saved(spark, clusters), saved(spark, left)


def _topmost(spark: SparkSession, clusters: DataFrame, marked: DataFrame) -> DataFrame:
    """``cluster`` and the highest of it and its ancestors that is ``marked``, by doubling how far each looks."""
    own = marked.select("cluster", F.col("cluster").alias("mark"))
    now = saved(spark, clusters.select("cluster", F.col("parent").alias("up")).join(own, "cluster", "left"))
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("cluster").alias("up"), F.col("mark").alias("higher"), F.col("up").alias("next"))
        after = saved(spark, now.join(above, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "mark").alias("mark")))
        drop(now)
        now = after
    return now.where("mark is not null").select("cluster", F.col("mark").alias("top"))


#: Clusters among which one task selects.
ONE_TASK_CLUSTERS = 1 << 20


def _selected(epsilon: float):
    """``selected`` for a tree that one task holds: a cluster's number is below its parent's, so that numbers go from the top down."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("cluster", "descending")])
        rows = list(zip(*(table.column(c).to_pylist() for c in ("cluster", "parent", "w", "flag"))))
        roots = {c for c, parent, _, _ in rows if parent is None}
        stable: dict[int, int] = {}
        to: dict[int, int] = {}
        kept: set[int] = set()
        for c, parent, w, flag in rows:
            if parent in stable:
                stable[c] = stable[parent]
            elif flag:
                stable[c] = c
            if parent is not None:
                to[c] = c if w > epsilon or parent in roots else to[parent]
                if stable.get(c) == c:
                    kept.add(c if w >= epsilon else to[c])
        top: dict[int, int] = {}
        for c, parent, _, _ in rows:
            if parent in top:
                top[c] = top[parent]
            elif c in kept:
                top[c] = c
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array(list(top.values()), pa.int64())], ["cluster", "top"])

    return run


def selected(spark: SparkSession, clusters: DataFrame, epsilon: float) -> DataFrame:
    """``cluster`` and ``top``, the selected cluster that it belongs to; clusters in none are missing.

    The most stable clusters are selected.  One that parts from its parent at less than
    ``epsilon`` gives way to its lowest ancestor that parts at more, or to the highest below
    the root.  Up to ``ONE_TASK_CLUSTERS`` take one task, more take rounds.
    """
    if clusters.count() <= ONE_TASK_CLUSTERS:
        return saved(spark, clusters.select("cluster", "parent", "w", "flag").coalesce(1).mapInArrow(_selected(epsilon), "cluster long, top long"))
    stable = _topmost(spark, clusters, clusters.where("flag"))
    chosen = stable.where("cluster = top").select("cluster")
    roots = clusters.where("parent is null").select(F.col("cluster").alias("root"))
    ends = clusters.where("parent is not null").join(roots, F.col("parent") == F.col("root"), "left")
    stops = (F.col("w") > epsilon) | F.col("root").isNotNull()
    climb = saved(spark, ends.select("cluster", "w", F.when(stops, F.col("cluster")).otherwise(F.col("parent")).alias("to")))
    while True:
        after = saved(spark, climb.join(climb.select(F.col("cluster").alias("to"), F.col("to").alias("next")), "to").select("cluster", "w", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        drop(climb)
        climb = after
        if climb.where("moved").isEmpty():
            break
        climb = climb.drop("moved")
        climb.table_path = after.table_path
    kept = chosen.join(climb, "cluster").select(F.when(F.col("w") >= epsilon, F.col("cluster")).otherwise(F.col("to")).alias("cluster")).distinct()
    return _topmost(spark, clusters, saved(spark, kept))


def density_tree(spark: SparkSession, points: DataFrame, settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding", batch: int = BATCH_EDGES) -> tuple[DataFrame, DataFrame]:
    """Clusters of all points by density, and the condensed tree (see ``condensed``).

    Columns ``key``, ``cluster`` (its smallest key), ``noise`` and ``core``; a point in no
    cluster is noise and a cluster of its own.  Null vectors are skipped, and vectors of
    length 0 are as far from all as a right angle.  Without a split in the tree, and with
    fewer points than a cluster needs, all are noise; an empty table gives empty results.
    Keys should not repeat.
    """
    index = VectorIndex.build(spark, points, key, vector)
    edges, cores = spanning_tree(spark, index, settings)
    every = index.members.select("id")
    clusters, left = condensed(spark, every, edges, settings.least_size, batch)
    tops = left.join(selected(spark, clusters, settings.epsilon), "cluster").select("id", "top")
    names = tops.groupBy("top").agg(F.min("id").alias("name"))
    named = tops.join(names, "top").select("id", "name")
    out = every.join(cores, "id", "left").join(named, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("name", "id").alias("cluster"), F.col("name").isNull().alias("noise"), "core"), clusters
