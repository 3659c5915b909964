"""An exact index of vectors: inverted lists about coarse centres, cut into rings.

Points lie in the list of their nearest centre and, within it, in rings by their distance
from it: a cell.  By the triangle inequality a cell whose distances from its centre run
from ``low`` to ``high`` holds nothing within ``r`` of a query at distance ``d`` from that
centre unless ``low - r <= d <= high + r``.  Searches open just the cells that this bound
leaves, so that their results are those of a scan.  Vectors are compared at length 1, where
a cosine is a distance; vectors of length 0 have a cell of their own, which is always open.

Cells that are near to each other make a block.  A query goes once to each block in which
it opens a cell, however many it opens there, and the task that holds the block opens them:
what is shuffled is the queries times the blocks, not times the cells.

Vectors of up to ``LOW_DIMENSIONS`` numbers have boxes for cells, halves of halves along the
widest side: there a box says far more than a distance from a centre, and a cell is a block.

What every task holds is bounded: the centres, one row for each of at most
``MOST_LISTS * RINGS`` cells, and the points of a block.  A cell of many points makes
several blocks, and a block that many queries reach is dealt to several tasks.
"""

from __future__ import annotations

import copy
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import vectors
from lorespark.operators.tables import drop, saved

MOST_LISTS, RINGS = 4096, 16
#: Points from which the centres are fitted, chosen by a hash of their key, and rounds of fitting.
FIT_POINTS, FIT_ROUNDS = 16_384, 5
#: Points of a block at most, and queries that one task compares with them.
TASK_POINTS, TASK_QUERIES = 32_768, 65_536
#: Blocks of an index whose points need no more, and points that a block should hold at least.
BLOCKS, BLOCK_POINTS = 32, 512
#: Queries that a task compares at once; the cells that any of them opens are opened to all of them.
STEP = 256
#: Points that a ring should hold at least.
RING_POINTS = 64
#: Numbers of vectors whose cells are boxes, and points of a box.
LOW_DIMENSIONS, BOX_POINTS = 6, 4096
DIGITS = 6
#: Scores are rounded, so distances are taken a little longer than they say.
SLACK = 2e-6
_EVERYWHERE = 4.0


def matrix(column) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def reach(cosine):
    """The distance between vectors of length 1 whose rounded cosine is at least ``cosine``."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (np.asarray(cosine) - SLACK)))


def _fit(x: np.ndarray, lists: int) -> np.ndarray:
    """Centres by k-means from the first different points."""
    means = np.unique(x, axis=0)[:: max(1, len(x) // max(1, lists))][:lists] if len(x) else x
    for _ in range(FIT_ROUNDS):
        if not len(means):
            break
        near = ((means**2).sum(1) - 2 * x @ means.T).argmin(1)
        sums = np.zeros_like(means)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(means))[:, None]
        means = np.where(n > 0, sums / np.maximum(n, 1), means)
    return means


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T
    return np.sqrt(np.maximum(square, 0.0))


def _usable(points: DataFrame, key: str, vector: str) -> DataFrame:
    own = points.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    return own.select(F.col(key).cast("long").alias("id"), vectors.unit(F.col(vector)).alias("v"))


def _near_order(centres: np.ndarray, rows: np.ndarray | None = None) -> list[int]:
    """The centres in an order that keeps near ones together: halves along the line between two far ones, again and again."""
    rows = np.arange(len(centres)) if rows is None else rows
    if len(rows) <= 2:
        return rows.tolist()
    own = centres[rows]
    one = own[((own - own.mean(axis=0)) ** 2).sum(1).argmax()]
    along = own @ (own[((own - one) ** 2).sum(1).argmax()] - one)
    order, half = rows[np.argsort(along, kind="stable")], len(rows) // 2
    return [*_near_order(centres, order[:half]), *_near_order(centres, order[half:])]


def _blocks(n: list[int], most: int) -> list[tuple[int, int]]:
    """First block and number of blocks of each cell of ``n`` points, in order; a block holds some ``most`` of them."""
    out, block, used = [], 0, 0
    for own in n:
        if own > most:
            block, used = block + (used > 0), 0
            out.append((block, -(-own // most)))
            block += out[-1][1]
            continue
        if used + own > most:
            block, used = block + 1, 0
        out.append((block, 1))
        used += own
    return out


class Cells:
    """What tasks hold of an index: centres, and list, least and greatest distance, number of points, first block and number of blocks of each cell."""

    def __init__(self, centres: np.ndarray, cells: np.ndarray, lists: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, block: np.ndarray | None = None, parts: np.ndarray | None = None):
        self.centres, self.cells, self.lists, self.low, self.high, self.n = centres, cells, lists, low, high, n
        self.block = np.zeros(len(cells), dtype=np.int32) if block is None else block
        self.parts = np.ones(len(cells), dtype=np.int32) if parts is None else parts
        #: Cell and block of each share of a cell that lies in one block.
        self.shares = np.repeat(np.arange(len(cells)), self.parts)
        self.in_block = np.concatenate([np.arange(b, b + p) for b, p in zip(self.block, self.parts)]) if len(cells) else np.zeros(0, dtype=np.int64)
        #: The label that all points of a cell have, and which cells have one.
        self.only: tuple[np.ndarray, np.ndarray] | None = None

    def labelled(self, only: dict[int, int]) -> Cells:
        """The same with the label of each cell whose points have only one: queries of that label don't open it."""
        out = copy.copy(self)
        out.only = np.array([only.get(int(c), 0) for c in self.cells], dtype=np.int64), np.array([int(c) in only for c in self.cells], dtype=bool)
        return out

    def foreign(self, found: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Which of the cells ``found`` may hold a point that doesn't have the query's label."""
        return found if self.only is None else found & ~(self.only[1] & (self.only[0] == label[:, None]))

    def of(self, cells: np.ndarray) -> Cells:
        """The same of some of the cells, and of their centres only."""
        at = np.flatnonzero(np.isin(self.cells, cells))
        used = np.unique(self.lists[at][self.lists[at] >= 0])
        lists = np.where(self.lists[at] < 0, -1, np.searchsorted(used, self.lists[at]))
        out = type(self)(self.centres[used], self.cells[at], lists, self.low[at], self.high[at], self.n[at])
        out.only = None if self.only is None else (self.only[0][at], self.only[1][at])
        return out

    def _gaps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least possible distance of each row from what each cell holds, and its distance from the cell's centre."""
        own = np.zeros((len(x), len(self.cells))) if not len(self.centres) else _distances(x, self.centres)[:, np.maximum(self.lists, 0)]
        return np.maximum(0.0, np.maximum(own - self.high, self.low - own)), own

    def open_within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Which cells may hold something within the radius of each row of ``x``."""
        return self._within(x, radius) if len(self.cells) else np.zeros((len(x), 0), dtype=bool)

    def _within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        zero = self.lists < 0
        own = np.zeros((len(x), len(self.cells))) if not len(self.centres) else _distances(x, self.centres)[:, np.maximum(self.lists, 0)]
        found = (own - radius[:, None] <= self.high + 1e-7) & (own + radius[:, None] >= self.low - 1e-7)
        # lengths of 0 are outside of the metric: their cell is open to all, and to them every cell
        return found | zero | ~x.any(axis=1)[:, None]

    def open_nearest(self, x: np.ndarray, least: int) -> np.ndarray:
        """The cells nearest to each row of ``x`` by their least possible distance, until they hold ``least`` points."""
        if not len(self.cells):
            return np.zeros((len(x), 0), dtype=bool)
        gap, own = self._gaps(x)
        order = np.lexsort((own, gap), axis=1)
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        found = np.zeros(own.shape, dtype=bool)
        np.put_along_axis(found, order, before < least, axis=1)
        return found | (self.lists < 0) | ~x.any(axis=1)[:, None]


class Boxes(Cells):
    """Cells that are boxes: ``low`` and ``high`` have a row of the least and greatest numbers for each, ``centres`` are their middles."""

    def _gaps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = np.zeros((len(x), len(self.cells)))
        for k in range(x.shape[1]):
            square += np.maximum(0.0, np.maximum(self.low[:, k] - x[:, k, None], x[:, k, None] - self.high[:, k])) ** 2
        own = np.zeros(square.shape) if not len(self.centres) else _distances(x, self.centres)[:, np.maximum(self.lists, 0)]
        return np.sqrt(square), own

    def _within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        return (self._gaps(x)[0] <= radius[:, None] + 1e-7) | (self.lists < 0) | ~x.any(axis=1)[:, None]


class Halves:
    """Halves of halves of a sample along the widest side; ``of`` gives the leaf of each row."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.axis, self.border, self.inner, self.leaves = [], [], [], 0
        self._cut(x, leaves)

    def _cut(self, x: np.ndarray, leaves: int) -> int:
        node = len(self.axis)
        self.axis.append(-1), self.border.append(0.0), self.inner.append((self.leaves, self.leaves))
        side = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(1)
        axis = int(side.argmax())
        values = np.unique(x[:, axis]) if leaves > 1 and side[axis] > 0 else []
        if len(values) < 2:
            self.leaves += 1
            return node
        border = min(float(np.quantile(x[:, axis], 1 - leaves // 2 / leaves)), float(values[-2]))  # something lies beyond it
        self.axis[node], self.border[node] = axis, border
        own = x[:, axis] <= border
        self.inner[node] = (self._cut(x[own], leaves - leaves // 2), self._cut(x[~own], leaves // 2))
        return node

    def of(self, x: np.ndarray) -> np.ndarray:
        axis, border, inner = np.array(self.axis), np.array(self.border), np.array(self.inner)
        node = np.zeros(len(x), dtype=np.int64)
        while (axis[node] >= 0).any():
            left = x[np.arange(len(x)), np.maximum(axis[node], 0)] <= border[node]
            node = np.where(axis[node] < 0, node, inner[node, np.where(left, 0, 1)])
        return inner[node, 0]


class VectorIndex:
    """Points in cells: ``members`` has ``id``, ``v`` (at length 1), ``list``, ``cell`` and ``block``, stored by block."""

    def __init__(self, spark: SparkSession, members: DataFrame, held: Cells):
        self.spark, self.members, self.held = spark, members, held

    @staticmethod
    def build(spark: SparkSession, points: DataFrame, key: str = "vec_id", vector: str = "embedding", lists: int | None = None) -> VectorIndex:
        """Index of all points with a key and a whole vector; vectors of different lengths are an error.

        There are about as many lists as a list has points, ``MOST_LISTS`` at most.
        """
        rows = _usable(points, key, vector)
        sizes = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
        if sizes.least != sizes.most:
            raise ValueError(f"vectors of different lengths: {[sizes.least, sizes.most]}")
        given, lists = lists, min(MOST_LISTS, lists or max(1, round(sizes.n**0.5)))
        sample = rows.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(FIT_POINTS).select("v").toArrow()
        if given is None and sizes.most is not None and 0 < sizes.most <= LOW_DIMENSIONS:
            return VectorIndex._boxed(spark, rows, matrix(sample.column("v").combine_chunks()), sizes.n, sizes.most)
        centres = _fit(matrix(sample.column("v").combine_chunks()), lists)
        shared = spark.sparkContext.broadcast(centres)

        def place(batches):
            for batch in batches:
                x = matrix(batch.column("v"))
                some = x.any(axis=1) if len(x) else np.zeros(0, dtype=bool)
                near, far = np.full(len(x), -1), np.zeros(len(x))
                if some.any():
                    own = _distances(x[some], shared.value)
                    near[some] = own.argmin(1)
                    far[some] = own[np.arange(len(own)), near[some]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far)], ["id", "v", "list", "d"])

        placed = saved(spark, rows.mapInArrow(place, "id long, v array<double>, list int, d double"))
        # a ring's borders are quantiles, so a list is cut evenly wherever its points lie
        shares = F.array(*(F.lit(k / RINGS) for k in range(1, RINGS)))
        borders = placed.groupBy("list").agg(F.percentile_approx("d", shares, F.lit(1000)).alias("borders"), F.count("*").alias("size"))
        step = F.greatest(F.lit(1), F.ceil(F.lit(RINGS * RING_POINTS) / F.col("size"))).cast("int")
        ring = F.when(F.col("size") < 2 * RING_POINTS, 0).otherwise(F.floor(F.size(F.filter("borders", lambda b: b < F.col("d"))) / step))
        ringed = placed.join(F.broadcast(borders), "list").select("id", "v", "list", "d", (F.col("list") * RINGS + ring).cast("int").alias("cell"))
        cells = saved(spark, ringed.groupBy("cell").agg(F.first("list").alias("list"), F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n")))
        place_of = {c: k for k, c in enumerate(_near_order(centres))}
        found = sorted(cells.collect(), key=lambda r: (place_of.get(r.list, -1), r.cell))  # a bounded number, see above
        most = min(TASK_POINTS, max(BLOCK_POINTS, -(-sizes.n // BLOCKS)))
        blocks = _blocks([r.n for r in found], most)
        named = spark.createDataFrame([(r.cell, *b) for r, b in zip(found, blocks)], "cell int, block int, parts int")
        dealt = ringed.join(F.broadcast(named), "cell").select("id", "v", "list", "cell", (F.col("block") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"))
        members = saved(spark, dealt.repartition("block").sortWithinPartitions("block", "cell"))
        drop(placed, cells)
        columns = [(np.int32, [r.cell for r in found]), (np.int32, [r.list for r in found]), (float, [r.low for r in found]), (float, [r.high for r in found]), (np.int64, [r.n for r in found]), (np.int32, [b[0] for b in blocks]), (np.int32, [b[1] for b in blocks])]
        return VectorIndex(spark, members, Cells(centres, *(np.array(c, dtype=t) for t, c in columns)))

    @staticmethod
    def _boxed(spark: SparkSession, rows: DataFrame, sample: np.ndarray, n: int, dimensions: int) -> VectorIndex:
        """The index with boxes: borders come from the sample, and their sides from all points."""
        most = min(BOX_POINTS, max(BLOCK_POINTS, -(-n // BLOCKS)))
        shared = spark.sparkContext.broadcast(Halves(sample.reshape(-1, dimensions), min(MOST_LISTS, -(-n // most))))

        def place(batches):
            for batch in batches:
                x = matrix(batch.column("v")).reshape(batch.num_rows, -1)
                cell = np.where(x.any(axis=1), shared.value.of(x), -1) if len(x) else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["id", "v", "cell"])

        placed = saved(spark, rows.mapInArrow(place, "id long, v array<double>, cell int"))
        sides = [f(F.get("v", k)).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in range(dimensions)]
        found = placed.groupBy("cell").agg(F.count("*").alias("n"), *sides).orderBy("cell").collect()  # at most ``MOST_LISTS`` and one
        # neighbours in the order of the halves are near; a box of equal points may need several blocks
        first, blocks = 0, []
        for r in found:
            blocks.append((first, max(1, -(-r.n // TASK_POINTS))))
            first += blocks[-1][1]
        named = spark.createDataFrame([(r.cell, *b) for r, b in zip(found, blocks)], "cell int, block int, parts int")
        dealt = placed.join(F.broadcast(named), "cell").select("id", "v", F.col("cell").alias("list"), "cell", (F.col("block") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"))
        members = saved(spark, dealt.repartition("block").sortWithinPartitions("block", "cell"))
        drop(placed)
        low, high = (np.array([[r[f"{name}{k}"] for k in range(dimensions)] for r in found], dtype=float).reshape(-1, dimensions) for name in ("low", "high"))
        cells = np.array([r.cell for r in found], dtype=np.int32)
        return VectorIndex(spark, members, Boxes((low + high) / 2, cells, np.where(cells < 0, -1, np.arange(len(cells))), low, high, np.array([r.n for r in found], dtype=np.int64), np.array([b[0] for b in blocks], dtype=np.int32), np.array([b[1] for b in blocks], dtype=np.int32)))

    # --- searches ---------------------------------------------------------------------

    def probes(self, queries: DataFrame, choose: Callable[[Cells, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """``queries`` (``id``, ``v`` at length 1, ``radius``, ``label``, ``core``) with the cells that ``choose`` opens, in a column ``cells``."""
        return self._opened(queries, choose, lambda held, found: [held.cells[f] for f in found], "cells")

    def _opened(self, queries: DataFrame, choose, name, column: str, held: Cells | None = None) -> DataFrame:
        """``queries`` with ``near``, their nearest centre, and what ``name`` says of the cells that ``choose`` opens."""
        shared = self.spark.sparkContext.broadcast(held or self.held)

        def run(batches):
            for whole in batches:
                for batch in (whole.slice(at, STEP) for at in range(0, whole.num_rows, STEP)):
                    held, x = shared.value, matrix(batch.column("v"))
                    opened = choose(held, x, _radius(batch.column("radius")))
                    found = pa.array(name(held, held.foreign(opened, batch.column("label").to_numpy(zero_copy_only=False))), pa.list_(pa.int32()))
                    near = _distances(x, held.centres).argmin(1) if len(held.centres) else np.zeros(len(x), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), found], [*batch.schema.names, "near", column])

        return queries.select(*_QUERY).mapInArrow(run, f"id long, v array<double>, radius double, label long, core double, near int, {column} array<int>")

    def meet(self, queries: DataFrame, choose, kernel, schema: str, members: DataFrame | None = None, onward: bool = False, held: Cells | None = None) -> DataFrame:
        """What ``kernel()`` makes of the points of each block and the queries for which ``choose`` opens a cell there.

        It is called with points and queries, dictionaries of arrays ``id``, ``v``, ``label``,
        ``core`` and ``near`` (``v`` in single precision; of queries also ``radius``), and once
        without any when a task's queries have all come by.  ``members`` may be the index's own
        with columns ``label`` and ``core``.  ``onward`` leaves out blocks before the query's ``label``.
        ``held`` may be the index's own cells with labels.
        """
        members = self.members.select("*", F.lit(None).cast("long").alias("label"), F.lit(None).cast("double").alias("core")) if members is None else members
        blocks = lambda held, found: [np.unique(held.in_block[f[held.shares]]) for f in found]
        asked = self._opened(queries, choose, blocks, "blocks", held).withColumn("block", F.explode("blocks")).drop("blocks")
        asked = asked.where("block >= label") if onward else asked
        # short vectors are written sooner than they are looked up again
        asked = saved(self.spark, asked) if isinstance(self.held, Boxes) else asked
        # a row a block: its first task, and how many tasks its queries are dealt to
        plan, tasks = [], 0
        for r in sorted(asked.groupBy("block").agg(F.count("*").alias("q")).collect(), key=lambda r: r.block):
            plan.append((r.block, tasks, -(-r.q // TASK_QUERIES)))
            tasks += plan[-1][2]
        if not plan:
            return self.spark.createDataFrame([], schema)
        placed = F.broadcast(self.spark.createDataFrame(plan, "block int, first int, slices int"))
        own = members.join(placed, "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        own = own.select((F.col("first") + F.col("slice")).alias("task"), F.lit(0).alias("kind"), F.col("cell").alias("near"), "id", "v", F.lit(None).cast("double").alias("radius"), "label", "core")
        theirs = asked.join(placed, "block").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
        theirs = theirs.select((F.col("first") + F.col("slice")).alias("task"), F.lit(1).alias("kind"), "near", *_QUERY)
        both = own.unionByName(theirs).repartition(tasks, "task").sortWithinPartitions("task", "kind", "near", "id")
        return both.mapInArrow(_met(kernel, choose, self.spark.sparkContext.broadcast(held or self.held)), schema)

    def within(self, queries: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """All points with a cosine of at least ``least``: ``query_id``, ``id``, ``score``."""

        def kernel(points=None, asked=None):
            if points is not None:
                i, j, scores = near(points, asked, np.full(len(asked["id"]), least))
                return pa.table({"query_id": asked["id"][i], "id": points["id"][j], "score": scores})

        return self.meet(self._ranged(queries, least, key, vector), Cells.open_within, lambda: kernel, "query_id long, id long, score double")

    def _ranged(self, queries: DataFrame, least: float, key: str, vector: str) -> DataFrame:
        radius = F.lit(float(reach(least))) if least > 0 else F.lit(None).cast("double")
        return _plain(_usable(queries, key, vector)).withColumn("radius", radius)

    def _asked(self, queries: DataFrame, least: float, key: str, vector: str) -> DataFrame:
        return self.probes(self._ranged(queries, least, key, vector), Cells.open_within)

    def pairs(self, least: float, make=None, schema: str = "a long, b long, score double") -> DataFrame:
        """All pairs ``a < b`` of indexed points with a cosine of at least ``least``: ``a``, ``b``, ``score``; or what ``make()`` makes of a task's pairs.

        Each pair of blocks meets once.
        """
        make = make or (lambda: lambda a=None, b=None, score=None: None if a is None else pa.table({"a": a, "b": b, "score": score}))

        def kernel():
            of = make()

            def run(points=None, asked=None):
                if points is None:
                    return of()
                i, j, scores = near(points, asked, np.full(len(asked["id"]), least))
                keep = (asked["label"][i] != points["label"][j]) | (asked["id"][i] < points["id"][j])
                a, b = asked["id"][i[keep]], points["id"][j[keep]]
                return of(np.minimum(a, b), np.maximum(a, b), scores[keep])

            return run

        label = F.col("block").cast("long").alias("label")
        members = self.members.select("id", "v", "cell", "block", label, F.lit(None).cast("double").alias("core"))
        radius = F.lit(float(reach(least))) if least > 0 else F.lit(None).cast("double")
        return self.meet(members.withColumn("radius", radius), Cells.open_within, kernel, schema, members, onward=True)

    def nearest(self, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", skip_self: bool = True) -> tuple[DataFrame, DataFrame]:
        """The ``k`` best points of each query (``query_id``, ``id``, ``score``, ``rank``), and the cells that each opened (``query_id``, ``opened``).

        The nearest cells give a first ``k``; the score of the last bounds how far a better
        one can be, and the cells within that distance are searched.  Scores are rounded
        before ranking and ties go to the smaller key, as in a scan.
        """
        asked = saved(self.spark, _plain(_usable(queries, key, vector)))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        ranked = lambda hits: hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        schema, best = "query_id long, id long, score double", _best(k, skip_self)
        first = saved(self.spark, ranked(self.meet(asked, lambda cells, x, _: cells.open_nearest(x, 2 * (k + 1)), best, schema)))
        # not even a score of -1 is out of reach where there are fewer than k
        reached = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("score") - SLACK)))
        limit = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), reached.alias("_radius"))
        again = saved(self.spark, asked.join(limit, "id", "left").withColumn("radius", F.col("_radius")).select(*_QUERY))
        hits = ranked(self.meet(again, Cells.open_within, best, schema))
        return hits, self.probes(again, Cells.open_within).select(F.col("id").alias("query_id"), F.size("cells").alias("opened"))


_QUERY = ["id", "v", "radius", "label", "core"]


def _plain(queries: DataFrame) -> DataFrame:
    """Queries without a radius and without what only some kernels read."""
    return queries.select("id", "v", F.lit(None).cast("double").alias("radius"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("double").alias("core"))


def _radius(column) -> np.ndarray:
    return column.fill_null(_EVERYWHERE).to_numpy(zero_copy_only=False)


def least_score(asked: dict) -> np.ndarray:
    """The cosine at each query's radius."""
    radius = asked["radius"]
    return np.where(radius >= _EVERYWHERE, -np.inf, 1 - radius * radius / 2)


def near(points: dict, asked: dict, least: np.ndarray, apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, point and rounded cosine of all pairs with at least the query's ``least``, of different labels only if ``apart``.

    Products in single precision say which pairs may have it, by more than their error;
    only these are computed in double precision.
    """
    rough = asked["v32"] @ points["v32"].T
    slack = (rough.shape[1] > 0) * (asked["v"].shape[1] + 16) * 1.2e-7 + 1e-6
    likely = rough >= (least - slack)[:, None].astype(np.float32)
    if apart:
        likely &= asked["label"][:, None] != points["label"]
    i, j = np.nonzero(likely)
    if len(i) > rough.size // 16:
        scores = np.round(asked["v"] @ points["v"].T, DIGITS) + 0.0
        i, j = np.nonzero(likely & (scores >= least[:, None]))
        return i, j, scores[i, j]
    parts = [np.einsum("ij,ij->i", asked["v"][i[at : at + 8192]], points["v"][j[at : at + 8192]]) for at in range(0, len(i), 8192)]
    scores = np.round(np.concatenate(parts), DIGITS) + 0.0 if parts else np.zeros(0)
    keep = scores >= least[i]
    return i[keep], j[keep], scores[keep]


def _best(k: int, skip_self: bool):
    """The ``k`` best points of each query within its radius, the smaller ids first among equal scores."""

    def kernel(points=None, asked=None):
        if points is None:
            return None
        least = least_score(asked)
        if np.isinf(least).any():  # the k-th score of those that are here
            scores = np.round(asked["v"] @ points["v"].T, DIGITS) + 0.0
            if skip_self:
                scores[asked["id"][:, None] == points["id"]] = -np.inf
            most = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if scores.shape[1] > k else np.full(len(scores), -np.inf)
            i, j = np.nonzero((scores >= np.maximum(least, most)[:, None]) & (scores > -np.inf))
            own = scores[i, j]
        else:
            i, j, own = near(points, asked, least)
            if skip_self:
                keep = asked["id"][i] != points["id"][j]
                i, j, own = i[keep], j[keep], own[keep]
        if len(i) > 16 * k * max(1, len(asked["id"])):  # many are as near: only the best of each query are put in order
            rank = np.empty(len(points["id"]), dtype=np.int64)
            rank[np.argsort(points["id"], kind="stable")] = np.arange(len(rank))
            most = np.iinfo(np.int64).max
            place = np.full((len(asked["id"]), len(rank)), most)
            place[i, j] = (np.rint((2 - own) * 10**DIGITS).astype(np.int64) << 32) | rank[j]
            score = np.empty(place.shape)
            score[i, j] = own
            j = np.argpartition(place, min(k, len(rank)) - 1, axis=1)[:, :k]
            i = np.repeat(np.arange(len(j)), j.shape[1])
            j = j.ravel()
            real = place[i, j] < most
            i, j = i[real], j[real]
            own = score[i, j]
        order = np.lexsort((points["id"][j], -own, i))
        i, j, own = i[order], j[order], own[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return pa.table({"query_id": asked["id"][i[keep]], "id": points["id"][j[keep]], "score": own[keep]})

    return lambda: kernel


def arrays(table: pa.Table) -> dict:
    """The rows as arrays, the vectors in both precisions."""
    out = {c: table.column(c).to_numpy() for c in ("id", "label", "core", "near")}
    out |= {"radius": _radius(table.column("radius")), "v": matrix(table.column("v").combine_chunks())}
    return out | {"v32": out["v"].astype(np.float32)}


def _met(kernel, choose, shared):
    """Holds the points of a block while its queries come by."""

    def opened(points: dict, cells: Cells, asked: dict) -> dict | None:
        """The points of the cells that any of the queries opens."""
        found = cells.foreign(choose(cells, asked["v"], asked["radius"]), asked["label"]).any(axis=0)
        mask = np.isin(points["near"], cells.cells[found])
        if not mask.any():
            return None
        return points if mask.mean() > 0.8 else {c: x[mask] for c, x in points.items()}

    def run(batches):
        held: list[pa.Table] = []
        current, points, cells, of = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            keys = np.stack([whole.column(c).to_numpy() for c in ("task", "kind")])
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), whole.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                own, rows = int(keys[0, a]), whole.slice(a, b - a)
                if own != current:
                    yield from _batches(of()) if of else ()
                    current, points, held, of = own, None, [], kernel()
                if keys[1, a] == 0:
                    held.append(rows)
                elif held:
                    if points is None:
                        points = arrays(pa.concat_tables(held))
                        cells = shared.value.of(np.unique(points["near"]))
                    for at in range(0, rows.num_rows, STEP):
                        asked = arrays(rows.slice(at, STEP))
                        mine = opened(points, cells, asked)
                        if mine is not None:
                            yield from _batches(of(mine, asked))
        yield from _batches(of()) if of else ()

    return run


def _batches(found: pa.Table | None) -> list[pa.RecordBatch]:
    return found.combine_chunks().to_batches() if found is not None and found.num_rows else []
