"""Nearest neighbours, fused multi-query ranking, similarity joins and classification."""

from __future__ import annotations

import heapq
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lorespark.functions import vectors
from lorespark.operators import graph
from lorespark.operators.vector_index import VectorIndex

#: Rows of a tile of the all-pairs product, and blocks of tiles; a group has two blocks, and holds the product of two tiles at a time.
BLOCK = 1024
BLOCKS = 16
#: Points of a block at most; more points make more blocks.
MOST_BLOCK = 65_536
TASKS_PER_CORE = 4
#: Blocks of points up to which all pairs are multiplied without an index.
PRODUCT_BLOCKS = 16
#: Query vectors or classes that are held by every task at once; more are taken in blocks.
MOST_QUERIES = 20_000
#: Scores that a search holds at once, at least those of 1,024 points.
MOST_SCORES = 1 << 22
DIGITS = 6


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(column):
        return flat.reshape(0, 0)
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)[:5]}")
    return flat.reshape(len(column), -1)


def usable(points: DataFrame, key: str, vector: str) -> DataFrame:
    """Points with a key and a vector; null vectors, and those with a null number, are skipped by every search."""
    return points.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _shared(spark: SparkSession, rows: list):
    """The keys and unit vectors of rows (key, ``v``), in order of the keys, broadcast."""
    rows = sorted(rows, key=lambda r: r[0])
    if len(sizes := {len(r.v) for r in rows}) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)[:5]}")
    return spark.sparkContext.broadcast(([r[0] for r in rows], _unit(np.array([r.v for r in rows], dtype=np.float64)) if rows else np.zeros((0, 0))))


def knn(spark: SparkSession, points: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", skip_self: bool = True) -> DataFrame:
    """The ``k`` points most similar to each query: ``query_id``, ``key``, ``score``, ``rank``.

    Scores are rounded before ranking, and ties go to the smaller key.  Filter ``points``
    first to search a part of them.  Every task keeps its own best ``k`` for each query,
    so what is shuffled doesn't grow with the points.  Queries are searched in blocks of
    ``MOST_QUERIES``, each in its own pass over the points.  Null vectors are skipped, and
    vectors of different lengths are an error.
    """
    points = usable(points, key, vector)
    stream = usable(queries, key, vector).select(F.col(key).cast("long").alias("id"), vectors.doubles(F.col(vector)).alias("v")).toLocalIterator()
    blocks = iter(lambda: list(islice(stream, MOST_QUERIES)), [])
    found = [_search(points, _shared(spark, rows), k, key, vector, skip_self) for rows in blocks]
    return reduce(DataFrame.union, found) if found else _search(points, _shared(spark, []), k, key, vector, skip_self)


def _search(points: DataFrame, shared, k: int, key: str, vector: str, skip_self: bool) -> DataFrame:
    def run(batches):
        names, matrix = shared.value
        best: list[list] = [[] for _ in names]
        step = max(1024, MOST_SCORES // max(1, len(names)))
        for whole in batches:
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows if names else 0, step)):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                scores = np.round(_unit(_matrix(batch.column(1))) @ matrix.T, DIGITS) + 0.0
                for q, name in enumerate(names):
                    own = scores[:, q]
                    if skip_self:
                        own = np.where(ids == name, -np.inf, own)
                    near = np.argpartition(-own, min(k, len(own)) - 1)[:k] if len(own) > k else np.arange(len(own))
                    near = np.flatnonzero(own >= own[near].min()) if len(own) > k else near
                    for i in near:
                        if own[i] > -np.inf:
                            item = (own[i], -int(ids[i]))
                            heapq.heappush(best[q], item) if len(best[q]) < k else heapq.heappushpop(best[q], item)
        rows = [(name, -i, s) for name, found in zip(names, best) for s, i in found]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", key, "score"])

    local = points.select(F.col(key).cast("long"), vectors.doubles(F.col(vector))).mapInArrow(run, f"query_id long, {key} long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(hits: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row for each point that any query found: best score, number of queries, score times number, and the score by query."""
    return hits.groupBy(key).agg(
        F.max("score").alias("score"),
        F.count("*").alias("hit_count"),
        F.round(F.max("score") * F.count("*"), DIGITS).alias("weighted"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("query_id", "score")))).alias("scores_by_query"),
    )


def hits_by_query(fused: DataFrame) -> DataFrame:
    """How many fused results each query found."""
    return fused.select(F.explode(F.map_keys("scores_by_query")).alias("query_id")).groupBy("query_id").agg(F.count("*").alias("hits"))


def similar_pairs(points: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, indexed: bool | None = None) -> DataFrame:
    """All pairs ``a < b`` with a cosine of at least ``least``, as ``a``, ``b``, ``score``.

    Points of more than ``PRODUCT_BLOCKS`` blocks are compared within the cells of an exact
    index that the threshold leaves open to them; fewer are multiplied block by block,
    which costs less than the index does.  The rows are the same; ``indexed`` chooses.
    """
    if indexed or (indexed is None and _many(points, key, vector, block)):
        return VectorIndex.build(points.sparkSession, points, key, vector).pairs(least)

    def reached(tiles):
        for a, b, scores, pairs in tiles:
            scores = np.round(scores, DIGITS) + 0.0
            i, j = np.nonzero((scores >= least) & pairs)
            yield _pairs(a[i], b[j], scores[i, j])

    return _products(points, reached, "a long, b long, score double", key, vector, block)


def _many(points: DataFrame, key: str, vector: str, block: int) -> bool:
    return usable(points, key, vector).limit(PRODUCT_BLOCKS * block + 1).count() > PRODUCT_BLOCKS * block


#: Links of a task from which it keeps only what connects the same points.
MOST_LINKS = 1 << 20


class _Links:
    """What connects the points of the pairs that come by: each point and the least one of its component."""

    def __init__(self):
        self.held, self.n = [], 0

    def __call__(self, a=None, b=None, score=None) -> pa.Table | None:
        if a is not None:
            self.held.append((a, b))
            self.n += len(a)
        if self.held and (a is None or self.n > MOST_LINKS):
            points, first = graph.least_nodes(*(np.concatenate(x) for x in zip(*self.held)))
            apart = points != first
            # a task's links stay fewer than its points
            self.held, self.n = [(first[apart], points[apart])], 0
        return pa.table(dict(zip("ab", self.held[0]))) if a is None and self.held else None


def links(points: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, indexed: bool | None = None) -> DataFrame:
    """Pairs ``a``, ``b`` that connect the same points as all pairs with a cosine of at least ``least``.

    Of more points than are multiplied without an index, a task sends fewer links than it
    has points, however many pairs it finds.
    """
    if indexed or (indexed is None and _many(points, key, vector, block)):
        return VectorIndex.build(points.sparkSession, points, key, vector).pairs(least, _Links, "a long, b long")
    return similar_pairs(points, least, key, vector, block, False).select("a", "b")


def _pairs(a: np.ndarray, b: np.ndarray, scores: np.ndarray) -> pa.Table:
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": scores})


def first_pairs(points: DataFrame, most: int, near: float | None = None, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The ``most`` pairs with the highest cosines, or with those nearest to ``near``: each pair of blocks sends its own first ones."""

    def far_from(scores):
        return -scores if near is None else np.round(np.abs(scores - near), DIGITS)

    def first(tiles):
        held, worst = _pairs(*(np.zeros(0, t) for t in (np.int64, np.int64, float))), np.inf
        for a, b, scores, pairs in tiles:
            # what is clearly behind the last one held needs no rounding
            i, j = np.nonzero(((-scores if near is None else np.abs(scores - near)) <= worst + 2e-6) & pairs)
            own = np.round(scores[i, j], DIGITS) + 0.0
            far = far_from(own)
            if len(far) > most:
                taken = np.flatnonzero(far <= np.partition(far, most - 1)[most - 1])
                i, j, own = i[taken], j[taken], own[taken]
            if len(own):
                both = pa.concat_tables([held, _pairs(a[i], b[j], own)])
                far = far_from(both.column("score").to_numpy())
                order = np.lexsort((both.column("b").to_numpy(), both.column("a").to_numpy(), far))[:most]
                held, worst = both.take(order), far[order[-1]] if len(order) == most else np.inf
        yield held

    found = _products(points, first, "a long, b long, score double", key, vector, block)
    far = F.desc("score") if near is None else F.round(F.abs(F.col("score") - near), DIGITS)
    return found.orderBy(far, "a", "b").limit(most)


def score_counts(points: DataFrame, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """How many of all pairs have each rounded cosine: ``score``, ``n``; at most two million rows, however many pairs."""

    def count(tiles):
        scale = 10**DIGITS
        n = np.zeros(2 * scale + 1, dtype=np.int64)
        for _, _, scores, pairs in tiles:
            own = scores if pairs is True else scores[pairs]
            n += np.bincount((np.rint(own * scale).astype(np.int64) + scale).ravel(), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.table({"score": (at - scale) / scale, "n": n[at]})

    return _products(points, count, "score double, n long", key, vector, block).groupBy("score").agg(F.sum("n").alias("n"))


def _products(points: DataFrame, make, schema: str, key: str, vector: str, block: int) -> DataFrame:
    """What ``make`` yields of the tiles of each pair of blocks: ids of both sides, their cosines, and which of these are pairs of different points, or true.

    A blocked matrix product: each pair of blocks is one group, of two bounded blocks, which
    are multiplied tile by tile.  There are ``BLOCKS`` blocks or more, so a point is sent that
    often.  The number of pairs grows with the square of the points, as the operation asks
    for; restrict ``points`` to a candidate set for large collections.
    """
    points = usable(points, key, vector)
    count = points.count()
    blocks = max(1, -(-count // max(block, min(MOST_BLOCK, -(-count // BLOCKS)))))
    rows = points.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))
    others = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("b", o).alias("x"), F.greatest("b", o).alias("y")))
    spread = rows.withColumn("pair", F.explode(others)).select("pair.x", "pair.y", "b", "id", "v")

    def product(key_, table):
        table = table.combine_chunks()
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        ids, b = table.column("id").to_numpy()[order], table.column("b").to_numpy()[order]
        m = _unit(_matrix(table.column("v").chunk(0))[order])
        x, y = key_[0].as_py(), key_[1].as_py()
        left, right = np.flatnonzero(b == x), np.flatnonzero(b == y)

        def tiles():
            for p in range(0, len(left), block):
                for q in range(p if x == y else 0, len(right), block):
                    i, j = left[p : p + block], right[q : q + block]
                    yield ids[i], ids[j], m[i] @ m[j].T, ids[i][:, None] < ids[j] if x == y else True

        return pa.concat_tables([pa.table(schema=made, data={c: [] for c in made.names}), *(t.cast(made) for t in make(tiles()))])

    made = to_arrow_schema(StructType.fromDDL(schema))
    # a group's work is the square of its bytes, so their number says how many tasks there are
    tasks = min(blocks * (blocks + 1) // 2, TASKS_PER_CORE * points.sparkSession.sparkContext.defaultParallelism)
    return spread.repartition(tasks, "x", "y").groupBy("x", "y").applyInArrow(product, schema)


def counted_distribution(counts: DataFrame, value: str = "score", n: str = "n") -> DataFrame:
    """Linear percentiles, extremes, mean and population deviation of a column whose distinct values come with their counts."""
    points = [5, 25, 50, 75, 90, 95, 99]
    all_, mean = F.sum(n), F.sum(F.col(value) * F.col(n)) / F.sum(n)
    square = F.sum(F.col(value) * F.col(value) * F.col(n)) / F.sum(n)
    found = counts.agg(F.coalesce(all_, F.lit(0)).alias("n"), F.percentile(value, F.array(*(F.lit(p / 100) for p in points)), F.col(n)).alias("_p"), F.min(value).alias("lowest"), F.max(value).alias("highest"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("deviation"))
    exact = [F.round(F.get("_p", F.lit(i)), DIGITS).alias(f"p{p}") for i, p in enumerate(points)]
    return found.select("n", *exact, *(F.round(c, DIGITS).alias(c) for c in ("lowest", "highest", "mean", "deviation")))


def centroids(points: DataFrame, label: str, vector: str = "embedding", unit: bool = False) -> DataFrame:
    """Mean vector of each label: averages by place, put together in order, at length 1 with ``unit``."""
    flat = points.where(F.col(vector).isNotNull()).select(label, F.posexplode(vectors.doubles(F.col(vector))).alias("place", "x"))
    means = flat.groupBy(label, "place").agg(F.avg("x").alias("x"))
    whole = means.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("centroid"))
    return whole.withColumn("centroid", vectors.unit(F.col("centroid"))) if unit else whole


def rank_to_mean(spark: SparkSession, points: DataFrame, queries: DataFrame, most: int = 200, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``most`` points most similar to the mean of the queries: ``key``, ``score``, ``rank``."""
    mean = centroids(queries.withColumn("all", F.lit(0)), "all", vector, unit=True).select(F.lit(-1).alias(key), F.col("centroid").alias(vector))
    return knn(spark, points, mean, most, key, vector, skip_self=False).drop("query_id")


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of the rows in order; pages are numbered from 0."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def classify(spark: SparkSession, points: DataFrame, classes: DataFrame, name: str, least: float = 0.35, key: str = "vec_id", vector: str = "embedding", class_vector: str = "centroid", epsilon: float = 0.0) -> DataFrame:
    """Most similar class of every point: ``best``, ``score``, ``label`` (null under ``least``) and ``confidence``.

    Under the threshold the confidence is one less the best score.  Of equally near classes
    the first by name is best.  ``epsilon`` is added to the product of the lengths.  Null
    vectors are skipped; without classes no point has a row.
    """
    stream = usable(classes, name, class_vector).select(F.col(name).alias("id"), vectors.doubles(F.col(class_vector)).alias("v")).orderBy("id").toLocalIterator()
    blocks = iter(lambda: list(islice(stream, MOST_QUERIES)), [])

    def nearer(shared, lengths):
        def run(batches):
            names, matrix = shared.value
            for batch in batches:
                if batch.num_rows:
                    own = _matrix(batch.column("v"))
                    scores = _unit(own) @ matrix.T
                    if epsilon:
                        size = np.linalg.norm(own, axis=1)[:, None] * lengths
                        scores *= size / (size + epsilon)
                    scores = np.round(scores, DIGITS) + 0.0
                    at = scores.argmax(axis=1)
                    own = scores[np.arange(len(at)), at]
                    before = batch.column("score").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    best = [str(names[i]) if s > b else old for i, s, b, old in zip(at, own, before, batch.column("best").to_pylist())]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("v"), pa.array(best, pa.string()), pa.array(np.maximum(own, before))], [key, "v", "best", "score"])

        return run

    found = usable(points, key, vector).select(F.col(key).cast("long"), vectors.doubles(F.col(vector)).alias("v"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("score"))
    for rows in blocks:  # in the order of the names, and only a higher score is nearer
        lengths = np.array([float(np.linalg.norm(r.v)) for r in rows])
        found = found.mapInArrow(nearer(_shared(spark, rows), lengths), f"{key} long, v array<double>, best string, score double")
    found = found.drop("v").where("best is not null")
    sure = F.col("score") >= least
    return found.withColumn("label", F.when(sure, F.col("best"))).withColumn("confidence", F.when(sure, F.col("score")).otherwise(F.round(1 - F.col("score"), DIGITS)))


def match_concepts(spark: SparkSession, words: DataFrame, concepts: DataFrame, name: str, direct: float, candidate: float, **columns) -> DataFrame:
    """Direct, candidate or unmatched by the similarity to the nearest concept, which has a small number in its denominator."""
    found = classify(spark, words, concepts, name, least=-2.0, epsilon=1e-8, **columns)
    kind = F.when(F.col("score") >= direct, "direct").when(F.col("score") >= candidate, "candidate").otherwise("unmatched")
    return found.select(found.columns[0], "best", "score", kind.alias("kind"))


def variants(answer: Column, most: int = 3, least_chars: int = 5) -> Column:
    """Rephrased questions out of a model's answer: a line each without its number or mark, short ones dropped."""
    bare = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:[0-9]+[.)]|[-*•])\s*", "")))
    return F.slice(F.filter(bare, lambda x: F.length(x) > least_chars), 1, most)
