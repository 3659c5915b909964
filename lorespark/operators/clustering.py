"""Clustering of vectors: greedy centroids, neighbour components, Gaussian mixtures, summary trees."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import graph, retrieval
from lorespark.operators.tables import saved


#: Similarities that a block of points has with all centroids, at most, and points of a block.
GREEDY_SCORES, GREEDY_BLOCK = 1 << 25, 256


class _Centroids:
    """Running means of greedy clusters, with room to grow."""

    def __init__(self, least: float, size: int):
        self.least, self.n = least, 0
        self.means, self.lengths, self.counts = np.zeros((64, size)), np.zeros(64), np.zeros(64, dtype=np.int64)
        #: The means at length 1 in single precision, and twice what similarities of these are off.
        self.units, self.margin = np.zeros((64, size), dtype=np.float32), 1e-6 + size * 4e-7

    def _again(self, c: int, v: np.ndarray, length: float, least: float) -> bool:
        """Puts an equal of the point before into its cluster, if the mean has come nearer, so that no other can be better."""
        if not self.lengths[c] * length > 0 or self.means[c] @ v / (self.lengths[c] * length) < least:
            return False
        self.counts[c] += 1
        self.means[c] += (v - self.means[c]) / self.counts[c]
        self.lengths[c] = np.linalg.norm(self.means[c])
        return True

    def _moved(self, c: int) -> None:
        self.units[c] = self.means[c] / self.lengths[c] if self.lengths[c] > 0 else 0

    def _put(self, v: np.ndarray, length: float, near: np.ndarray) -> tuple[int, float]:
        """The most similar running mean of at least ``least``, the first of equals, or else a new cluster; ``near`` are all that can be it, in their order.

        Also the similarity from which an equal of the point is sure to follow it.
        """
        if len(near):
            size = self.lengths[near] * length
            scores = np.divide(self.means[near] @ v, size, out=np.zeros(len(near)), where=size > 0)
            k = int((scores >= scores.max() - 1e-9).argmax())
            if scores[k] >= self.least:
                best = int(near[k])
                self.counts[best] += 1
                self.means[best] += (v - self.means[best]) / self.counts[best]
                self.lengths[best] = np.linalg.norm(self.means[best])
                return best, float(scores[k])
        n = self.n
        if n == len(self.means):
            self.means, self.lengths, self.counts, self.units = (np.concatenate([x, np.zeros_like(x)]) for x in (self.means, self.lengths, self.counts, self.units))
        self.means[n], self.lengths[n], self.counts[n], self.n = v, length, 1, n + 1
        return n, self.least + 1e-9

    def place(self, vectors: np.ndarray) -> list[int]:
        """Clusters of points, one after another.

        A block of points is multiplied with all centroids in single precision, and then
        with each that a point of the block moves or makes.  Only centroids within the
        error of a point's best are compared in double precision.  A run of equal points is
        compared once.
        """
        out: list[int] = []
        while len(out) < len(vectors):
            block = vectors[len(out) : len(out) + min(GREEDY_BLOCK, max(16, GREEDY_SCORES // max(1, self.n)))]
            lengths = np.linalg.norm(block, axis=1)
            unit = np.divide(block, lengths[:, None], out=np.zeros_like(block), where=lengths[:, None] > 0).astype(np.float32)
            equal = [*(block[1:] == block[:-1]).all(1).tolist(), False]
            scores = np.empty((len(block), self.n + len(block)), dtype=np.float32)
            np.matmul(unit, self.units[: self.n].T, out=scores[:, : self.n])
            k = 0
            while k < len(block):
                v = block[k]
                row = scores[k, : self.n]
                top = row.max(initial=-2)
                near = np.flatnonzero(row >= top - self.margin) if top >= self.least - self.margin else row[:0].astype(np.int64)
                c, least = self._put(v, lengths[k], near)
                out.append(c)
                while equal[k] and self._again(c, v, lengths[k], least):
                    k += 1
                    out.append(c)
                self._moved(c)
                k += 1
                scores[k:, c] = unit[k:] @ self.units[c]
        return out


def greedy(points: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", order: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Greedy centroid clusters of all points, in the order of ``order`` in lower case and then of the key; null vectors are skipped.

    Every point is compared with all centroids so far, so the method is one sequential
    pass: a single task reads the sorted points by batch and holds the centroids and a
    block's similarities to them only.
    The columns ``keep`` are carried along.
    """

    def run(frames):
        found = None
        for frame in frames:
            vectors = np.array(frame[vector].tolist(), dtype=np.float64)
            if len(vectors):
                found = found or _Centroids(least, vectors.shape[1])
                yield frame[[*keep, key]].assign(cluster=found.place(vectors))

    kinds = dict(points.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keep, key]) + ", cluster long"
    rows = points.where(F.col(vector).isNotNull()).select(*keep, key, vector, (F.lower(order) if order else F.lit(0)).alias("_order"))
    return rows.repartition(1).sortWithinPartitions("_order", key).mapInPandas(run, schema)


def sweep(points: DataFrame, thresholds: list[float]) -> DataFrame:
    """Number and sizes of the greedy clusters at each threshold, a task for each pass."""
    # without the shuffle the union of single partitions would put all passes into one task
    sizes = [greedy(points, t).repartition("cluster").groupBy("cluster").agg(F.count("*").alias("n")).agg(F.lit(t).alias("threshold"), F.count("*").alias("clusters"), F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singles")) for t in thresholds]
    return reduce(DataFrame.union, sizes)


def neighbour_clusters(spark: SparkSession, points: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Clusters of points joined by similarities of at least ``least``; others are alone."""
    pairs = retrieval.links(points, least, key, vector)
    found = graph.components(spark, points.select(F.col(key).cast("long").alias("node")), pairs)
    return found.select(F.col("node").alias(key), F.col("component").alias("cluster"))


def _spread(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Places of ``k`` starts of k-means that are far from each other; fewer starts are the first of them."""
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        upto = np.cumsum(far / far.sum()) if far.sum() > 0 else None
        chosen.append(int(rng.integers(len(x)) if upto is None else np.searchsorted(upto / upto[-1], rng.random(), side="right")))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def _settled(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Labels of k-means from these means."""
    labels = None
    for _ in range(20):
        # squared distances by the product, so that no array holds points, means and places at once
        near = ((means**2).sum(1) - 2 * x @ means.T).argmin(1)
        if labels is not None and (near == labels).all():
            break
        labels = near
        sums, n = np.zeros_like(means), np.bincount(labels, minlength=len(means))
        np.add.at(sums, labels, x)
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], means)
    return labels


#: Numbers of the differences from means that a fit holds at once.
MIXTURE_NUMBERS = 1 << 15
#: A point with less than this share of a component's weight is lost in the rounding of its covariance, even beside the ridge.
LEAST_SHARE = 1e-25


def _full(x: np.ndarray, resp: np.ndarray, weight: np.ndarray, ridge: float, d: int) -> np.ndarray:
    """Half the squared distance of each point from each component, and half the logarithm of its determinant, by whole covariances; ``x`` may leave out places where all is 0."""
    (n, own), k = x.shape, resp.shape[1]
    means, out = (resp.T @ x) / weight[:, None], np.empty((n, k))
    across = 0.5 * (d - own) * np.log(ridge)
    step = max(1, MIXTURE_NUMBERS // max(1, n * own))
    for at in range(0, k, step):
        c = slice(at, at + step)
        apart = x - means[c, None]
        low = np.linalg.cholesky((resp.T[c, :, None] * apart).transpose(0, 2, 1) @ apart / weight[c, None, None] + ridge * np.eye(own))
        scaled = np.linalg.solve(low, apart.transpose(0, 2, 1))
        out[:, c] = (0.5 * (scaled**2).sum(1) + np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1)[:, None] + across).T
    return out


def _thin(x: np.ndarray, resp: np.ndarray, weight: np.ndarray, held: np.ndarray, ridge: float) -> np.ndarray:
    """The same of components of few points: across the space of the ``held`` points their covariance is the ridge."""
    n, d = x.shape
    means = (resp.T @ x) / weight[:, None]
    out = np.maximum(0.0, (x**2).sum(1)[:, None] - 2 * x @ means.T + (means**2).sum(1)) / (2 * ridge) + 0.5 * d * np.log(ridge)
    points = held.sum(0)
    width, least = 2, 1  # a single point is its own mean
    while (points > least).any():
        if len(points) * points.max() * max(n, d) <= MIXTURE_NUMBERS:
            width = int(points.max())
        some = np.flatnonzero((points > least) & (points <= width))
        step = max(1, MIXTURE_NUMBERS // (width * max(n, d)))
        for at in range(0, len(some), step):
            c = some[at : at + step]
            rows = np.argsort(~held[:, c], axis=0, kind="stable")[:width].T
            share = np.where(held[rows, c[:, None]], resp[rows, c[:, None]], 0.0) / weight[c, None]
            b = np.sqrt(share)[:, :, None] * (x[rows] - means[c, None])
            wide, turned = np.linalg.eigh(b @ b.transpose(0, 2, 1))
            # along a place of less than this the ridge is all there is
            real = wide > 1e-9 * ridge
            wide = np.where(real, wide, 1.0)
            along = turned.transpose(0, 2, 1) @ (b @ x.T - (b @ means[c, :, None]))
            less = np.where(real, (1 / ridge - 1 / (wide + ridge)) / wide, 0.0)
            out[:, c] += 0.5 * (np.where(real, np.log1p(wide / ridge), 0.0).sum(1)[:, None] - (along**2 * less[:, :, None]).sum(1)).T
        width, least = 2 * width, width
    return out


def _fits(x: np.ndarray, sizes: list[int], starts: np.ndarray, rounds: int = 100, ridge: float = 1e-6) -> list[tuple[np.ndarray, float]]:
    """``fit_mixture`` for several numbers of components; a round takes the components of all that go on at once."""
    n, d = x.shape
    resp, last = [], [-np.inf] * len(sizes)
    for k in sizes:
        resp.append(np.zeros((n, k)))
        resp[-1][np.arange(n), _settled(x, x[starts[:k]])] = 1.0
    turned, going = None, list(range(len(sizes)))
    for _ in range(rounds):
        every = np.hstack([resp[f] for f in going])
        weight = every.sum(0) + 10 * np.finfo(float).eps
        held = every > LEAST_SHARE * weight
        many = 2 * held.sum(0) > d
        if many.any():
            if turned is None:  # fewer points than places lie in a space of their own number
                turned = x if n >= d else (lambda u, s, _: u * s)(*np.linalg.svd(x, full_matrices=False))
            apart = np.empty(every.shape)
            apart[:, many] = _full(turned, every[:, many], weight[many], ridge, d)
            apart[:, ~many] = _thin(x, every[:, ~many], weight[~many], held[:, ~many], ridge)
        else:
            apart = _thin(x, every, weight, held, ridge)
        every = np.log(weight / n) - 0.5 * d * np.log(2 * np.pi) - apart
        at, on = 0, []
        for f in going:
            log, at = every[:, at : at + sizes[f]], at + sizes[f]
            top = log.max(1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(log - top).sum(1))
            resp[f] = np.exp(log - total[:, None])
            mean, before, last[f] = total.mean(), last[f], total.mean()
            if abs(mean - before) >= 1e-3:
                on.append(f)
        going = on
        if not going:
            break
    numbers = [k * d * (d + 1) / 2 + k * d + k - 1 for k in sizes]
    return [(r.argmax(1), float(-2 * n * l + m * np.log(n))) for r, l, m in zip(resp, last, numbers)]


def fit_mixture(x: np.ndarray, k: int, seed: int = 42, rounds: int = 100, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Labels and Bayesian information criterion of a Gaussian mixture with full covariances.

    Components of fewer points than half the places are fitted in the space of their points,
    since across it their covariance is the ridge.
    """
    return _fits(x, [k], _spread(x, k, np.random.default_rng(seed)), rounds, ridge)[0]


def mixture_clusters(x: np.ndarray, reduction: float = 0.5) -> list[list[int]]:
    """Clusters of two or more of the mixture with the lowest criterion, near half as many as points."""
    n = len(x)
    target = max(2, int(n * reduction))
    sizes = list(range(max(2, target - 2), min(target + 2, n - 1) + 1))
    if not sizes:
        return []
    # the starts of fewer components are the first of those of more
    tried = _fits(x, sizes, _spread(x, sizes[-1], np.random.default_rng(42)))
    labels = min(zip(tried, sizes), key=lambda t: (t[0][1], t[1]))[0][0]
    found = [np.flatnonzero(labels == c).tolist() for c in sorted(set(labels.tolist()))]
    return [c for c in found if len(c) >= 2]


def first_sentences(texts: list[str], budget: int) -> str:
    """Default summary: the first sentence of each text, as long as the budget lasts."""
    out, left = [], budget
    for text in texts:
        sentence = text.replace("\n", " ").split(". ")[0].rstrip(".") + "."
        if len(sentence) > left:
            break
        out.append(sentence)
        left -= len(sentence) + 1
    return " ".join(out) or texts[0][:budget]


SEPARATOR = "\n---\n"


def token_aware(texts: list[str], summarise=first_sentences, tokens: int = 3500, chars: float = 2.5, overflow: str = "multi_stage") -> str | None:
    """Summary of texts that fit a token budget together; else by stages, or null with ``levels_only``.

    A stage packs the texts in order into groups that fit, summarises each, and goes on
    with the summaries until they fit or one is left.  Summaries that don't get fewer are
    cut to the budget.
    """
    most = int(tokens * chars)
    while True:
        if not texts:
            return ""
        if np.ceil(len(SEPARATOR.join(texts)) / chars) <= tokens:
            return summarise(texts, most)
        if overflow == "levels_only":
            return None
        groups: list[list[str]] = []
        used = 0
        for text in texts:
            added = len(text) + len(SEPARATOR)
            if groups and used + added <= most:
                groups[-1].append(text)
                used += added
            else:
                groups.append([text])
                used = len(text)
        made = [summarise(g, most) for g in groups]
        if len(made) == 1:
            return made[0]
        texts = made if len(made) < len(texts) or sum(map(len, made)) < sum(map(len, texts)) else [SEPARATOR.join(made)[:most]]


def article_summary(summaries: list[str], orphans: list[str], summarise=first_sentences, tokens: int = 3500, chars: float = 2.5, overflow: str = "multi_stage") -> str:
    """Summary of a tree's higher nodes and of the leaves in none; without the leaves if both don't fit and ``levels_only`` is asked for."""
    found = token_aware([*summaries, *orphans], summarise, tokens, chars, overflow)
    if found is None and summaries:
        found = token_aware(summaries, summarise, tokens, chars)
    return "\n\n".join(summaries) if found is None else found


def summarise_articles(tree: DataFrame, summarise=first_sentences, tokens: int = 3500, chars: float = 2.5, overflow: str = "multi_stage") -> DataFrame:
    """``article_id`` and ``summary`` of every tree (``TREE``), each article in one group."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("level", "ascending"), ("node_id", "ascending")]).to_pylist()
        held = {c for r in rows for c in r["children_ids"] or ()}
        upper = [r["text"] for r in rows if r["level"] > 0]
        orphans = [r["text"] for r in rows if r["level"] == 0 and r["node_id"] not in held]
        whole = article_summary(upper, orphans, summarise, tokens, chars, overflow)
        return pa.table({"article_id": pa.array([rows[0]["article_id"]], pa.string()), "summary": pa.array([whole], pa.string())})

    return tree.select("article_id", "node_id", "level", "text", "children_ids").groupBy("article_id").applyInArrow(run, "article_id string, summary string")


TREE = "article_id string, node_id string, level int, text string, embedding array<double>, children_ids array<string>"


#: Nodes of an article whose mixture is fitted in one group; more are first parted by nearness.
MOST_NODES = 128
#: Nodes that one task holds: the tree of an article of so many leaves is built there, and so are the last cuts of a larger one.
HELD_NODES = 2048
#: Tasks a core that fit mixtures.
TASKS_PER_CORE = 4
#: Parts into which one pass cuts a group that is too large.
PARTS = 64


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _tree_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.string())]
    names = ["article_id", "node_id", "level", "text", "embedding", "children_ids"]
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _summaries(embed, summarise, prefix: str, article: str, depth: int, names: list[str], texts: list[str], vectors: np.ndarray, reduction: float, budget: int) -> list[tuple]:
    """The nodes over the clusters of one group."""
    rows = []
    for k, members in enumerate(mixture_clusters(vectors, reduction) if len(names) > 1 else []):
        text = summarise([texts[m] for m in members], budget)
        rows.append((article, f"{prefix}{k:03d}", depth, text, list(map(float, embed(text))), [names[m] for m in members]))
    return rows


def _tree(embed, summarise, levels: int, stop: int, reduction: float, budget: int, most: int):
    """The whole tree of an article that one task holds."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node_id")
        article, names, texts = table.column("article_id")[0].as_py(), table.column("node_id").to_pylist(), table.column("text").to_pylist()
        vectors, parted_ = _vectors(table.column("embedding")), len(names) > most
        rows = [(article, name, 0, text, v, []) for name, text, v in zip(names, texts, vectors)]
        for depth in range(1, levels + 1):
            if len(names) <= stop:
                break
            if parted_:
                new, parts = [], cut(names, vectors, most)
                for part in sorted(set(parts)):
                    own = [m for m, p in enumerate(parts) if p == part]
                    new += _summaries(embed, summarise, f"{article}_summary_L{depth}_{part}.", article, depth, [names[m] for m in own], [texts[m] for m in own], vectors[own], reduction, budget)
                new.sort(key=lambda r: r[1])
            else:
                new = _summaries(embed, summarise, f"{article}_summary_L{depth}_", article, depth, names, texts, vectors, reduction, budget)
            if not new:
                break
            rows += new
            names, texts, vectors = [r[1] for r in new], [r[3] for r in new], np.array([r[4] for r in new], dtype=np.float64)
        return _tree_table(rows)

    return run


def _level(embed, summarise, depth: int, reduction: float, budget: int):
    """The summaries of one part of a level; a part of one node gives none."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node_id")
        article, part = (table.column(c)[0].as_py() for c in ("article_id", "part"))
        return _tree_table(_summaries(embed, summarise, f"{article}_summary_L{depth}_{part}.", article, depth, table.column("node_id").to_pylist(), table.column("text").to_pylist(), _vectors(table.column("embedding")), reduction, budget))

    return run


def _nearest_part(seeds: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return ((seeds**2).sum(1) - 2 * vectors @ seeds.T).argmin(1)


def _class(part: str, name: str, cuts: int) -> int:
    """A hash of a node's name, another one in each part."""
    return int(hashlib.md5(f"{part}|{name}".encode()).hexdigest()[:15], 16) % cuts


def _inner(part: str, number) -> str:
    return f"{part}{'.' if part else ''}{number}"


def cut(names: list[str], vectors: np.ndarray, most: int, part: str = "", whole: bool = False) -> list[str]:
    """The part of each node, as ``parted`` has them; names are in order, and ``whole`` says that the pass before left all in one part."""
    out, todo = [part] * len(names), [(part, np.arange(len(names)), whole)]
    while todo:
        part, at, whole = todo.pop()
        if len(at) <= most:
            continue
        cuts = min(PARTS, -(-2 * len(at) // most))
        _, first = np.unique(vectors[at], axis=0, return_index=True)
        if whole or len(first) == 1:
            to = np.array([_class(part, names[m], cuts) for m in at])
        else:
            seeds: dict[int, int] = {}
            for m in np.sort(first):  # the least node of each vector
                seeds.setdefault(_class(part, names[at[m]], cuts), m)
            to = _nearest_part(vectors[at[sorted(seeds.values())]], vectors[at])
        for number in np.unique(to):
            own, inner = at[to == number], _inner(part, number)
            for m in own:
                out[m] = inner
            todo.append((inner, own, len(own) == len(at)))
    return out


def parted(spark: SparkSession, nodes: DataFrame, most: int = MOST_NODES, held: int = HELD_NODES) -> DataFrame:
    """``nodes`` with a ``part`` of at most ``most`` nodes of one article, near to each other.

    A group that is too large is cut, a pass at a time, into up to ``PARTS`` parts.  A hash
    of a vector's least node gives classes, the first of each class is a seed, and nodes go
    to the nearest seed, so that equal vectors stay together.  A group that its vectors
    can't cut, since they are alike or the pass before left it whole, is cut by a hash of
    its nodes.  Groups of up to ``held`` nodes are cut to the end in one task.
    """
    key = ["article_id", "part"]
    done, open_ = [], nodes.withColumns({"part": F.lit(""), "before": F.lit(None).cast("long")})
    hashed = lambda cuts: F.pmod(F.conv(F.substring(F.md5(F.concat("part", F.lit("|"), "node_id").cast("binary")), 1, 15), 16, 10).cast("long"), cuts)
    names, columns = nodes.columns, [c for c in nodes.columns if c != "article_id"]
    schema = ", ".join(f"`{c}` {t}" for c, t in nodes.dtypes) + ", part string"
    while True:
        sizes = saved(spark, open_.groupBy(*key).agg(F.count("*").alias("n"), F.max("before").alias("before"), F.min("embedding").alias("one"), F.max("embedding").alias("other")))
        large = sizes.where(F.col("n") > max(most, held))
        last = large.isEmpty()
        done.append(open_ if last else open_.join(sizes.where(F.col("n") <= max(most, held)).select(key), key, "left_semi"))
        if last:
            break
        cuts = F.least(F.lit(PARTS), F.ceil(F.lit(2.0) * F.col("n") / most)).cast("int")
        alike = (F.col("one") == F.col("other")) | (F.coalesce(F.col("before") == F.col("n"), F.lit(False)))
        big = saved(spark, open_.drop("before").join(large.select(*key, "n", cuts.alias("cuts"), alike.alias("alike")), key))
        firsts = big.where("not alike").groupBy(*key, "embedding", "cuts").agg(F.min("node_id").alias("node_id"))
        classes = firsts.groupBy(*key, hashed(F.col("cuts")).alias("h")).agg(F.min(F.struct("node_id", "embedding")).alias("s"))
        seeds = classes.groupBy(*key).agg(F.sort_array(F.collect_list("s")).alias("seeds"))

        def place(batches):
            for batch in batches:
                seeds_of: dict[tuple, np.ndarray] = {}
                at = []
                for row in batch.select(["article_id", "part", "node_id", "embedding", "seeds", "alike", "cuts"]).to_pylist():
                    name = (row["article_id"], row["part"])
                    if not row["alike"] and name not in seeds_of:
                        seeds_of[name] = np.array([x["embedding"] for x in row["seeds"]], dtype=np.float64)
                    at.append(_inner(row["part"], _class(row["part"], row["node_id"], row["cuts"]) if row["alike"] else _nearest_part(seeds_of[name], np.array([row["embedding"]], dtype=np.float64))[0]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(at, pa.string()), batch.column("n")], [*names, "part", "before"])

        open_ = saved(spark, big.join(seeds, key, "left").mapInArrow(place, schema + ", before long"))

    def rest(table: pa.Table) -> pa.Table:
        table = table.sort_by("node_id")
        before = table.column("before")[0].as_py()
        parts = cut(table.column("node_id").to_pylist(), _vectors(table.column("embedding")), most, table.column("part")[0].as_py(), before == len(table))
        return table.drop_columns(["part", "before"]).append_column("part", pa.array(parts, pa.string()))

    left = reduce(DataFrame.unionByName, done).select("article_id", *columns, "part", "before")
    return left.groupBy(*key).applyInArrow(rest, ", ".join(["`article_id` " + dict(nodes.dtypes)["article_id"], *(f"`{c}` {dict(nodes.dtypes)[c]}" for c in columns), "part string"]))


def summary_tree(leaves: DataFrame, embed, summarise=first_sentences, levels: int = 3, stop: int = 3, reduction: float = 0.5, budget: int = 1400, most: int = MOST_NODES, held: int = HELD_NODES) -> DataFrame:
    """Levelled tree of summaries over each article's leaves (``article_id``, ``node_id``, ``text``, ``embedding``).

    A level's nodes are clustered, each cluster is summarised and embedded, and the
    summaries are the next level, until ``stop`` nodes or ``levels`` levels.  ``embed``
    maps a text to a vector and ``summarise`` texts and a budget to a text.  A level of an
    article of more than ``most`` leaves is parted by nearness into groups of that size,
    which are clustered by themselves.  An article of up to ``held`` leaves is built in one
    task; a larger one level by level, each level a job with its groups side by side, so
    that no task holds the article.
    """
    spark, columns = leaves.sparkSession, ["article_id", "node_id", "text", "embedding"]
    # what makes the leaves is read once
    own = saved(spark, leaves.select(columns).withColumn("embedding", F.col("embedding").cast("array<double>")))
    sizes = own.groupBy("article_id").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > max(most, held)).select("article_id")
    split = not large.isEmpty()
    small = own.join(large, "article_id", "left_anti") if split else own
    # a fit costs far more than its bytes say, so the groups are dealt to a fixed number of tasks
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    out = small.repartition(tasks, "article_id").groupBy("article_id").applyInArrow(_tree(embed, summarise, levels, stop, reduction, budget, most), TREE)
    if not split:
        return out
    level = saved(spark, own.join(large, "article_id", "left_semi"))
    out = out.unionByName(level.select("article_id", "node_id", F.lit(0).alias("level"), "text", "embedding", F.array().cast("array<string>").alias("children_ids")))
    for depth in range(1, levels + 1):
        going = level.groupBy("article_id").agg(F.count("*").alias("n")).where(F.col("n") > stop).select("article_id")
        nodes = level.join(going, "article_id", "left_semi").select(columns)
        made = parted(spark, nodes, most, held).repartition(tasks, "article_id", "part").groupBy("article_id", "part").applyInArrow(_level(embed, summarise, depth, reduction, budget), TREE)
        new = saved(spark, made)
        if new.isEmpty():
            break
        out, level = out.unionByName(new), new.select(columns)
    return out


def character_vector(text: str, dimensions: int = 64) -> list[float]:
    """The deterministic embedder as a Python function."""
    v = np.bincount([ord(c) % dimensions for c in text.lower()], minlength=dimensions).astype(np.float64)
    return (v / (np.linalg.norm(v) or 1.0)).tolist()
