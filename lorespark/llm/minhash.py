"""MinHash near-duplicates by fast similarity sketching.

A text's distinct shingles are thrown into the bins of its sketch in rounds.  In each of
the first rounds a hash places every shingle in one bin; a bin keeps the least value of
the first round that reaches it.  Later rounds place all shingles in one bin each, in
turn, so that every bin is filled after a number of rounds that is known beforehand.
Since a round's shingles are spread over the bins without replacement of bins, the share
of equal coordinates is concentrated about the similarity more than with independent
hashes, at a cost that does not multiply shingles by bins.

Bands of coordinates are buckets, and a bucket is never spelled out as all its pairs.
First each member is compared with the bucket's least one, which joins most groups.  In
buckets that still hold several components the sketches are compared inside tasks; what
leaves a task is a forest of the pairs that agree nearly enough, and the trees are the
candidate groups.  The texts of a group meet in tiles of a bounded size, where pairs of
different components are compared, the likeliest first, until no two are left unjoined.
Every link is confirmed on the whole sets of shingles, as words and not as hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import words
from lorespark.llm.common import Scratch, byte_values, mix, shuffle_partitions, slices
from lorespark.llm.components import connected_components

SHINGLE_WORDS = 3
#: Percent of the union that two linked sets share at least.
PERCENT = 85
#: At 85 % a band agrees with a chance of 0.377, so that two linked sets share no band with a chance of 6e-9.
ROWS, BANDS = 6, 40
BINS = ROWS * BANDS
#: Texts that are compared with one centre by one task.
CENTRE_TEXTS = 256
#: Equal coordinates of a pair that is compared.  At 85 % the mean is 204 of 240 with a deviation of 5.5 at most: fewer than 170 have a chance of 1e-8.
AGREE = 170
#: Members of a bucket whose sketches meet in one task; two such blocks at most.
BLOCK = 2048
#: Shingles of a candidate group whose texts meet in one task; two such blocks at most, or one text that is longer.
BLOCK_SHINGLES = 1 << 20
#: Numbers of words fit into so many bits; a text with more different words is coded in two steps.
WORD_BITS = 21


class Vocabulary(dict):
    """Numbers of words, in the order in which they come, and their hashes."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []
        self._array = np.zeros(0, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number

    def array(self) -> np.ndarray:
        if len(self._array) < len(self.hashes):
            self._array = np.concatenate([self._array, np.array(self.hashes[len(self._array) :], dtype=np.uint64)])
        return self._array

    def read(self, text: bytes | None) -> tuple[np.ndarray, bytes]:
        """The numbers of a text's words, and the digest of its words in order."""
        numbers, digest = [], hashlib.sha256()
        for own in words.pieces(text, words.SPACED):
            numbers.append(np.fromiter(map(self.__getitem__, own), dtype=np.int64, count=len(own)))
            digest.update(b" ".join([*own, b""]))
        return (np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)), digest.digest()


def distinct_shingles(*texts: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each text of at least three words, as sorted codes that are equal just if their words are."""
    if max(int(t.max()) for t in texts) < 1 << WORD_BITS:
        return [np.unique(t[:-2] << (2 * WORD_BITS) | t[1:-1] << WORD_BITS | t[2:]) for t in texts]
    pairs = np.unique(np.concatenate([t[:-1] << 32 | t[1:] for t in texts]))
    return [np.unique(np.searchsorted(pairs, t[:-2] << 32 | t[1:-1]) << 32 | t[2:]) for t in texts]


def shingle_hashes(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each distinct shingle, the same in every task."""
    if int(text.max()) < 1 << WORD_BITS:
        (codes,) = distinct_shingles(text)
        low = (1 << WORD_BITS) - 1
        parts = codes >> (2 * WORD_BITS), codes >> WORD_BITS & low, codes & low
    else:
        pairs = np.unique(text[:-1] << 32 | text[1:])
        _, at = np.unique(np.searchsorted(pairs, text[:-2] << 32 | text[1:-1]) << 32 | text[2:], return_index=True)
        parts = text[at], text[at + 1], text[at + 2]
    out = mix(hashes[parts[0]])
    for k in (1, 2):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[parts[k]])
    return out


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """The sketch of each set of hashes, none of them empty: a row of ``bins`` coordinates."""
    out = np.full((len(sets), bins), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat, active = out.reshape(-1), np.arange(len(sets))
    own, owner = np.concatenate(sets or [np.zeros(0, dtype=np.uint64)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for turn in range(2 * bins):
        if not len(active):
            break
        h = _spread(own + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        value = np.uint64(turn) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
        # a hash names the bin in the first rounds, the round does in the later ones
        place = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if turn < bins else turn - bins
        np.minimum.at(flat, owner * bins + place, value)
        left = (out[active] == np.iinfo(np.uint64).max).any(axis=1)
        if not left.all():
            active = active[left]
            keep = np.isin(owner, active)
            own, owner = own[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A bucket for each band of each sketch, told apart by the number of the band."""
    bands = sketch.reshape(len(sketch), -1, rows)
    out = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(rows):
        out = _spread(out * np.uint64(0xD6E8FEB86659FD93) + bands[:, :, k])
    return out


def _marked(batches):
    """Digest of the words, size of the set and buckets of each text."""
    vocabulary = Vocabulary()
    for batch in batches:
        for part in slices([batch], "text", 8 << 20):
            sizes, digests, sets, at = [], [], [], []
            for k, text in enumerate(byte_values(part.column("text"))):
                if len(vocabulary.hashes) > 1 << (WORD_BITS - 2):
                    vocabulary = Vocabulary()
                numbers, digest = vocabulary.read(text)
                if len(numbers) >= SHINGLE_WORDS:
                    sets.append(shingle_hashes(numbers, vocabulary.array()))
                    at.append(k)
                sizes.append(len(sets[-1]) if len(numbers) >= SHINGLE_WORDS else min(1, len(numbers)))
                digests.append(digest if len(numbers) else None)
            bands = [None] * len(sizes)
            for k, keys in zip(at, band_keys(sketches(sets)).view(np.int64) if sets else ()):
                bands[k] = keys
            columns = [part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n", "bands"])


def _same(batches):
    """Rows whose text is the one that the digest is of, with a byte of each coordinate; a repeated id may have other texts."""
    vocabulary = Vocabulary()
    for batch in batches:
        for part in slices([batch], "text", 8 << 20):
            keep, sets = [], []
            for text, digest in zip(byte_values(part.column("text")), part.column("digest").to_pylist()):
                if len(vocabulary.hashes) > 1 << (WORD_BITS - 2):
                    vocabulary = Vocabulary()
                numbers, own = vocabulary.read(text)
                keep.append(own == digest)
                if keep[-1]:
                    sets.append(shingle_hashes(numbers, vocabulary.array()))
            rows = pa.RecordBatch.from_arrays([part.column("node"), part.column("text")], ["node", "text"]).filter(pa.array(keep, pa.bool_()))
            yield rows.append_column("sketch", pa.array([s.tobytes() for s in (sketches(sets) & np.uint64(255)).astype(np.uint8)] if sets else [], pa.binary()))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets of distinct codes share at least ``percent`` of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(percent: int):
    """Compares each centre, the row without ``b``, with the rows that come after it."""

    def run(batches):
        vocabulary, centre, text, codes, numbers = Vocabulary(), None, None, None, None
        for batch in batches:
            for part in slices([batch], "text"):
                found = []
                for a, b, own in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), byte_values(part.column("text"))):
                    if b is None or len(vocabulary.hashes) > 1 << (WORD_BITS - 1):
                        centre, text = (a, own) if b is None else (centre, text)
                        vocabulary = Vocabulary()
                        numbers = vocabulary.read(text)[0]
                        (codes,) = distinct_shingles(numbers)
                    if b is not None and a == centre:
                        other = vocabulary.read(own)[0]
                        pair = (codes, *distinct_shingles(other)) if len(vocabulary.hashes) <= 1 << WORD_BITS else distinct_shingles(numbers, other)
                        if linked(*pair, percent):
                            found.append((a, b))
                u, v = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a``, ``b`` that are linked; the texts of a centre ``a`` with many pairs are dealt to several tasks."""
    centres = pairs.groupBy("a").agg(((F.count("*") - 1) / CENTRE_TEXTS).cast("int").alias("last"))
    part = F.pmod(F.xxhash64("b"), F.col("last") + 1)
    others = pairs.join(centres, "a").select("a", part.alias("part"), "b").join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    own = centres.join(texts.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    dealt = own.unionByName(others).repartition(shuffle_partitions(pairs.sparkSession), "a", "part")
    return dealt.sortWithinPartitions("a", "part", F.asc_nulls_first("b")).mapInArrow(_confirmed(percent), "u long, v long")


def _agreeing(left: np.ndarray, right: np.ndarray, least: int):
    """Places and number of equal coordinates of the pairs that agree in ``least`` of them, by parts of ``left``."""
    for at in range(0, len(left), 64):
        equal = (left[at : at + 64, None, :] == right[None, :, :]).sum(axis=2, dtype=np.int32)
        i, j = np.nonzero(equal >= least)
        yield i + at, j, equal[i, j]


def _sized(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


class _Forest:
    """Which of a task's nodes are joined so far."""

    def __init__(self, n: int):
        self.top = list(range(n))

    def find(self, x: int) -> int:
        while self.top[x] != x:
            self.top[x] = self.top[self.top[x]]
            x = self.top[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.top[max(x, y)] = min(x, y)
        return x != y


def _sides(i: int, j: int, block: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members that a tile compares with which; one block is compared with itself, but for its largest component."""
    if i != j:
        return np.flatnonzero(block == i), np.flatnonzero(block == j)
    values, counts = np.unique(label, return_counts=True)
    return np.flatnonzero(label != values[counts.argmax()]), np.arange(len(label))


def _tiles(batches, keys: list[str]):
    """The rows of one tile after another, as tables."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((np.diff(own, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and current != tuple(own[:, a].tolist()):
                yield current, pa.Table.from_batches(held).combine_chunks()
                held = []
            current = tuple(own[:, a].tolist())
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held).combine_chunks()


def _byte_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _candidates(percent: int, agree: int):
    """A forest of the pairs of different components in a tile of a bucket whose sketches agree."""

    def run(batches):
        for (_, i, j), rows in _tiles(batches, ["bucket", "i", "j"]):
            node, label, n, block = (rows.column(c).to_numpy() for c in ("node", "label", "n", "block"))
            sketch, forest, found = _byte_rows(rows.column("sketch")), _Forest(rows.num_rows), []
            left, right = _sides(i, j, block, label)
            for x, y, _ in _agreeing(sketch[left], sketch[right], agree):
                x, y = left[x], right[y]
                near = (label[x] != label[y]) & _sized(n[x], n[y], percent)
                found += [(a, b) for a, b in zip(x[near].tolist(), y[near].tolist()) if forest.join(a, b)]
            if found:
                u, v = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

    return run


def _joined(percent: int, agree: int):
    """Links that join all components of a tile of a candidate group that any link joins."""

    def run(batches):
        for (_, i, j), rows in _tiles(batches, ["root", "i", "j"]):
            node, label, n, block = (rows.column(c).to_numpy() for c in ("node", "label", "n", "block"))
            sketch, vocabulary = _byte_rows(rows.column("sketch")), Vocabulary()
            codes = distinct_shingles(*(vocabulary.read(t)[0] for t in byte_values(rows.column("text").combine_chunks())))
            names, number = np.unique(label, return_inverse=True)
            forest, found, pairs = _Forest(len(names)), [], []
            left, right = _sides(i, j, block, label)
            for x, y, equal in _agreeing(sketch[left], sketch[right], agree):
                x, y = left[x], right[y]
                near = (label[x] != label[y]) & _sized(n[x], n[y], percent)
                pairs.append(np.stack([-equal[near], x[near], y[near]]))
            # the likeliest first, so that most others join what is joined already
            found_pairs = np.concatenate(pairs, axis=1) if pairs else np.zeros((3, 0), dtype=np.int64)
            for k in np.argsort(found_pairs[0], kind="stable").tolist():
                x, y = int(found_pairs[1, k]), int(found_pairs[2, k])
                a, b = int(number[x]), int(number[y])
                if forest.find(a) != forest.find(b) and linked(codes[x], codes[y], percent):
                    forest.join(a, b)
                    found.append((x, y))
            if found:
                u, v = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

    return run


def _tiled(rows: DataFrame, key: str, blocks: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` dealt to the pairs of blocks of their ``key``; ``blocks`` has the number of blocks of each key."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rows.join(blocks, key).withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    dealt = dealt.select(key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *columns)
    return dealt.repartition(shuffle_partitions(rows.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j")


def _relabelled(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``label`` after the links."""
    edges = links.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
    roots = connected_components(edges.select(F.col("lu").alias("u"), F.col("lv").alias("v")), scratch).withColumnRenamed("node", "label")
    return scratch.save(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")


def _components(spark: SparkSession, docs: DataFrame, percent: int, agree: int = AGREE, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """Digest and size of every row, and the component of each digest: both written tables."""
    scratch = Scratch(spark, "minhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = scratch.save(rows.mapInArrow(_marked, "doc_id long, digest binary, n long, bands array<long>"), "marked")
    # rows of the same words are one node
    nodes = marked.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.where("bands is not null").select("node", "n", F.explode("bands").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("head"), F.max("node").alias("last")).where("head.node < last")
    live = scratch.save(members.join(heads.select("bucket", "head"), "bucket"), "live")
    labels = scratch.save(live.select("node", F.col("node").alias("label")).distinct(), "labels")
    wanted = nodes.join(labels.select("node"), "node", "left_semi").select("node", "least_id", "digest")
    held = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("least_id"))).select("node", "digest", "text").mapInArrow(_same, "node long, text string, sketch binary")
    texts = scratch.save(held, "texts")
    if texts.count() > labels.count():  # repeated rows
        texts = scratch.save(texts.dropDuplicates(["node"]), "texts")
    # every member with the least of its bucket
    stars = live.where((F.col("node") != F.col("head.node")) & (F.least("n", "head.n") * 100 >= F.greatest("n", "head.n") * percent))
    pairs = scratch.save(stars.select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    labels = _relabelled(labels, scratch.save(confirm(pairs, texts, percent), "links"), scratch)
    # buckets of several components: which of them may be linked
    named = live.select("bucket", "node", "n").join(labels, "node")
    several = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / block).alias("blocks")).where("lo < hi").select("bucket", "blocks")
    sketched = named.join(several.select("bucket"), "bucket", "left_semi").join(texts.select("node", "sketch"), "node")
    tiles = _tiled(sketched, "bucket", several, ["node", "label", "n", "sketch"])
    trees = connected_components(tiles.mapInArrow(_candidates(percent, agree), "u long, v long"), scratch)
    # the texts of each candidate group
    sizes = nodes.select("node", "n")
    groups = scratch.save(trees.join(labels, "node").join(sizes, "node"), "groups")
    blocks = groups.groupBy("root").agg(F.ceil(F.sum("n") / block_shingles).alias("blocks"))
    tiles = _tiled(groups.join(texts, "node"), "root", blocks, ["node", "label", "n", "sketch", "text"])
    labels = _relabelled(labels, scratch.save(tiles.mapInArrow(_joined(percent, agree), "u long, v long"), "links"), scratch)
    scratch.drop(live, pairs, groups)
    rooted = nodes.select("node", "digest", "least_id").join(labels, "node", "left").select("digest", "least_id", F.coalesce("label", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = scratch.save(rooted.join(least, "root").select("digest", "component_id"), "components")
    scratch.drop(nodes, texts)
    return marked.select("doc_id", "digest", F.col("n").alias("n_shingles")), named


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Sets of distinct three-word shingles are linked if they share ``percent`` of their
    union; a component's id is the smallest ``doc_id`` that is reachable, and ``kept`` says
    that it is the row's own.  A text of fewer words is one shingle.  Null and wordless texts
    are linked with nothing and are kept.  Texts of any length are compared whole.  Rows that
    repeat a ``doc_id`` each keep their own row; a row without one is linked like any other,
    and never names a component that has an id (then ``kept`` is false).  Further columns,
    whatever their names, are not read; an empty table gives an empty result.
    """
    marked, named = _components(spark, docs, percent)
    # texts without words are kept apart from the join, so that they are not one group
    found = marked.where("n_shingles > 0").join(named, "digest").unionByName(marked.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``doc_id`` names its component; rows without an id go."""
    ids = near_duplicates(spark, docs, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").select(docs.columns)
