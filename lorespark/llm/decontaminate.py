"""Benchmark decontamination by containment MinHash over size partitions.

Test items are partitioned by their number of shingles, in powers of two.  An item's
sketch is its ``k`` smallest shingle hashes under a permutation, where ``k`` is set by
its size partition: one more than the shingles that may be missing at the threshold.  A
document that contains enough of the item must then hold one of the ``k``, however long
it is, so the search loses nothing; plain MinHash of long documents would.  A document
is probed only against size partitions whose items it is long enough to contain.  An item
of fewer words than a shingle has is one shingle of just its words, which is looked for at
every place of a document as any other.  Candidates are verified by exact containment of
the shingles' words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from math import ceil, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.names import spare
from lorespark.llm.common import Scratch, mix, slices

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: A benchmark of so many bytes is broadcast; a larger one is joined.
BLOCK_BYTES = 4 << 20
#: Bits of a shingle's hash that the filter before the join knows, and of those that number its chunks.
FILTER_BITS, CHUNK_BITS = 28, 12
_WORD = re.compile(r"\w+")
_EPS = 1e-9


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores; punctuation and case don't hide a copy."""
    return _WORD.findall((text or "").lower())


def rolled(words: list[str], length: int) -> np.ndarray:
    """64-bit hash of the shingle at each place."""
    return _rolled(word_hashes(words), length)


def _rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = mix(hashes[:count])
    for k in range(1, length):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + count])
    return out


def sketch_size(level: int, threshold: float) -> int:
    """One hash more than may be missing of an item with less than ``2 ** (level + 1)`` shingles."""
    return 1 + floor((1 - threshold) * (2 ** (level + 1) - 1) + _EPS)


def item_parts(text: str | None, threshold: float) -> tuple[int, list[str], list[bool], np.ndarray] | None:
    """Size partition, distinct shingles, whether each is of the sketch, and their hashes; null without words.

    An item of fewer words than a shingle is one shingle of its own length.
    """
    words = words_of(text)
    if not words:
        return None
    length = min(SHINGLE_WORDS, len(words))
    hashes = rolled(words, length)
    shingles = [" ".join(words[i : i + length]) for i in range(len(hashes))]
    hashes, first = np.unique(hashes, return_index=True)
    shingles = [shingles[i] for i in first]
    level, own = len(shingles).bit_length() - 1, np.zeros(len(shingles), dtype=bool)
    own[np.argsort(mix(hashes), kind="stable")[: sketch_size(level, threshold)]] = True
    return level, shingles, own.tolist(), hashes


def word_hashes(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))


def least_words(level: int, threshold: float) -> int:
    """Words of the shortest document that can hold enough of an item of a size partition."""
    return ceil(threshold * 2**level - _EPS) + SHINGLE_WORDS - 1


class Index:
    """Sketches of a block of items, and their whole shingles for verification."""

    def __init__(self, rows: list[tuple[int, str | None]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.ids, self.sizes = [], []
        #: Items of fewer words than a shingle: for each number of words the items of each hash.
        short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.words: dict[int, str] = {}
        self.holders: dict[str, list[int]] = defaultdict(list)
        grouped: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        known = [np.zeros(0, dtype=np.uint64)]
        for item_id, text in rows:
            parts = item_parts(text, threshold)
            if parts is None:
                continue  # nothing to find
            level, shingles, own, hashes = parts
            number = len(self.ids)
            self.ids.append(item_id)
            self.sizes.append(len(shingles))
            length = shingles[0].count(" ") + 1
            if length < SHINGLE_WORDS:
                short[length][int(hashes[0])].append(number)
                self.words[number] = shingles[0]
                continue
            known.append(hashes)
            for shingle, chosen, key in zip(shingles, own, hashes.tolist()):
                self.holders[shingle].append(number)
                if chosen:
                    grouped[level][key].append(number)
        self.holders = dict(self.holders)
        self.short = {n: (np.array(sorted(found), dtype=np.uint64), dict(found)) for n, found in sorted(short.items())}
        #: For each size partition its level, sorted keys, and the items of each key.
        self.partitions = []
        for level, found in sorted(grouped.items()):
            keys = sorted(found)
            self.partitions.append((level, np.array(keys, dtype=np.uint64), [found[k] for k in keys]))
        self.known = np.unique(np.concatenate(known))

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(item number, its shingles, those found)`` of every item that the text contains."""
        words = words_of(text)
        if not words or not (self.short or self.partitions):
            return []
        hashes = word_hashes(words)
        return sorted(self._short(words, hashes) + self._long(words, hashes))

    def _short(self, words: list[str], hashes: np.ndarray) -> list[tuple[int, int, int]]:
        found = set()
        for length, (keys, items) in self.short.items():
            own = _rolled(hashes, length)
            for i in np.flatnonzero(np.isin(own, keys)).tolist():
                shingle = " ".join(words[i : i + length])
                found.update(n for n in items[int(own[i])] if n not in found and self.words[n] == shingle)
        return [(n, 1, 1) for n in found]

    def _long(self, words: list[str], hashes: np.ndarray) -> list[tuple[int, int, int]]:
        if not self.partitions or len(words) < SHINGLE_WORDS:
            return []
        own, candidates = _rolled(hashes, SHINGLE_WORDS), set()
        for level, keys, items in self.partitions:
            if len(words) < least_words(level, self.threshold):
                continue
            at = np.searchsorted(keys, own)
            at[at == len(keys)] = 0
            for k in np.unique(at[keys[at] == own]):
                candidates.update(items[k])
        if not candidates:
            return []
        seen: dict[int, set[str]] = defaultdict(set)
        for i in np.flatnonzero(np.isin(own, self.known)):
            shingle = " ".join(words[i : i + SHINGLE_WORDS])
            for number in self.holders.get(shingle, ()):
                if number in candidates:
                    seen[number].add(shingle)
        return [(n, self.sizes[n], len(s)) for n, s in sorted(seen.items()) if len(s) >= self.threshold * self.sizes[n] - _EPS]


def _index(spark: SparkSession, benchmark: DataFrame, threshold: float):
    """The broadcast index of a benchmark of up to ``BLOCK_BYTES``; null for a larger one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BLOCK_BYTES:
        return None
    rows = sorted(((r.item_id, r.text) for r in items.where("text is not null").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return spark.sparkContext.broadcast(Index(rows, threshold))


# --- benchmarks beyond a broadcast ----------------------------------------------------


def _items(threshold: float):
    def run(batches):
        for batch in slices(batches, "text"):
            for item, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text"))):
                parts = item_parts(text, threshold)
                if parts is not None:
                    level, shingles, own, hashes = parts
                    n = len(shingles)
                    columns = [[item] * n, [item_id] * n, [n] * n, [level] * n, shingles, own, hashes.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _ITEM)], [n for n, _ in _ITEM])

    return run


_ITEM = [("item", pa.int64()), ("item_id", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("shingle", pa.string()), ("chosen", pa.bool_()), ("hash", pa.int64())]


def _chunk_bits(batches):
    for batch in batches:
        bits = []
        for places in batch.column("places"):
            own = np.zeros(1 << (FILTER_BITS - CHUNK_BITS), dtype=np.uint8)
            own[places.values.to_numpy(zero_copy_only=False)] = 1
            bits.append(np.packbits(own, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(bits, pa.binary())], ["chunk", "bits"])


def _filter(spark: SparkSession, shingles: DataFrame):
    """A broadcast bit for each value of the first ``FILTER_BITS`` bits of a hash, 32 MB for any benchmark."""
    first = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    low = FILTER_BITS - CHUNK_BITS
    places = shingles.groupBy(F.shiftrightunsigned(first, low).cast("int").alias("chunk")).agg(F.collect_set((first % (1 << low)).cast("int")).alias("places"))
    whole = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    size = (1 << low) // 8
    for row in places.mapInArrow(_chunk_bits, "chunk int, bits binary").toLocalIterator():
        whole[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return spark.sparkContext.broadcast(whole)


def _probes(shared, lengths: list[int]):
    """The distinct shingles of each document, of the lengths that the items have, that the filter lets pass."""

    def run(batches):
        bits = shared.value
        for batch in slices(batches, "text"):
            for row, doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "key", "text"))):
                words = words_of(text)
                if not words:
                    continue
                own, found = word_hashes(words), set()
                for length in lengths:
                    first = _rolled(own, length) >> np.uint64(64 - FILTER_BITS)
                    at = np.flatnonzero(bits[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8) & 1)
                    found.update(" ".join(words[i : i + length]) for i in at)
                found = sorted(found)
                if found:
                    n = len(found)
                    columns = [[row] * n, [doc_id] * n, [key] * n, [len(words)] * n, found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _PROBE)], [n for n, _ in _PROBE])

    return run


_PROBE = [("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.string()), ("n_words", pa.int64()), ("shingle", pa.string())]


def _joined(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """Matches by joins, with the ``key`` of the text: one scan of the documents for a benchmark of any size.

    Only shingles that pass a filter of fixed size are shuffled; candidates are those of a
    sketch, and only they are counted.
    """
    scratch = Scratch(spark, "decontaminate")
    asked = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = scratch.save(asked.mapInArrow(_items(threshold), "item long, item_id long, size long, level int, shingle string, chosen boolean, hash long"), "items")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("key"), F.col("text").cast("string").alias("text"))
    lengths = sorted(r.n for r in items.select(F.size(F.split("shingle", " ")).alias("n")).distinct().collect())  # SHINGLE_WORDS at most
    probes = scratch.save(texts.mapInArrow(_probes(_filter(spark, items), lengths), "row long, doc_id long, key string, n_words long, shingle string"), "probes")
    # an item of one shingle may be shorter than a shingle
    long_enough = (F.col("level") == 0) | (F.col("n_words") >= F.ceil(F.lit(threshold) * F.pow(F.lit(2.0), "level") - _EPS) + SHINGLE_WORDS - 1)
    candidates = probes.join(items.where("chosen"), "shingle").where(long_enough).select("row", "item").distinct()
    found = candidates.join(probes, "row").join(items.select("item", "item_id", "size", "shingle"), ["item", "shingle"])
    counted = found.groupBy("row", "doc_id", "key", "item", "item_id", "size").agg(F.count("*").alias("n_found"))
    return counted.where(F.col("n_found") >= threshold * F.col("size") - _EPS)


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every document and test item whose shingles it contains to ``threshold``.

    Columns: ``doc_id``, ``item_id``, ``n_shingles`` and ``n_found`` (distinct shingles of
    the item, and those in the document) and ``containment``.  Shingles are five words; an
    item of fewer words is one shingle of all its words, found anywhere in a document, so
    that an item of one frequent word is in many.  Documents of any length are read whole.
    Null and wordless texts match nothing.  Repeated documents and items give a row each;
    further columns, whatever their names, are not read; an empty table gives no match.
    A benchmark of up to ``BLOCK_BYTES`` is broadcast, a larger one joined: the result is
    the same, and the documents are read once.
    """
    index = _index(spark, benchmark, threshold)
    if index is None:
        found = _joined(spark, docs, benchmark, threshold)
        return found.select("doc_id", "item_id", F.col("size").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("size")).alias("containment"))

    def run(batches):
        own = index.value
        for batch in slices(batches, "text"):
            rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for m in own.find(t)]
            out = list(zip(*((d, own.ids[n], size, found, found / size) for d, n, size, found in rows))) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [pa.int64()] * 4 + [pa.float64()])], ["doc_id", "item_id", "n_shingles", "n_found", "containment"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, item_id long, n_shingles long, n_found long, containment double")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no test item (see ``matches``), with all their columns.

    Null and empty texts stay, repeated rows go or stay together, and columns may have any
    names.  Without a shuffle of ``docs`` for a benchmark that is broadcast; for a larger
    one the keys of contaminated texts are joined against it.
    """
    index = _index(spark, benchmark, threshold)
    if index is None:
        (key,) = spare(docs.columns, "_key")
        bad = _joined(spark, docs, benchmark, threshold).select(F.col("key").alias(key)).distinct()
        return docs.join(bad, F.md5(F.col("text").cast("binary")) == F.col(key), "left_anti")

    def run(batches):
        own = index.value
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array([not own.find(t) for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM benchmark),
ig AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[k : k + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM (SELECT *, least(5, len(ws)) AS n FROM i WHERE len(ws) > 0))),
dg AS (
  SELECT DISTINCT doc_id, n, array_to_string(ws[k : k + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d JOIN (SELECT DISTINCT n FROM ig) ON len(ws) >= n)),
size AS (SELECT item_id, count(*) AS n_shingles FROM ig GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM dg JOIN ig USING (n, g) JOIN size USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles
"""
