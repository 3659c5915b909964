"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint stands for all variants within half the radius.  Two
fingerprints differ in at most ``2 * half`` bits exactly if they share a variant, so
grouping variants finds every link.  A variant's shuffle key is the value of a few
fixed bits: the variants of one fingerprint that share a key travel as that one
fingerprint and are spelled out where they arrive, which moves tens of bytes for a
fingerprint in place of thousands.  A run of equal variants is linked as a star, not
as all its pairs, and the links of a key are reduced to a forest before they leave.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.functions.names import spare
from lorespark.llm.common import Scratch, byte_values, groups, shuffle_partitions, slices
from lorespark.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 4
HALF = 2
#: Number of bits whose value is the shuffle key, at least; 12 bits send a fingerprint to 79 of 4,096 keys.
LEAST_KEY_BITS, MOST_KEY_BITS = 12, 30
#: Fingerprints that a key should hold; with more of them keys get more bits.
KEY_FINGERPRINTS = 2_000_000
#: Copies of fingerprints that are sorted by key at once.
MOST_SENT = 8_000_000
#: A task spells out at most about so many variants at once.
MOST_VARIANTS = 4_000_000
#: Shingles of a long text that are counted at once.
MOST_SHINGLES = 200_000


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text; 0 without words."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE_WORDS:
        hashes = [digest(joined, SEED)]
        total, counts = 1, _bit_counts(np.array(hashes, dtype=np.uint64))
    else:
        sizes = list(map(len, words))
        ends = [e + i for i, e in enumerate(accumulate(sizes))]
        starts = [e - s for e, s in zip(ends, sizes)]
        total, counts = n - SHINGLE_WORDS + 1, np.zeros(64, dtype=np.int64)
        for a in range(0, total, MOST_SHINGLES):
            b = min(total, a + MOST_SHINGLES)
            spans = zip(starts[a:b], ends[a + SHINGLE_WORDS - 1 : b + SHINGLE_WORDS - 1])
            counts += _bit_counts(np.fromiter((digest(joined[s:e], SEED) for s, e in spans), dtype=np.uint64, count=b - a))
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


@lru_cache(1)
def _byte_bits() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, lowest bit first."""
    parts = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 400:
        return np.unpackbits(parts, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(parts[:, k], minlength=256) @ _byte_bits() for k in range(8)])


def _fingerprints(batches):
    for batch in slices(batches, "text"):
        values = np.array([fingerprint(t) for t in byte_values(batch.column("text"))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


# --- ball hashing ---------------------------------------------------------------------


@lru_cache(64)
def _flips(bits: tuple[int, ...], most: int) -> np.ndarray:
    """All masks that flip up to ``most`` of the bits."""
    one = [1 << b for b in bits]
    return np.array([sum(c) for k in range(most + 1) for c in combinations(one, k)], dtype=np.uint64)


def key_bits(fingerprints: int) -> tuple[int, ...]:
    """The bits of the shuffle key: as many as keep a key's share of the fingerprints small."""
    n = LEAST_KEY_BITS
    while n < MOST_KEY_BITS and fingerprints * len(_flips(tuple(range(n)), HALF)) > KEY_FINGERPRINTS << n:
        n += 1
    return tuple(k * 64 // n for k in range(n))


def _key(values: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.uint64)
    for k, bit in enumerate(bits):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def _spread(key: int, bits: tuple[int, ...]) -> np.uint64:
    return np.uint64(sum(1 << bit for k, bit in enumerate(bits) if key >> k & 1))


def _emit(bits: tuple[int, ...]):
    """Sends each fingerprint to every key that one of its variants has."""

    def packed(held: list[np.ndarray], flips: np.ndarray) -> pa.RecordBatch:
        values = np.unique(np.concatenate(held))
        keys = (_key(values, bits)[:, None] ^ flips[None, :]).ravel()
        order = np.argsort(keys, kind="stable")
        keys, sent = keys[order], values[order // len(flips)]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
        ends = np.append(cuts[1:], len(keys))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[cuts].astype(np.int32)), pa.array([sent[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())], ["bucket", "fps"]
        )

    def run(batches):
        flips, held, count = _flips(tuple(range(len(bits))), HALF), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                count += batch.num_rows
            if count * len(flips) >= MOST_SENT:
                yield packed(held, flips)
                held, count = [], 0
        if count:
            yield packed(held, flips)

    return run


def _collisions(base: np.ndarray, left: np.ndarray, source: np.ndarray, free: tuple[int, ...]):
    """Pairs of sources that share a variant, as stars; ``left`` is the number of bits still to flip."""
    spelled = sum(int((left == k).sum()) * len(_flips(free, k)) for k in range(HALF + 1))
    if spelled > MOST_VARIANTS and len(free) > 4 and len(base) > 64:
        bits, rest = free[::13][:4], tuple(b for b in free if b not in free[::13][:4])
        own = _key(base, bits)
        clear = ~_spread(15, bits)
        for value in range(16):
            used = np.bitwise_count(own ^ np.uint64(value)).astype(np.int64)
            keep = used <= left
            yield from _collisions((base[keep] & clear) | _spread(value, bits), left[keep] - used[keep], source[keep], rest)
        return
    variants, origins = [], []
    for k in range(HALF + 1):
        chosen = left == k
        if chosen.any():
            masks = _flips(free, k)
            variants.append((base[chosen][:, None] ^ masks[None, :]).ravel())
            origins.append(np.repeat(source[chosen], len(masks)))
    if not variants:
        return
    values, origin = np.concatenate(variants), np.concatenate(origins)
    order = np.argsort(values, kind="stable")
    values, origin = values[order], origin[order]
    same = np.concatenate([[False], values[1:] == values[:-1]])
    if same.any():
        run = np.cumsum(~same) - 1
        star = np.full(run[-1] + 1, len(source) + int(source.max()), dtype=np.int64)
        np.minimum.at(star, run, origin)
        other, centre = origin[same | np.append(same[1:], False)], star[run[same | np.append(same[1:], False)]]
        apart = other != centre
        links = np.unique(other[apart].astype(np.int64) << 32 | centre[apart].astype(np.int64))
        yield links >> 32, links & 0xFFFFFFFF


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, from that of each before the edges ``a``, ``b``."""
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _links(bits: tuple[int, ...]):
    def run(batches):
        free = tuple(b for b in range(64) if b not in bits)
        clear = ~_spread(2 ** len(bits) - 1, bits)
        for bucket, rows in groups(batches, "bucket"):
            fps = np.unique(np.frombuffer(b"".join(x for r in rows for x in r.column("fps").to_pylist()), dtype=np.uint64))
            if len(fps) < 2:
                continue
            left = HALF - np.bitwise_count(_key(fps, bits) ^ np.uint64(bucket)).astype(np.int64)
            label = np.arange(len(fps), dtype=np.int64)
            # the stars of each part join the forest as they come, so that a dense key holds one label a member
            for a, b in _collisions((fps & clear) | _spread(bucket, bits), left, np.arange(len(fps)), free):
                if (np.bitwise_count(fps[a] ^ fps[b]) > 2 * HALF).any():
                    raise AssertionError("two fingerprints share a variant that neither is near to")
                new = label[a] != label[b]
                if new.any():
                    label = forest(label, a[new], b[new])
            moved = np.flatnonzero(label != np.arange(len(fps)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(fps[moved].view(np.int64)), pa.array(fps[label[moved]].view(np.int64))], ["u", "v"])

    return run


def links(distinct: DataFrame, partitions: int) -> DataFrame:
    """Edges ``u``, ``v`` that connect just the fingerprints within the radius of each other."""
    bits = key_bits(distinct.count())
    return (
        distinct.select("fp")
        .mapInArrow(_emit(bits), "bucket int, fps binary")
        .repartition(partitions, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_links(bits), "u long, v long")
    )


def _components(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and the component of each fingerprint: both written tables."""
    scratch = Scratch(spark, "simhash")
    marked = scratch.save(fingerprints(docs), "fingerprints")
    least = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = connected_components(links(least, shuffle_partitions(spark)), scratch)
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = scratch.save(rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "root", "component_id"), "components")
    scratch.drop(least)
    return marked, named


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints that differ in at most four of 64 bits are linked, and a component's id
    is the smallest ``doc_id`` that is reachable, over any number of links.  A null or
    empty text has fingerprint zero and is linked like any other.  Rows without a
    ``doc_id`` keep their row; they take part in links but never name a component that
    has another id.  Rows with the same ``doc_id`` each keep their own row.  Further
    columns of ``docs`` are not read.  An empty table gives an empty result.
    """
    marked, named = _components(spark, docs)
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs``, with all its columns, without the near-duplicates: of each component the row that names it stays.

    Of several rows with that ``doc_id`` one stays, and one of a component that has no id.
    Null and empty texts have fingerprint zero, so one row of them all stays.  Columns may
    have any names; an empty table gives an empty one.
    """
    marked, named = _components(spark, docs)
    stays = marked.join(named, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "fp", "root")
    rows, ids = marked.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        return docs.join(stays.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    # repeated or missing ids: find the rows again by id and fingerprint
    key, own_id, own_fp, root = spare(docs.columns, "_fp", "_id", "_key", "_root")

    def keyed(batches):
        for batch in slices(batches, "text"):
            values = np.array([fingerprint(t) for t in byte_values(batch.column("text").cast(pa.string()))], dtype=np.uint64)
            yield batch.append_column(key, pa.array(values.view(np.int64)))

    marked_docs = docs.mapInArrow(keyed, T.StructType([*docs.schema.fields, T.StructField(key, T.LongType())]))
    wanted = stays.distinct().select(F.col("doc_id").alias(own_id), F.col("fp").alias(own_fp), F.col("root").alias(root))
    found = marked_docs.join(wanted, (F.col(key) == F.col(own_fp)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)))
    return found.dropDuplicates([own_id, root]).select(docs.columns)
