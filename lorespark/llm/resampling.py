"""Importance resampling towards a target distribution.

Word runs are hashed into a fixed number of buckets.  One pass counts the buckets of the
documents and of the target texts, and the array of their log ratios scores every
document in a second pass.  Scores get Gumbel noise that depends on the id alone, so the
highest ones are a weighted draw without replacement that every rerun repeats.  The key
of the last document drawn is found by radix selection: histograms of one digit of the
composite key a pass, each over the rows that share the digits found so far.  Only rows
from that key on are sorted by range and ranked.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm import words
from lorespark.llm.common import Scratch, byte_values, shuffle_partitions, slices


@dataclass(frozen=True)
class Settings:
    """``runs``: longest run of words that is a feature; ``percent`` of the documents with ``least_words`` are drawn."""

    buckets: int = 10_000
    runs: int = 1
    percent: int = 10
    least_words: int = 20
    seed: str = "2024"


#: Bits of the key that one pass of the selection finds: a histogram has at most 65,536 rows.
DIGIT_BITS = 16
#: Copies of one key that are numbered at once.
COPIES = 1 << 16


def _buckets(text: bytes | None, settings: Settings):
    """Bucket numbers of the features of a text, in arrays."""
    tail: list[bytes] = []
    for own in words.pieces(text, words.ALPHANUMERIC):
        for length in range(1, settings.runs + 1):
            if length == 1:
                features = own
            else:
                # runs that end in this piece; their first words may be in the one before
                joined = tail[max(0, len(tail) - length + 1) :] + own
                features = [b" ".join(joined[i : i + length]) for i in range(len(joined) - length + 1)]
            yield length, np.fromiter(map(crc32, features), dtype=np.uint32, count=len(features)) % np.uint32(settings.buckets)
        tail = (tail + own)[-settings.runs + 1 :] if settings.runs > 1 else []


def _counts(settings: Settings):
    """One row of bucket counts for each task."""

    def run(batches):
        total = np.zeros(settings.buckets, dtype=np.int64)
        for batch in batches:
            for text in byte_values(batch.column("text")):
                for _, found in _buckets(text, settings):
                    total += np.bincount(found, minlength=settings.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """How many features of all ``texts`` fall into each bucket."""
    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts(settings), "bucket long, n long")
    out = np.zeros(settings.buckets, dtype=object)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, for each bucket, rounded down."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([floor(1000 * log((int(t) + 1) * (s_all + n) / ((int(s) + 1) * (t_all + n)))) for s, t in zip(source, target)], dtype=np.int64)


def noise(doc_id: int, seed: str) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of the id's digest."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every row, by one lookup a feature."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def one(text: bytes | None) -> tuple[int, int, int]:
        n_words = n_features = total = 0
        for length, found in _buckets(text, settings):
            n_words += len(found) if length == 1 else 0
            n_features += len(found)
            total += int(shared.value[found].sum())
        return n_words, n_features, total // n_features if n_features else 0

    def run(batches):
        for batch in batches:
            for part in slices([batch], "text"):
                ids = part.column("doc_id").to_pylist()
                found = [one(t) for t in byte_values(part.column("text"))]
                scores = [None if d is None else w + noise(d, settings.seed) for d, (_, _, w) in zip(ids, found)]
                columns = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in (*columns, scores))], _SCORED)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in _SCORED))


_SCORED = ["doc_id", "n_words", "n_features", "weight", "score"]


# --- selection ------------------------------------------------------------------------


def kth_key(rows: DataFrame, keys: list[str], k: int) -> list[int] | None:
    """The ``k``-th smallest composite key, counted from 1; null if there are fewer rows.

    ``keys`` name long columns without nulls.  A pass over the rows reads one digit: it
    counts the rows of each of its values, keeps the value that holds the ``k``-th row,
    and leaves only rows of that value to the next.
    """
    if k < 1:
        return None
    found: list[int] = []
    for key in keys:
        low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
        if n < k:
            return None
        # the value lies in low..high: digits of its distance from low, high ones first
        while high > low:
            shift = max(0, (high - low).bit_length() - DIGIT_BITS)
            digit = F.shiftrightunsigned(_distance(key, low), shift)
            counts = sorted((r.digit, r.n) for r in rows.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())
            for value, n in counts:
                if k <= n:
                    break
                k -= n
            low, high = low + (value << shift), min(high, low + ((value + 1) << shift) - 1)
            rows = rows.where((F.col(key) >= low) & (F.col(key) <= high))
        found.append(low)
    return found


def _distance(key: str, low: int) -> Column:
    """A key's distance from ``low`` as an unsigned long: by halves, so that keys from both ends of the longs don't overflow."""
    a, b, half = F.col(key), F.lit(low).cast("long"), F.lit(0xFFFFFFFF)
    low_half = a.bitwiseAND(half) - b.bitwiseAND(half)
    high_half = F.shiftright(a, 32) - F.shiftright(b, 32) + F.shiftright(low_half, 32)
    return F.shiftleft(high_half, 32).bitwiseOR(low_half.bitwiseAND(half))


def at_most(keys: list[str], bound: list[int]) -> Column:
    """Whether a composite key comes no later than ``bound``."""
    out = F.col(keys[-1]) <= bound[-1]
    for key, value in zip(reversed(keys[:-1]), reversed(bound[:-1])):
        out = (F.col(key) < value) | ((F.col(key) == value) & out)
    return out


def _placed(batches):
    """Each row with the number of the partition and of the copies before it in the partition."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        copies = batch.column("copies").to_numpy(zero_copy_only=False).astype(np.int64)
        start = before + np.cumsum(copies) - copies
        before += int(copies.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(copies), part), pa.int64()), pa.array(start)], [*batch.schema.names, "part", "start"])


def ranked(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` numbered from 1 by their ``keys`` in a column ``rank``, in parallel over ranges of the keys.

    Rows that agree in all columns travel as one with their number, so that repeated keys
    make no range long.
    """
    columns = rows.columns
    counted = rows.groupBy(columns).agg(F.count("*").alias("copies"))
    ranges = counted.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    schema = ", ".join(f"`{c}` {t}" for c, t in counted.dtypes) + ", part long, start long"
    placed = scratch.save(ranges.mapInArrow(_placed, schema), "ranges")
    # one row a partition
    offset = placed.groupBy("part").agg(F.sum("copies").alias("n"))
    offset = offset.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    blocks = placed.join(F.broadcast(offset), "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}"))))
    first = F.col("block") * COPIES
    within = F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1))
    return blocks.withColumn("copy", within).select(*columns, (F.col("offset") + F.col("start") + F.col("copy") + 1).alias("rank"))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row of ``docs`` with its weight towards ``target`` and, if it is drawn, its rank.

    Columns ``doc_id``, ``n_features``, ``weight`` (mean gain of the features, rounded down; 0
    without features), ``score`` and ``rank`` (from 1 by score; null for those not drawn).
    Null and empty texts have no feature; texts of any length are read whole.  Of rows with
    equal scores the smaller ``doc_id`` comes first, then the one with fewer features; rows
    equal in all of these are interchangeable, and each counts.  A row without a ``doc_id``
    has a weight but no score and is not drawn.  Further columns, whatever their names, are
    not read; an empty table gives an empty result, an empty target weighs all by rarity.
    """
    scratch = Scratch(spark, "resampling")
    gain = gains(bucket_counts(docs, settings), bucket_counts(target, settings))
    scored = scratch.save(score(docs, gain, settings).withColumn("below", -F.col("score")), "scored")
    usable, keys = (F.col("n_words") >= settings.least_words) & F.col("score").isNotNull(), ["below", "doc_id", "n_features"]
    pool = scored.where(usable)
    k = settings.percent * pool.count() // 100
    last, out = kth_key(pool, keys, k), ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    chosen = usable & at_most(keys, last)
    drawn = ranked(scored.where(chosen).select("below", *out), keys, scratch)
    # copies of the last key may be more than are to be drawn
    drawn = drawn.select(*out, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    rest = scored.where(~F.coalesce(chosen, F.lit(False)))
    return rest.select(*out, F.lit(None).cast("long").alias("rank")).unionByName(drawn)


def draw(spark: SparkSession, docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``doc_id`` is drawn."""
    ids = resample(spark, docs, target, settings).where("rank is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").select(docs.columns)


#: The drawn share of ``documents`` towards ``benchmark``, with the default settings.
SQL = r"""
WITH code AS (
  SELECT list(x ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) r(i))),
w AS (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
v AS (SELECT DISTINCT word FROM w),
h AS (SELECT word, hex(encode(word)) AS x FROM v),
b AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM h, code),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM w JOIN b USING (word) GROUP BY bucket),
z AS (SELECT coalesce(sum(s), 0)::BIGINT AS sa, coalesce(sum(t), 0)::BIGINT AS ta FROM n),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sa + 10000))::DOUBLE / ((s + 1) * (ta + 10000))::DOUBLE))::BIGINT AS gain FROM n, z),
d AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN b USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
a AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN d USING (doc_id)),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, 10 * count(*) OVER () // 100 AS most FROM a WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= most THEN k END AS rank FROM a LEFT JOIN r USING (doc_id)
"""
