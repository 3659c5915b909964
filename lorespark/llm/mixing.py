"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash.  A source's budget is met by all documents below a threshold
of that hash: sizes are summed by source and hash bucket, the bucket in which the budget
runs out is found from the running sum, and only that bucket is summed again at a finer
grain.  Thresholds of growing budgets are nested.  The mix is then a filter: documents
are never sorted.  The plan is a table of one row for each source, however many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions.names import spare
from lorespark.llm.common import Scratch, shuffle_partitions

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Bits of the hash that a pass resolves, and of the whole hash.
STEP_BITS, HASH_BITS = 12, 48


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash() -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), 64 - HASH_BITS)


def _weighed(scratch: Scratch, sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``source``, ``size`` and ``weight``: sources by code point, null last, get the weights in turn.

    Ranks are places within ranges of sources behind the number of sources in the ranges before.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("size"))
    ranges = scratch.save(sums.repartitionByRange(shuffle_partitions(scratch.spark), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))).cast("int"))
    return scratch.save(ranges.join(before, "part").select("source", "size", weight.cast("double").alias("weight")), "weights")


def _with_targets(weighed: DataFrame, most: int) -> DataFrame:
    """Adds ``target``: shares of the total by weight, stopped at ``most`` times a size and the excess reshared by weight."""
    total, weight = weighed.agg(F.sum("size"), F.sum("weight")).first()
    limit, above, left, seen = F.col("size") * most, F.lit(False), float(total or 0), 0
    share = F.lit(0.0)
    while weight:
        share = F.lit(left) * F.col("weight") / F.lit(weight)
        above = above | (share > limit)
        n, given, used = weighed.where(above).agg(F.count("*"), F.sum(limit), F.sum("weight")).first()
        if n == seen:
            break
        seen, left, weight = n, float((total or 0) - given), weighed.agg(F.sum("weight")).first()[0] - used
    return weighed.withColumn("target", F.when(above, limit.cast("double")).otherwise(share))


def plan(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """A row for each source: ``source``, ``size``, ``target``, ``copies`` of the whole source and hash ``threshold``."""
    scratch = Scratch(spark, "mixing")
    sized = scratch.save(docs.select(F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"), _hash().alias("h")), "sizes")
    shares = _with_targets(_weighed(scratch, sized, weights), most)
    copies = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int")
    shares = shares.withColumn("copies", copies).withColumn("rest", F.when(F.col("size") > 0, F.col("target") - F.col("copies") * F.col("size")).otherwise(0.0))
    none = F.lit(0).cast("long")
    shares = scratch.save(shares.select("source", "size", "target", "copies", "rest", none.alias("low"), none.alias("below"), (F.col("rest") <= 0).alias("done"), none.alias("threshold")), "shares")
    for bits in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        if shares.where("not done").isEmpty():
            break
        shares = scratch.save(_refined(sized, shares, bits), "shares")
    scratch.drop(sized)
    return shares.select("source", "size", "target", "copies", "threshold")


def _refined(sized: DataFrame, shares: DataFrame, bits: int) -> DataFrame:
    """Sums the boundary range of each open source by the next bits and moves into the bucket where its budget runs out."""
    wide = bits + STEP_BITS
    edge = shares.where("not done").select(F.col("source").alias("at"), "low", (F.col("rest") - F.col("below")).alias("budget"))
    inside = sized.join(edge, F.col("source").eqNullSafe(F.col("at")) & (F.shiftright("h", wide) == F.shiftright("low", wide)))
    sums = inside.groupBy("at", "budget", F.shiftright("h", bits).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
    upto = F.sum("n").over(Window.partitionBy("at").orderBy("bucket"))
    ended = sums.withColumn("upto", upto).where("upto > budget").groupBy("at").agg(F.min(F.struct("bucket", "upto", "n", "docs")).alias("b"))
    start = F.shiftleft(F.col("b.bucket"), bits)
    below = F.col("below") + F.col("b.upto") - F.col("b.n")
    # one document, or documents with one hash: whichever end is nearer
    last = (F.col("b.docs") == 1) | F.lit(bits == 0)
    nearer = F.abs(below + F.col("b.n") - F.col("rest")) < F.abs(below - F.col("rest"))
    found = F.col("b").isNotNull()
    moved = shares.join(ended, F.col("source").eqNullSafe(F.col("at")), "left")
    # an open source that ends nowhere fits whole
    return moved.select(
        "source", "size", "target", "copies", "rest",
        F.when(found, start).otherwise(F.col("low")).alias("low"),
        F.when(found, below).otherwise(F.col("below")).alias("below"),
        (F.col("done") | ~found | last).alias("done"),
        F.when(F.col("done"), F.col("threshold")).when(~found, F.lit(1 << HASH_BITS)).when(last & nearer, start + (1 << bits)).otherwise(start).alias("threshold"),
    )


def _mixed(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with size, source size, target and copies in columns of the names that are returned."""
    names = spare(docs.columns, "mix_source", "mix_source_size", "mix_target", "mix_whole", "mix_threshold", "mix_size", "mix_copies")
    source, source_size, target, whole, threshold, size, copies = names
    shares = plan(spark, docs, weights, most).toDF(source, source_size, target, whole, threshold)
    joined = docs.join(shares, F.col("source").cast("string").eqNullSafe(F.col(source)))
    more = F.when((F.col(whole) < most) & (_hash() < F.col(threshold)), 1).otherwise(0)
    counted = joined.withColumn(size, words(F.col("text").cast("string"))).withColumn(copies, F.col(whole) + more)
    return counted.drop(source, whole, threshold), [size, source_size, target, copies]


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Every row of ``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``.

    Sources in the order of their code points, null last, get the weights in turn, as
    shares of all words; a target stops at ``most`` times its source.  A document is taken
    ``mix_copies`` times, 0 to ``most``: as often as its whole source fits the target, and
    once more if its hash is below the source's threshold.  The hash is of ``doc_id`` and
    text, so reruns agree and rows that are equal in both are taken alike; they are the
    one case in which a source can miss its target by more than half a document.  Null and
    empty texts and sources without words have size 0; a null source is one like any
    other, and rows without a ``doc_id`` go by their text.  Columns of ``docs`` with one of
    the four names are replaced, all others are kept.  An empty table gives an empty one.
    """
    wanted = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    mixed, names = _mixed(spark, docs, weights, most)
    kept = [c for c in docs.columns if c.lower() not in wanted]
    return mixed.select(*kept, *(F.col(n).alias(w) for n, w in zip(names, wanted)))


def mixture(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them, with the very columns of ``docs``.

    Nulls, empty texts, repeated rows and ties of hashes count as in ``mix``; a source
    without words gives no row, and no column of ``docs`` is replaced, whatever its name.
    """
    mixed, (*_, copies) = _mixed(spark, docs, weights, most)
    taken = mixed.where(F.col(copies) > 0)
    return taken.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(docs.columns)
