"""Texts as short vectors: weighted words and pairs of words, projected by a randomised truncated SVD.

The weighted counts stay a distributed table of one row a document.  A power iteration
multiplies them with a block of vectors and back in one pass over the rows; only that
block, a row for each of at most ``MOST_TERMS`` terms, goes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import vectors
from lorespark.operators import keywords
from lorespark.operators.tables import saved

#: Terms in the most documents that take part.
MOST_TERMS = 20_000
#: Vectors beside those that are asked for, and passes: each makes the leading ones stand out more.
SPARE_VECTORS, PASSES = 5, 4


def weighted(spark: SparkSession, docs: DataFrame, by: str = "doc_id", least_documents: int = 2, grams: int = 2, most: int = MOST_TERMS) -> tuple[DataFrame, DataFrame]:
    """``by``, ``places`` and ``x`` (weights at length 1) of every document with a term, and the terms (``word``, ``place``, ``weight``).

    Terms are words and runs of words in at least ``least_documents`` documents; rarer in
    documents means heavier.
    """
    counts = keywords.document_counts(docs, grams=grams).where(F.col("df") >= least_documents).orderBy(F.desc("df"), "word").limit(most)
    n = docs.count()
    place = (F.row_number().over(Window.orderBy(F.desc("df"), "word")) - 1).cast("int")  # a bounded number of rows
    terms = saved(spark, counts.select("word", place.alias("place"), F.log(1 + n / F.col("df")).alias("weight")))
    known = terms.select("word").toArrow().column("word").combine_chunks().cast(pa.string())  # up to ``most``
    found = keywords.mentions(docs, by, grams=grams, among=known).join(F.broadcast(terms), "word").select(by, "place", (F.col("tf") * F.col("weight")).alias("x"))
    rows = found.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("t"))
    size = F.sqrt(F.aggregate("t", F.lit(0.0), lambda s, t: s + t["x"] * t["x"]))
    # a column of the size would be put into the lambda, and computed again for each term
    x = vectors.let(size, lambda n: F.transform("t", lambda t: t["x"] / n))
    rows = rows.select(by, F.transform("t", lambda t: t["place"]).alias("places"), x.alias("x"))
    return saved(spark, rows), terms


def _products(batch: pa.RecordBatch, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and weight of each number in a batch, and the product of each row with the block."""
    lists = batch.column("places")
    row, place = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    y = np.zeros((batch.num_rows, block.shape[1]))
    np.add.at(y, row, x[:, None] * block[place])
    return row, place, x, y


def _power(spark: SparkSession, rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """The rows' table times itself times the block: a sum over the rows, added up in each task first."""
    shared = spark.sparkContext.broadcast(block)

    def run(batches):
        total = np.zeros(shared.value.shape)
        for whole in batches:
            for batch in (whole.slice(at, 2048) for at in range(0, whole.num_rows, 2048)):
                row, place, x, y = _products(batch, shared.value)
                np.add.at(total, place, x[:, None] * y[row])
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c) for c in total[at].T)], ["place", *names])

    names = [f"z{k}" for k in range(block.shape[1])]
    sums = rows.mapInArrow(run, "place int, " + ", ".join(f"{n} double" for n in names)).groupBy("place").agg(*(F.sum(n).alias(n) for n in names))
    out = np.zeros(block.shape)
    for r in sums.collect():
        out[r.place] = r[1:]
    shared.unpersist()
    return out


def components(spark: SparkSession, rows: DataFrame, terms: int, dimensions: int, seed: int = 42) -> np.ndarray:
    """The leading right singular vectors of the rows' table, a column each, the largest number of each positive."""
    width = min(terms, dimensions + SPARE_VECTORS)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, width)))[0]
    for _ in range(PASSES):
        image = _power(spark, rows, block)
        before, block = block, np.linalg.qr(image)[0]
    image = _power(spark, rows, block)
    values, turned = np.linalg.eigh(block.T @ image)
    block = block @ turned[:, ::-1][:, :dimensions]
    return block * np.where(block[np.abs(block).argmax(axis=0), np.arange(block.shape[1])] < 0, -1.0, 1.0)


def project(spark: SparkSession, docs: DataFrame, dimensions: int = 5, by: str = "doc_id", least_documents: int = 2, grams: int = 2, most: int = MOST_TERMS) -> DataFrame:
    """``by`` and ``embedding``, of up to ``dimensions`` numbers, of every document with a term.

    Null and empty texts, and those whose words are in too few documents, have no row; rows
    that repeat an id are one document.
    """
    rows, terms = weighted(spark, docs, by, least_documents, grams, most)
    n = terms.count()
    if not n:
        return spark.createDataFrame([], rows.select(by, F.lit(None).cast("array<double>").alias("embedding")).schema)
    shared = spark.sparkContext.broadcast(components(spark, rows, n, dimensions))
    kind = dict(rows.dtypes)[by]

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(at, 2048) for at in range(0, whole.num_rows, 2048)):
                y = _products(batch, shared.value)[3]
                yield pa.RecordBatch.from_arrays([batch.column(by), pa.array(list(y), pa.list_(pa.float64()))], [by, "embedding"])

    return rows.mapInArrow(run, f"`{by}` {kind}, embedding array<double>")
