"""Cutting texts: sentences, budgets, running headers, semantic groups, section chunks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lorespark.functions import vectors

#: Characters between blocks of a chunk.
GAP = 2
SPANS = ArrayType(StructType([StructField(n, IntegerType()) for n in ("start", "stop")]))
CHUNKS = ArrayType(StructType([StructField(n, IntegerType()) for n in ("start", "stop", "size")]))


def sentences(text: Column) -> Column:
    """Pieces between white space that follows a full stop, an exclamation or a question mark."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def _lists(sizes: pa.Array):
    """The lists of an array of integer lists, null ones as empty."""
    values, offsets = sizes.values.to_numpy(zero_copy_only=False), sizes.offsets.to_pylist()
    for a, b in zip(offsets, offsets[1:]):
        yield values[a:b].tolist()


def pack(pieces: Column, budget: int, gap: int = 1) -> Column:
    """Greedy packing of an array of texts: runs of pieces whose sizes and gaps fit the budget.

    A piece that is larger than the budget is a run of its own.  A fold that appends to a
    list copies it at each step in SQL expressions, which long texts can't afford; so the
    sizes alone go to an Arrow function that is linear.
    """

    def run(sizes: pa.Array) -> pa.Array:
        runs, ends = [], [0]
        for own in _lists(sizes):
            start = size = 0
            for i, n in enumerate(own):
                if size > 0 and size + n + gap + 1 <= budget:
                    size += n + gap
                    continue
                if size > 0:
                    runs.append((start, i, size))
                start, size = i, n + gap
            if size > 0:
                runs.append((start, len(own), size))
            ends.append(len(runs))
        columns = [pa.array(c, pa.int32()) for c in (zip(*runs) if runs else ((), (), ()))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "stop", "size"]), mask=sizes.is_null())

    return F.arrow_udf(run, CHUNKS)(F.transform(pieces, lambda s: F.length(s)))


def merge_short(sizes: Column, least: int) -> Column:
    """Group number of each size: sizes are gathered until their sum reaches ``least``; a short tail joins the last group."""

    def run(sizes: pa.Array) -> pa.Array:
        out, ends = [], [0]
        for own in _lists(sizes):
            group = total = 0
            for n in own:
                out.append(group)
                total += n
                if total >= least:
                    group, total = group + 1, 0
            if group and total > 0:  # the tail
                k = len(out)
                while k > ends[-1] and out[k - 1] == group:
                    k -= 1
                    out[k] = group - 1
            ends.append(len(out))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()), mask=sizes.is_null())

    return F.arrow_udf(run, ArrayType(IntegerType()))(sizes.cast("array<int>"))


def carry_header(blocks: DataFrame, by: str, order: str, kind: str = "type", text: str = "text") -> DataFrame:
    """The last header at or before each block."""
    run = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.last(F.when(F.col(kind) == "header", F.col(text)), ignorenulls=True).over(run))


def semantic_groups(points: DataFrame, least: float, by: list[str], order: list[str], vector: str = "embedding") -> DataFrame:
    """Number of the run of neighbours that stay similar: a cut where the similarity to the one before is under ``least``."""
    run = Window.partitionBy(*by).orderBy(*order)
    sim = F.round(vectors.cosine(F.col(vector), F.lag(vector).over(run)), 6)
    return points.withColumn("sim", sim).withColumn("grp", F.sum(F.when(F.col("sim") < least, 1).otherwise(0)).over(run).cast("long"))


def section_spans(sizes: list[int], heads: list[bool], least: int, most: float, overlap: int, gap: int = GAP) -> list[tuple[int, int]]:
    """Ranges of blocks that make chunks.

    Sections begin at headers; one shorter than ``least`` runs on into the next, and a
    short end belongs to the last.  A section over ``most`` is cut between blocks, and
    each further part begins with the blocks before the cut that fit ``overlap``.
    """
    upto = [0, *accumulate(sizes)]
    bounds, start = [], 0
    for end in [k for k in range(1, len(sizes)) if heads[k]] + [len(sizes)] * bool(sizes):
        if upto[end] - upto[start] + gap * (end - start - 1) >= least:
            bounds.append((start, end))
            start = end
    if start < len(sizes):
        bounds = [*bounds[:-1], (bounds[-1][0] if bounds else 0, len(sizes))]
    out = []
    for start, end in bounds:
        if upto[end] - upto[start] + gap * (end - start - 1) <= most:
            out.append((start, end))
            continue
        first, least_stop = start, start + 1
        while True:
            stop = min(end, max(least_stop, bisect_right(upto, upto[first] + most) - 1))
            out.append((first, stop))
            if stop == end:
                break
            first, least_stop = max(first, bisect_left(upto, upto[stop] - overlap)), stop + 1
    return out


def _block_chunks(held: DataFrame, begins: Column, by: str, order: str, **limits) -> DataFrame:
    block = F.struct(F.col(order).alias("o"), "id", F.trim("text").alias("text"), "section", begins.alias("head"))
    gathered = held.groupBy(by).agg(F.sort_array(F.collect_list(block)).alias("b"))

    def run(sizes: pa.Array, heads: pa.Array) -> pa.Array:
        spans, ends = [], [0]
        for own, marks in zip(_lists(sizes), _lists(heads)):
            spans += section_spans(own, marks, **limits)
            ends.append(len(spans))
        columns = [pa.array(c, pa.int32()) for c in (zip(*spans) if spans else ((), ()))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "stop"]))

    spans = F.arrow_udf(run, SPANS)(F.transform("b", lambda x: F.length(x["text"])), F.transform("b", lambda x: x["head"]))
    runs = gathered.select(by, "b", F.posexplode(spans).alias("idx", "run"))
    part = F.slice(F.col("b"), F.col("run.start") + 1, F.col("run.stop") - F.col("run.start"))
    text = F.array_join(F.transform(part, lambda x: x["text"]), "\n\n")
    return runs.select(by, "idx", F.get(part, F.lit(0))["section"].alias("section"), text.alias("text"), F.transform(part, lambda x: x["id"]).alias("block_ids"), F.length(text).alias("char_count"))


def section_chunks(blocks: DataFrame, most: int = 2000, least: int = 200, overlap: int = 100, by: str = "article_id", order: str = "pos") -> DataFrame:
    """Chunks of whole blocks, by sections.

    ``article_id``, ``idx`` from 0 in reading order, ``section`` (the header at or before
    the first block), ``text``, ``block_ids`` and ``char_count``.  Blank blocks are left out.
    """
    held = carry_header(blocks.where(F.trim("text") != ""), by, order)
    return _block_chunks(held, F.col("type") == "header", by, order, least=least, most=most, overlap=overlap)


def semantic_chunks(blocks: DataFrame, similarity: float = 0.5, least: int = 200, by: str = "article_id", order: str = "pos", vector: str | None = None) -> DataFrame:
    """Chunks of whole blocks, cut where neighbours are less similar than ``similarity``; shorter ones run on.

    Columns are those of ``section_chunks``.  Without a column of vectors the
    deterministic ones are used.
    """
    held = carry_header(blocks.where(F.trim("text") != ""), by, order)
    held = held.withColumn("_v", vectors.character_embedding(F.col("text")) if vector is None else F.col(vector))
    grouped = semantic_groups(held, similarity, [by], [order], "_v")
    return _block_chunks(grouped, F.coalesce(F.col("sim") < similarity, F.lit(False)), by, order, least=least, most=float("inf"), overlap=0, gap=0)


def hybrid_chunks(docs: DataFrame, most: int = 2000, least: float = 0.6, by: str = "article_id", embed=None) -> DataFrame:
    """Sentence chunks: cut where neighbours are unlike or the budget is full.

    A text within the budget is one chunk.  ``embed`` maps a sentence to a vector; the
    default is the deterministic one.
    """
    from lorespark.operators.clustering import character_vector

    embed = embed or character_vector

    def cut(pieces: list[str]) -> list[str]:
        whole = " ".join(pieces)
        if len(whole) <= most:
            return [whole] if whole else []
        vectors_ = np.array([embed(p) for p in pieces])
        size = np.linalg.norm(vectors_, axis=1)
        both = size[1:] * size[:-1]
        alike = np.divide((vectors_[1:] * vectors_[:-1]).sum(1), both, out=np.zeros(len(both)), where=both > 0) >= least
        out = [pieces[0]]
        for piece, near in zip(pieces[1:], alike):
            if near and len(out[-1]) + len(piece) + 1 <= most:
                out[-1] += " " + piece
            else:
                out.append(piece)
        return out

    def run(frames):
        for frame in frames:
            rows = [(a, k, c, f"{a}_chunk_{k:03d}", len(c)) for a, s in zip(frame[by], frame["s"]) for k, c in enumerate(cut(list(s)))]
            yield pd.DataFrame(rows, columns=[by, "idx", "text", "chunk_id", "char_count"])

    chosen = docs.where("text is not null").select(by, sentences(F.col("text")).alias("s"))
    return chosen.mapInPandas(run, f"{by} {dict(docs.dtypes)[by]}, idx int, text string, chunk_id string, char_count int")
