"""Vector expressions over array columns, and a deterministic embedder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    scaled = lambda v: let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))
    return let(doubles(a), scaled)


def character_embedding(text: Column, dimensions: int = 64) -> Column:
    """Unit vector of how often each code point, modulo the dimensions, is in the lower-cased text.

    Stands in for a language model wherever one can be plugged in.
    """
    codes = F.transform(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), lambda c: F.ascii(c) % dimensions)
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    return unit(let(codes, lambda own: F.transform(places, lambda d: F.size(F.filter(own, lambda c: c == d)).cast("double"))))


def counted_characters(text: Column, dimensions: int = 64) -> Column:
    """The same by batches outside the JVM, for long tables: every character is looked at once, not once for each dimension. Null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        held = [t for t in texts.to_pylist() if t is not None]
        counts = [np.bincount(np.frombuffer(t.encode("utf-32-le"), dtype="<u4") % dimensions, minlength=dimensions) for t in held]
        own = np.array(counts, dtype=np.float64).reshape(-1, dimensions)
        size = np.sqrt((own * own).sum(1, keepdims=True))
        own = np.divide(own, size, out=own, where=size > 0)
        at = np.concatenate([[0], np.cumsum(np.where(texts.is_valid().to_numpy(zero_copy_only=False), dimensions, 0))])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(own.ravel()), mask=texts.is_null())

    return F.arrow_udf(run, "array<double>")(F.lower(text))
