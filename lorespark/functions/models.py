"""Models as plain callables over columns: embedders, summarisers, extractors, found by dotted path and called by batch."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, DoubleType, StringType, StructField, StructType


def resolve(path: str, base: type | None = None, **arguments):
    """What a dotted path names; a class is made with the arguments, and must derive from ``base`` if one is given."""
    module, _, name = path.rpartition(".")
    if not module:
        raise ValueError(f"{path!r} is no dotted path")
    try:
        found = getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise ImportError(f"can't find {path!r}") from e
    if base is not None and not (isinstance(found, type) and issubclass(found, base)):
        raise TypeError(f"{path!r} is no {base.__name__}")
    if isinstance(found, type):
        return found(**arguments)
    if not callable(found):
        raise TypeError(f"{path!r} can't be called")
    return found


def apply(frame: DataFrame, column: str, model: Callable[[list[str]], list], out: str, kind: DataType, batch: int = 32, make: bool = False) -> DataFrame:
    """Every row with what a model gives for its text, and the message of the batch's error if it fails.

    ``model`` takes a list of texts and returns as many values; with ``make`` it is a
    function that returns such a model, called once in each task.  Null texts are not
    asked about.  A batch that fails is asked again row by row, so one bad text costs
    only itself.
    """
    schema = StructType([*frame.schema.fields, StructField(out, kind), StructField(f"{out}_error", StringType())])

    def ask(tool, texts: list[str]) -> list[tuple]:
        try:
            values = list(tool(texts))
            if len(values) != len(texts):
                raise ValueError(f"{len(values)} values for {len(texts)} texts")
            return [(v, None) for v in values]
        except Exception as e:
            return [(None, str(e)[:300])] if len(texts) == 1 else [r for t in texts for r in ask(tool, [t])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = model() if make else model
        for rows in frames:
            texts = [None if pd.isna(t) else t for t in rows[column]]
            wanted = [k for k, t in enumerate(texts) if t is not None]
            found: list[tuple] = [(None, None)] * len(texts)
            for start in range(0, len(wanted), batch):
                part = wanted[start : start + batch]
                for k, answer in zip(part, ask(tool, [texts[k] for k in part])):
                    found[k] = answer
            yield rows.assign(**{out: pd.Series([v for v, _ in found], index=rows.index, dtype=object), f"{out}_error": pd.Series([e for _, e in found], index=rows.index, dtype=object)})

    return frame.mapInPandas(run, schema)


def embed(frame: DataFrame, column: str, model: Callable[[list[str]], list], out: str = "embedding", batch: int = 32) -> DataFrame:
    return apply(frame, column, model, out, ArrayType(DoubleType()), batch)


def ask(frame: DataFrame, column: str, model: Callable[[list[str]], list[str]], out: str = "answer", batch: int = 8) -> DataFrame:
    return apply(frame, column, model, out, StringType(), batch)
