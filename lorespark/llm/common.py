"""Shared plumbing: the folder all executors see, written tables, Arrow helpers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lorespark.operators.tables import shared_dir

#: The characters that separate words in every contract of this subpackage.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


#: Folders of intermediate tables that are still there, with the session that wrote them.
_FOLDERS: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(folders: list[str]) -> None:
    for folder in folders:
        _delete(_FOLDERS.pop(folder), folder)


@contextmanager
def scratch_scope():
    """Deletes the intermediate tables that were begun inside, once the result that reads them has been written."""
    before = set(_FOLDERS)
    try:
        yield
    finally:
        _forget([f for f in _FOLDERS if f not in before])


@atexit.register
def _forget_all() -> None:
    """A result that is read without a scope keeps its tables until the driver ends."""
    try:
        _forget(list(_FOLDERS))
    except Exception:  # the session is gone, and with it the way to the folder
        _FOLDERS.clear()


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of any executor and is computed only once,
    which ``checkpoint()`` would do twice.  ``drop`` frees those that later steps no
    longer read; the rest go with ``scratch_scope`` or with the driver.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        _FOLDERS[self.root] = spark

    def save(self, frame: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{label}"
        frame.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out.scratch_path = path
        return out

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{label}"

    def drop(self, *frames: DataFrame | str) -> None:
        for frame in frames:
            _delete(self.spark, frame if isinstance(frame, str) else frame.scratch_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def encoded(text: str | None) -> bytes:
    """UTF-8 bytes; nulls are empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def byte_values(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without building Python strings."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text; a longer text is alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of one key at a time, from batches sorted by an integer key."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != current:
                yield current, held
                held = []
            current = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield current, held


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))
