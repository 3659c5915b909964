"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their key:

    block*   zstd of entries: shared prefix, rest of the key, value (varint lengths first)
    index    for each block: first key, place, size, documents and ids before it
    bloom    bits over the keys' hashes
    footer   64 bytes: places and sizes of index and bloom, counts, id width, checksum, magic

A lookup reads the footer, asks the Bloom filter, finds the block by binary search in the
sparse index and reads that block alone.  Keys are eight bytes that sort as the numbers
do, behind a byte that puts a null id last.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, slices
from lorespark.llm.tokenize import encoder

MAGIC = b"LSTABLE1"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES = 256 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: UTF-8 bytes of text that a task should sort and encode; beyond so many tasks each gets more.
TASK_BYTES, MOST_TASKS = 24 << 20, 100_000
#: Bytes and documents at which a task begins another shard.
SHARD_BYTES, SHARD_DOCS = 64 << 20, 250_000
END_ID = 0


def key_of(doc_id: int | None) -> bytes:
    return b"\x02" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return None if key == b"\x02" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, size: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + k * b) % (1 << 64) % size for k in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard to an open binary stream; keys must not descend."""

    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.place = self.docs = self.ids = 0
        self.block, self.last, self.first = bytearray(), b"", b""
        self.before = (0, 0)
        self.index: list[tuple] = []
        self.keys: list[bytes] = []
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, value: bytes) -> None:
        key = key_of(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must not descend")
        if not self.block:
            self.first, self.last, self.before = key, b"", (self.docs, self.ids)
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zstd.compress(bytes(self.block))
            self.stream.write(data)
            self.index.append((self.first, self.place, len(data), *self.before))
            self.place += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQQQ", *rest) for k, *rest in self.index)
        size = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bits = np.zeros(size, dtype=np.uint8)
        for key in self.keys:
            bits[_bloom_places(key, size)] = 1
        bloom = np.packbits(bits).tobytes()
        self.stream.write(index)
        self.stream.write(bloom)
        self.stream.write(FOOTER.pack(self.place, len(index), self.place + len(index), len(bloom), self.docs, self.ids, self.width, zlib.crc32(index + bloom), MAGIC))


class Reader:
    """Reads a shard from a random-access stream."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.size()
        index_at, index_size, bloom_at, bloom_size, self.docs, self.ids, self.width, check, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        index, self.bloom = self._read(index_at, index_size), self._read(bloom_at, bloom_size)
        if zlib.crc32(index + self.bloom) != check:
            raise ValueError("the shard's index or Bloom filter is damaged")
        self.firsts, self.blocks, at = [], [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.firsts.append(index[at : at + n])
            self.blocks.append(struct.unpack_from("<QQQQ", index, at + n))
            at += n + 32

    def _read(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def block(self, number: int):
        """Keys and values of a block."""
        place, size, *_ = self.blocks[number]
        data, at, key = zstandard.ZstdDecompressor().decompress(self._read(place, size)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def items(self):
        for number in range(len(self.blocks)):
            yield from self.block(number)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(key, 8 * len(self.bloom)))

    def lookup(self, doc_id: int | None) -> list[bytes]:
        """Values of all entries with the id, in their order."""
        key = key_of(doc_id)
        if not self.blocks or not self.may_hold(key):
            return []
        out = []
        for number in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            out += [v for k, v in self.block(number) if k == key]
        return out


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


_MANIFEST = [("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())]


def _write(folder: str, tokenizer: str):
    def run(batches):
        task, tool, seq, writer, stream = TaskContext.get(), encoder(tokenizer), 0, None, None
        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        end = np.array([END_ID], dtype=tool.kind).tobytes()

        def closed():
            writer.close()
            stream.close()
            row = [task.partitionId(), seq, f"{folder}/{name}", writer.docs, writer.ids, writer.keys[0], writer.keys[-1]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, _MANIFEST)], [n for n, _ in _MANIFEST])

        for batch in slices(batches, "text", 4 << 20):
            values = tool.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc, value in zip(batch.column("doc_id").to_pylist(), values):
                if writer is None:
                    # a task that runs again writes files of its own; the manifest names those that count
                    name = f"shard-{task.partitionId():06d}-{seq:06d}-{task.taskAttemptId()}.sst"
                    stream = system.open_output_stream(f"{inner}/{name}")
                    writer = Writer(stream, tool.kind.itemsize)
                writer.add(doc, value + end)
                if writer.docs >= SHARD_DOCS or writer.place + len(writer.block) >= SHARD_BYTES:
                    yield closed()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield closed()

    return run


def write(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Encodes every row's whole text, with the end id after it, into shards in ``doc_id`` order.

    ``folder`` is one that all executors share.  Rows are partitioned by ranges of
    ``doc_id``; a task sorts its range, encodes it and writes one shard after another as
    they fill, so that no shard is held in memory.  Null and empty texts are the end id
    alone.  Rows without a ``doc_id`` come last; rows with the same ``doc_id`` are all
    kept, in the order of a hash of their text, by which a hot id is split.  Further
    columns, whatever their names, are not read.

    Returns the manifest, which is written to ``folder`` too: a row for each shard with
    ``part`` and ``seq`` (their order), ``path``, ``docs``, ``ids``, ``first_key``,
    ``last_key`` and ``start`` (ids before it).  An empty table gives no shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    ranged = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(min(MOST_TASKS, total // TASK_BYTES + 1), *order)
    written = ranged.sortWithinPartitions(*order, "text").select("doc_id", "text").mapInArrow(_write(folder, tokenizer), "part int, seq int, path string, docs long, ids long, first_key binary, last_key binary")
    scratch = Scratch(spark, "shards")
    shards = scratch.save(written, "written")
    # running sums in two steps: over the tasks, of which there are few, and over the shards of each
    before = shards.groupBy("part").agg(F.sum("ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("ids")
    shards.join(before, "part").withColumn("start", F.col("before") + own).drop("before").write.parquet(f"{folder}/manifest")
    scratch.drop(shards)
    return spark.read.parquet(f"{folder}/manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document in the shards: ``doc_id``, ``start``, ``n_tokens``, and ``ids`` as little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                with _open(shard["path"]) as stream:
                    reader, start, out, size = Reader(stream), shard["start"], [], 0
                    for key, value in reader.items():
                        ids = np.frombuffer(value, dtype=f"<u{reader.width}").astype("<u4")
                        out.append((id_of(key), start, len(ids), ids.tobytes()))
                        start, size = start + len(ids), size + 4 * len(ids)
                        if size > 8 << 20:
                            yield _read_rows(out)
                            out, size = [], 0
                    if out:
                        yield _read_rows(out)

    places = manifest.select("path", "start")
    return places.repartition(min(MOST_TASKS, max(1, manifest.count()))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _read_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids"])


def lookup(manifest: DataFrame, doc_id: int | None) -> list[list[int]]:
    """Ids of every entry of one document, read from the blocks that hold it in the shards whose keys are around it."""
    key = key_of(doc_id)
    near = manifest.where((F.col("first_key") <= F.lit(bytearray(key))) & (F.col("last_key") >= F.lit(bytearray(key))))
    out = []
    for path in near.orderBy("part", "seq").select("path").toLocalIterator():
        with _open(path[0]) as stream:
            reader = Reader(stream)
            out += [np.frombuffer(v, dtype=f"<u{reader.width}").tolist() for v in reader.lookup(doc_id)]
    return out
