"""URL rules in a sorted digest array.

The file holds two arrays of sorted 64-bit xxhash keys, one of hosts that have rules and
one of whole rules, each beside the places of the full strings.  Executors map the file
into memory and probe it with a vectorised binary search; a hit counts only if the
stored string is the very one that was asked for, so colliding keys do no harm.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import shared_dir

MAGIC = b"LSDIGEST"
SEED = 0


def _keys(strings: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in strings), dtype=np.uint64, count=len(strings))


def _section(entries: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Keys in order, and for each the place of ``string, value`` in the heap."""
    strings = list(entries)
    keys = _keys(strings)
    order = np.argsort(keys, kind="stable")
    heap, places = bytearray(), []
    for i in order:
        places.append(len(heap))
        heap += struct.pack("<II", len(strings[i]), len(entries[strings[i]])) + strings[i] + entries[strings[i]]
    return keys[order], np.array(places, dtype=np.uint64), bytes(heap)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.encode().translate(_LOWER).decode(), slash + path  # A-Z only, as hosts are


def build(rules: Iterable[tuple[str, str]]) -> bytes:
    """The file for ``(rule, verdict)`` pairs; the last verdict of a repeated rule holds."""
    whole: dict[bytes, bytes] = {}
    lengths: dict[bytes, set[int]] = {}
    for rule, verdict in rules:
        host, path = split_rule(rule)
        whole[(host + path).encode()] = verdict.encode()
        lengths.setdefault(host.encode(), set()).add(len(path.encode()))
    hosts = {h: np.array(sorted(v), dtype="<u4").tobytes() for h, v in lengths.items()}
    parts, table = [], []
    for keys, places, heap in (_section(hosts), _section(whole)):
        table += [len(keys), len(heap)]
        parts += [keys.astype("<u8").tobytes(), places.astype("<u8").tobytes(), heap + b"\0" * (-len(heap) % 8)]
    return MAGIC + struct.pack("<4Q", *table) + b"".join(parts)


class DigestArray:
    """Reader of the file through a memory map."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype=np.uint8, mode="r")
        if bytes(data[:8]) != MAGIC:
            raise ValueError(f"{path} is not a digest array")
        table = struct.unpack("<4Q", bytes(data[8:40]))
        at, self.sections = 40, []
        for count, size in (table[:2], table[2:]):
            keys = data[at : at + 8 * count].view("<u8")
            places = data[at + 8 * count : at + 16 * count].view("<u8")
            heap = data[at + 16 * count : at + 16 * count + size]
            self.sections.append((keys, places, heap))
            at += 16 * count + size + -size % 8

    def find(self, section: int, strings: list[bytes]) -> list[bytes | None]:
        """The value stored with each string; equal keys are all compared."""
        keys, places, heap = self.sections[section]
        if not len(keys) or not strings:
            return [None] * len(strings)
        asked = _keys(strings)
        first, last = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
        out: list[bytes | None] = [None] * len(strings)
        for i in np.flatnonzero(last > first):
            for k in range(first[i], last[i]):
                at = int(places[k])
                n, m = struct.unpack("<II", heap[at : at + 8].tobytes())
                if heap[at + 8 : at + 8 + n].tobytes() == strings[i]:
                    out[i] = heap[at + 8 + n : at + 8 + n + m].tobytes()
        return out


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def parts_of(url: str | None) -> tuple[bytes, bytes]:
    """Host with A-Z lower-cased, and path; both empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return b"", b""
    data = rest.encode("utf-8", "surrogatepass")
    ends = [k for k in (data.find(b"?"), data.find(b"#")) if k >= 0]
    data = data[: min(ends, default=len(data))]
    host, slash, path = data.partition(b"/")
    return host.translate(_LOWER), slash + path


def suffixes(host: bytes) -> list[bytes]:
    out = [host]
    while b"." in host:
        host = host.partition(b".")[2]
        out.append(host)
    return out


def match(array: DigestArray, urls: list[str | None]) -> list[tuple[str, str, str | None, str | None]]:
    """Host, path, rule that wins and its verdict for each url."""
    split = [parts_of(u) for u in urls]
    names = sorted({h for h, _ in split})
    asked = [(h, s) for h in names for s in suffixes(h)]
    found: dict[bytes, list[tuple[bytes, list[int]]]] = {}
    for (host, suffix), value in zip(asked, array.find(0, [s for _, s in asked])):
        if value is not None:
            found.setdefault(host, []).append((suffix, np.frombuffer(value, dtype="<u4").tolist()))
    probes = [(i, s, s + p[:n]) for i, (h, p) in enumerate(split) for s, sizes in found.get(h, ()) for n in sizes if n <= len(p)]
    best: dict[int, tuple] = {}
    for (i, suffix, rule), verdict in zip(probes, array.find(1, [r for *_, r in probes])):
        if verdict is not None:
            best[i] = max(best.get(i, (-1,)), (len(rule), len(suffix), rule, verdict))
    text = lambda b: b.decode("utf-8", "replace")
    return [(text(h), text(p), *((text(best[i][2]), text(best[i][3])) if i in best else (None, None))) for i, (h, p) in enumerate(split)]


def publish(spark: SparkSession, data: bytes) -> str:
    """Puts the file in the shared folder and has Spark hand it to every executor, late ones too."""
    name = f"rules-{xxhash.xxh3_128_hexdigest(data)}-{uuid.uuid4().hex[:8]}.sda"
    target = f"{shared_dir(spark)}/{name}"
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    try:
        for at in range(0, len(data), 1 << 20):
            stream.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        stream.close()
    context.addFile(target)
    return name


def judge(spark: SparkSession, pages: DataFrame, rules: Iterable[tuple[str, str]], otherwise: str = "allow") -> DataFrame:
    """Verdict on every row's ``url``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    A rule ``host/path`` fits its host and all subdomains if the url's path starts with
    the rule's.  The longest rule wins, of equally long ones that with the longer host.
    Without a rule the verdict is ``otherwise``, also for null urls and those without
    ``://``.  Ports and user names are part of the host.  One pass, without a shuffle;
    repeated rows are judged one by one and further columns are not read.
    """
    name = publish(spark, build(rules))

    def run(batches):
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            rows = match(array, batch.column("url").to_pylist())
            if rows:
                host, path, rule, verdict = (list(c) for c in zip(*rows))
                verdict = [otherwise if v is None else v for v in verdict]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in (host, path, rule, verdict))], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

SQL = r"""
WITH rules(host, path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, len(regexp_extract(rest, '^[^/]*')) + 1) AS path
  FROM p),
m AS (
  SELECT q.page_id, q.host, q.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY q.page_id ORDER BY len(r.host || r.path) DESC, len(r.host) DESC) AS k
  FROM q LEFT JOIN rules r
    ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
