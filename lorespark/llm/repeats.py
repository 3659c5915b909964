"""Substring dedup by fixed-block anchors.

Documents are packed into batches of about a million words, written once, so that
later passes see the very same batches.

1. Every batch sends the distinct hashes of all its rolling half-windows, with a flag
   for those that start at a non-overlapping reference block.  A hash that is seen
   twice, at least once as a reference block, is an anchor: any repeat of a whole
   window holds an aligned block of half a window.
2. Around its anchors every batch spells out the whole windows, with the smallest
   document id that has each.  The smallest id over all batches decides which windows
   repeat an earlier document.
3. Overlapping repeated windows join to maximal repeats, which are removed.

Hashes are pre-aggregated in a batch before they move, so a passage that a third of
all documents share is one entry of each batch.  They are compared range by range of
their values; batches are put together before they are cut into ranges, and a corpus
with more ranges than a shuffle should have partitions is cut twice, so that the pieces
grow with the corpus and not with its square.  Answers travel as one bit for each entry
of a range in which a batch has any hit.

Whole windows are compared by 96 bits that are mixed from the 64-bit hashes of their
words.  Two different windows are taken for equal if these bits are the same, by a
chance of about 2**-96 for a pair, or if they differ just in words whose 64-bit hashes
are the same, by one of 2**-64 for a pair of words.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, byte_values, groups, mix, shuffle_partitions

WINDOW = 50
#: Words and bytes at which a batch is closed; a longer text is a batch of its own.
BATCH_WORDS = 600_000
BATCH_BYTES = 6 << 20
#: Half-window hashes are sent with so many bits; equal ones of different words cost a comparison of whole windows.
ANCHOR_BITS = 44
#: Entries that one range should hold at most, and that are put together before they are cut into ranges.
KEY_WINDOWS, MERGED_ENTRIES = 6_000_000, 2_000_000
#: Partitions of a shuffle; more ranges are cut again where they arrive.
MOST_PARTS = 20_000
#: Stands for a null id, which is after all others.
NO_ID = np.iinfo(np.int64).max

OUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,stop:long>>"


# --- batches --------------------------------------------------------------------------


def _pack(batches, batch_words=BATCH_WORDS):
    task, number = TaskContext.get().partitionId(), 0
    ids, texts, words, size = [], [], 0, 0

    def packed():
        blob = zstandard.ZstdCompressor(level=6).compress(b"\n".join(texts))
        known = np.array([x is not None for x in ids], dtype=np.uint8)
        numbers = np.array([0 if x is None else x for x in ids], dtype=np.int64)
        row = [[task << 32 | number], [words], [numbers.tobytes()], [known.tobytes()], [blob]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["batch", "words", "ids", "known", "blob"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), byte_values(batch.column("text"))):
            split = (text or b"").split()
            joined = b" ".join(split)
            if ids and (words + len(split) > batch_words or size + len(joined) > BATCH_BYTES):
                yield packed()
                number += 1
                ids, texts, words, size = [], [], 0, 0
            ids.append(doc)
            texts.append(joined)
            words += len(split)
            size += len(joined)
    if ids:
        yield packed()


class Batch:
    """Word hashes of a packed batch, end to end, with each document's place."""

    def __init__(self, row: dict, window: int):
        self.number, self.window, self.half = row["batch"], window, window // 2
        self.ids, self.known = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["known"], dtype=np.uint8)
        self.rank_ids = np.where(self.known > 0, self.ids, NO_ID)
        self.texts = zstandard.ZstdDecompressor().decompress(row["blob"]).split(b"\n")
        digest = xxhash.xxh64_intdigest
        self.sizes = np.zeros(len(self.texts), dtype=np.int64)
        parts = []
        for k, text in enumerate(self.texts):
            words = text.split()
            self.sizes[k] = len(words)
            if len(words) >= window:  # a shorter document holds no window
                parts.append(np.fromiter(map(digest, words), dtype=np.uint64, count=len(words)))
        self.long = np.flatnonzero(self.sizes >= window)
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[self.long])]).astype(np.int64)

    def rolled(self, length: int, salt: int) -> np.ndarray:
        """Hash of the ``length`` words from every place on."""
        step, width, out, done = mix(self.hashes + np.uint64(salt)), 1, None, 0
        a, b = np.uint64(0xD6E8FEB86659FD93 + 2 * salt), np.uint64(0xA0761D6478BD642F + 2 * salt)
        total = len(self.hashes) - length + 1
        if total <= 0:
            return np.zeros(0, dtype=np.uint64)
        while True:
            if length & width:
                part = step[done : done + total]
                out = part.copy() if out is None else mix(out * a + part)
                done += width
            if done == length:
                return out
            step = mix(step[:-width] * a + step[width:] * b)
            width *= 2

    def within(self, length: int) -> np.ndarray:
        """Places from which ``length`` words stay in one document."""
        good = np.zeros(max(0, len(self.hashes) - length + 1), dtype=bool)
        for a, b in zip(self.starts[:-1], self.starts[1:]):
            good[a : b - length + 1] = True
        return good

    def anchors(self):
        """Sorted distinct short hashes, whether each is met twice, and is a reference block; and all by place."""
        short = self.rolled(self.half, 0) >> np.uint64(64 - ANCHOR_BITS)
        good = self.within(self.half)
        values, counts = np.unique(short[good], return_counts=True)
        blocks = [np.arange(a, b - self.half + 1, self.half) for a, b in zip(self.starts[:-1], self.starts[1:])]
        marked = np.isin(values, np.unique(short[np.concatenate(blocks)])) if blocks else np.zeros(0, dtype=bool)
        return values, counts > 1, marked, short, good

    def candidates(self, hits: np.ndarray):
        """Places whose whole window holds an anchor; their distinct hashes with the smallest id of each."""
        values, _, _, short, good = self.anchors()
        wanted = values[hits]
        at = np.searchsorted(wanted, short)
        found = good & (at < len(wanted))
        found[found] = wanted[at[found]] == short[found]
        seen = np.concatenate([[0], np.cumsum(found)])
        whole = np.flatnonzero(self.within(self.window))
        places = whole[seen[whole + self.window - self.half + 1] > seen[whole]]
        one, two = self.rolled(self.window, 0)[places], (self.rolled(self.window, 77)[places] >> np.uint64(32)).astype(np.uint32)
        doc = self.long[np.searchsorted(self.starts, places, side="right") - 1]
        order = np.lexsort((self.rank_ids[doc], two, one))
        a, b = one[order], two[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, dtype=bool)
        entry = np.empty(len(order), dtype=np.int64)
        entry[order] = np.cumsum(first) - 1
        return places, doc, entry, a[first], b[first], self.rank_ids[doc[order[first]]]


def _unpacked(batches, window):
    for rows in batches:
        for row in rows.to_pylist():
            yield row, Batch(row, window)


class Ranges:
    """Equal ranges of values of ``bits`` bits, ``subs`` of them to each of ``parts`` partitions."""

    def __init__(self, bits: int, parts: int, subs: int):
        self.bits, self.parts, self.subs, self.merged = bits, parts, subs, MERGED_ENTRIES

    @staticmethod
    def of(bits: int, words: int, least: int) -> Ranges:
        wanted = max(least, -(-words // KEY_WINDOWS))
        parts = min(wanted, max(least, MOST_PARTS))
        return Ranges(bits, parts, -(-wanted // parts))

    def edges(self, keys) -> np.ndarray:
        """The least value of each range."""
        most = (1 << self.bits) - 1
        return np.array([min(most, (k << self.bits) // (self.parts * self.subs)) for k in keys], dtype=np.uint64)

    def cut(self, values: np.ndarray, keys) -> np.ndarray:
        """Where each of the ranges begins in sorted values."""
        return np.searchsorted(values, self.edges(keys))


class Fragments:
    """Entries of several batches, each sorted by value, that are cut into ranges together."""

    def __init__(self, ranges: Ranges, make, fields, keys, edges: np.ndarray):
        self.merged, self.make, self.fields, self.keys, self.edges = ranges.merged, make, fields, keys, edges
        self.held, self.count = [], 0

    def add(self, batch: int, *columns: np.ndarray):
        """Keeps a batch's entries, the values first; gives rows when there are many."""
        if len(columns[0]):
            self.held.append((batch, columns))
            self.count += len(columns[0])
        if self.count >= self.merged:
            yield from self.rows()

    def rows(self):
        cuts = [np.concatenate([[0], np.searchsorted(c[0], self.edges), [len(c[0])]]) for _, c in self.held]
        out = []
        for k, key in enumerate(self.keys):
            own = [(batch, [c[at[k] : at[k + 1]] for c in columns]) for (batch, columns), at in zip(self.held, cuts) if at[k] < at[k + 1]]
            if own:
                numbers, sizes = np.array([b for b, _ in own], dtype=np.int64), np.array([len(c[0]) for _, c in own], dtype=np.int64)
                out.append((key, numbers.tobytes(), sizes.tobytes(), *self.make(*(np.concatenate(x) for x in zip(*(c for _, c in own))))))
        self.held, self.count = [], 0
        if out:
            yield _rows(out, self.fields)


def _planes(deltas: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, which compress where the high bytes are zero."""
    return np.ascontiguousarray(deltas.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _anchor_bytes(values: np.ndarray, twice: np.ndarray, marked: np.ndarray) -> tuple:
    """Values as differences of 48 bits, and the flags."""
    steps = np.diff(values, prepend=np.uint64(0))
    high = ((steps >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2")
    return _planes(steps & np.uint64(0xFFFFFFFF)), high.tobytes() if high.any() else None, np.packbits(twice).tobytes(), np.packbits(marked).tobytes()


def _anchor_columns(row: dict) -> tuple[np.ndarray, ...]:
    steps = _from_planes(row["low"]).astype(np.uint64)
    if row["high"] is not None:
        steps |= np.frombuffer(row["high"], dtype="<u2").astype(np.uint64) << np.uint64(32)
    values = np.cumsum(steps, dtype=np.uint64) & np.uint64((1 << 48) - 1)
    return values, _flags(row["twice"], len(values)), _flags(row["marked"], len(values))


def _window_bytes(one: np.ndarray, two: np.ndarray, least: np.ndarray) -> tuple:
    ids, pick = np.unique(least, return_inverse=True)
    return one.tobytes(), two.tobytes(), pick.astype("<u4").tobytes(), ids.tobytes()


def _window_columns(row: dict) -> tuple[np.ndarray, ...]:
    ids, pick = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["pick"], dtype="<u4")
    return np.frombuffer(row["one"], dtype=np.uint64), np.frombuffer(row["two"], dtype=np.uint32), ids[pick]


def _send_anchors(window, ranges):
    def run(batches):
        parts = range(ranges.parts)
        sent = Fragments(ranges, _anchor_bytes, SENT_ANCHORS, parts, ranges.edges(range(ranges.subs, ranges.parts * ranges.subs, ranges.subs)))
        for _, batch in _unpacked(batches, window):
            values, twice, marked, _, _ = batch.anchors()
            yield from sent.add(batch.number, values, twice, marked)
        yield from sent.rows()

    return run


def _cut_again(ranges, make, columns, fields):
    """Rows of a partition's whole range as rows of the ranges in it."""

    def run(batches):
        for part, rows in groups(batches, "key"):
            keys = range(part * ranges.subs, (part + 1) * ranges.subs)
            sent = Fragments(ranges, make, fields, keys, ranges.edges(keys[1:]))
            for row in (r for x in rows for r in x.to_pylist()):
                whole, ends = columns(row), np.cumsum(_integers(row["sizes"]))
                for batch, end, size in zip(_integers(row["batches"]), ends, _integers(row["sizes"])):
                    yield from sent.add(int(batch), *(c[end - size : end] for c in whole))
            yield from sent.rows()

    return run


def _integers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


_OF = [("key", pa.int32()), ("batches", pa.binary()), ("sizes", pa.binary())]
SENT_ANCHORS = [*_OF, ("low", pa.binary()), ("high", pa.binary()), ("twice", pa.binary()), ("marked", pa.binary())]
SENT_WINDOWS = [*_OF, ("one", pa.binary()), ("two", pa.binary()), ("pick", pa.binary()), ("ids", pa.binary())]
ANSWERS = [("batch", pa.int64()), ("key", pa.int32()), ("bits", pa.binary())]


def _rows(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _flags(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count).astype(bool)


def _answer(rows: list[dict], key: int, bits: np.ndarray) -> pa.RecordBatch:
    """The flags of each batch that has any set."""
    numbers, sizes = (np.concatenate([_integers(r[c]) for r in rows]).tolist() for c in ("batches", "sizes"))
    ends = np.cumsum(sizes)
    return _rows([(n, key, np.packbits(bits[e - s : e]).tobytes()) for n, s, e in zip(numbers, sizes, ends) if bits[e - s : e].any()], ANSWERS)


def _joined(batches, columns):
    """One range after another: its rows, and its entries put together."""
    for key, parts in groups(batches, "key"):
        rows = [r for p in parts for r in p.to_pylist()]
        yield key, rows, *(np.concatenate(c) for c in zip(*map(columns, rows)))


def _join_anchors(batches):
    for key, rows, every, twice, marked in _joined(batches, _anchor_columns):
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        run = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        many = np.bincount(run) > 1
        many |= np.bincount(run, weights=twice[order]) > 0
        many &= np.bincount(run, weights=marked[order]) > 0
        bits = np.empty(len(every), dtype=bool)
        bits[order] = many[run]
        yield _answer(rows, key, bits)


def _collected(answer, values: np.ndarray, ranges: Ranges) -> np.ndarray:
    """The answers of all ranges as one flag for each of a batch's sorted values."""
    out = np.zeros(len(values), dtype=bool)
    if answer:
        keys = [part["key"] for part in answer]
        for part, a, b in zip(answer, ranges.cut(values, keys), ranges.cut(values, [k + 1 for k in keys]) if keys else ()):
            b = len(values) if part["key"] + 1 == ranges.parts * ranges.subs else b
            out[a:b] = _flags(part["bits"], b - a)
    return out


def _hits(row, batch: Batch, ranges: Ranges) -> np.ndarray:
    return _collected(row["anchors"], batch.anchors()[0], ranges)


def _send_windows(window, anchors, ranges):
    def run(batches):
        sent = Fragments(ranges, _window_bytes, SENT_WINDOWS, range(ranges.parts), ranges.edges(range(ranges.subs, ranges.parts * ranges.subs, ranges.subs)))
        for row, batch in _unpacked(batches, window):
            hits = _hits(row, batch, anchors)
            if hits.any():
                _, _, _, one, two, least = batch.candidates(hits)
                yield from sent.add(batch.number, one, two, least)
        yield from sent.rows()

    return run


def _join_windows(batches):
    for key, rows, one, two, least in _joined(batches, _window_columns):
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        starts = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        first = np.minimum.reduceat(least[order], np.flatnonzero(starts))
        bits = np.empty(len(one), dtype=bool)
        bits[order] = first[np.cumsum(starts) - 1] < least[order]
        yield _answer(rows, key, bits)


def _finish(window, anchors, ranges):
    def run(batches):
        for row, batch in _unpacked(batches, window):
            covered = np.zeros(len(batch.hashes) + 1, dtype=np.int32)
            hits = _hits(row, batch, anchors)
            if hits.any():
                places, doc, entry, one, _, least = batch.candidates(hits)
                older = _collected(row["windows"], one, ranges)
                gone = places[older[entry] | (batch.rank_ids[doc] > least[entry])]
                np.add.at(covered, gone, 1)
                np.add.at(covered, gone + window, -1)
            inside = np.cumsum(covered)[:-1] > 0
            place = dict(zip(batch.long.tolist(), range(len(batch.long))))
            out, size = [], 0
            for k, text in enumerate(batch.texts):
                kept, spans, lost = text, [], 0
                if k in place:
                    own = inside[batch.starts[place[k]] : batch.starts[place[k] + 1]]
                    lost = int(own.sum())
                    if lost:
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                        spans = [{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)]
                        words = text.split()
                        kept = b" ".join(words[i] for i in np.flatnonzero(~own))
                out.append((int(batch.ids[k]) if batch.known[k] else None, int(batch.sizes[k]), lost, kept.decode("utf-8"), spans))
            yield _rows(out, FINISHED)

    return run


FINISHED = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]


def _schema(fields) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{n} {names[t]}" for n, t in fields)


def _asked(sent: DataFrame, ranges: Ranges, answer, make, columns, fields) -> DataFrame:
    """The answers to what was sent, by batch and range."""
    here = sent.repartition(ranges.parts, "key").sortWithinPartitions("key")
    if ranges.subs > 1:
        here = here.mapInArrow(_cut_again(ranges, make, columns, fields), _schema(fields)).sortWithinPartitions("key")
    return here.mapInArrow(answer, _schema(ANSWERS))


def _by_batch(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("batch").agg(F.collect_list(F.struct("key", "bits")).alias(name))


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, batch_words: int = BATCH_WORDS) -> DataFrame:
    """Removes every word that a window repeating an earlier document covers.

    A window is ``window`` consecutive words (runs of characters other than space and
    tab to carriage return); it repeats if its words also start a window of a document
    with a smaller ``doc_id``.  All windows are judged on the input.

    One row for every row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``,
    ``kept_text`` (kept words joined by one space) and ``removed`` (maximal spans of word
    places).  A null text has no words.  A row without a ``doc_id`` comes after all ids:
    it may lose words and takes none from others.  Rows with an equal ``doc_id`` take
    nothing from each other.  Further columns, whatever their names, are not read; an
    empty table gives none.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be an even number of words, for two blocks of half its size")
    scratch = Scratch(spark, "repeats")
    packed = scratch.save(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_pack, batch_words=batch_words), "batch long, words long, ids binary, known binary, blob binary"),
        "packed",
        "none",
    )
    words, least = packed.agg(F.sum("words")).first()[0] or 0, shuffle_partitions(spark)
    short, whole = Ranges.of(ANCHOR_BITS, words, least), Ranges.of(64, words, least)
    sent = packed.mapInArrow(_send_anchors(window, short), _schema(SENT_ANCHORS))
    anchors = scratch.save(_by_batch(_asked(sent, short, _join_anchors, _anchor_bytes, _anchor_columns, SENT_ANCHORS), "anchors"), "anchors")
    # the answers are the small side: no sort of the packed texts
    hit = packed.join(anchors.hint("shuffle_hash"), "batch")
    sent = hit.mapInArrow(_send_windows(window, short, whole), _schema(SENT_WINDOWS))
    windows = scratch.save(_by_batch(_asked(sent, whole, _join_windows, _window_bytes, _window_columns, SENT_WINDOWS), "windows"), "windows")
    answers = anchors.join(windows, "batch", "left")
    return packed.join(answers.hint("shuffle_hash"), "batch", "left").mapInArrow(_finish(window, short, whole), OUT)
