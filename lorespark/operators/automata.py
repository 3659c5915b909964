"""Many patterns in one pass over a text: substrings, whole words and globs by one automaton.

The patterns are broadcast where their size is checked to be small, and each Python worker
builds the automaton once; a text is walked once, however many patterns there are.  More
patterns than that are joined by the text's runs of a few characters.
"""

from __future__ import annotations

import fnmatch
import re
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators.tables import saved

#: Bytes of patterns, and patterns, that are broadcast.
MOST_BYTES, MOST_PATTERNS = 32 << 20, 500_000
#: Characters of a pattern by which it is joined beyond that.
GRAM = 8


class Needles:
    """Patterns whose automaton is built where it is first used, and stays there."""

    def __init__(self, patterns: list[str]):
        self.patterns, self._machine = patterns, None

    def __getstate__(self):
        return {"patterns": self.patterns, "_machine": None}

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for k, p in enumerate(self.patterns):
                self._machine.add_word(p, k)
            self._machine.make_automaton()
        return self._machine

    def count(self, text: str, whole: bool) -> dict[str, int]:
        """How often each pattern that is in the text is there; ``whole`` ones only between signs that are no part of a word."""
        found: dict[int, int] = defaultdict(int)
        if self.patterns:
            for end, k in self.machine().iter(text):
                if not whole or _apart(text, end + 1 - len(self.patterns[k]), end + 1):
                    found[k] += 1
        return {self.patterns[k]: n for k, n in found.items()}


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_"


def _apart(text: str, start: int, end: int) -> bool:
    return not (start and _inside(text[start - 1])) and not (end < len(text) and _inside(text[end]))


def _occurrences(text: str, pattern: str, whole: bool) -> int:
    n, at = 0, text.find(pattern)
    while at >= 0:
        n += not whole or _apart(text, at, at + len(pattern))
        at = text.find(pattern, at + 1)
    return n


def contained(spark: SparkSession, texts: DataFrame, patterns: DataFrame, whole: bool = False, key: str = "doc_id", text: str = "text", pattern: str = "pattern") -> DataFrame:
    """``key``, ``pattern`` and ``n`` of every pattern in every text, as they are spelled.

    ``n`` counts occurrences, which may overlap.  With ``whole`` only those count that are
    not inside a longer word.  Null texts, and null and empty patterns, give nothing; texts
    that repeat a key each have their own rows.  Broadcast up to ``MOST_BYTES`` and
    ``MOST_PATTERNS``; beyond, texts meet the patterns by their first ``GRAM`` characters.
    """
    asked = patterns.select(F.col(pattern).cast("string").alias("pattern")).where("pattern <> ''").distinct()
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    kind = dict(rows.dtypes)["key"]
    size = asked.agg(F.sum(F.octet_length("pattern")).alias("bytes"), F.count("*").alias("n")).first()
    if (size.bytes or 0) <= MOST_BYTES and size.n <= MOST_PATTERNS:
        shared = spark.sparkContext.broadcast(Needles(sorted(r.pattern for r in asked.collect())))

        def run(batches):
            for batch in batches:
                found = [shared.value.count(t, whole) for t in batch.column("text").to_pylist()]
                at = pa.array([k for k, f in enumerate(found) for _ in f], pa.int64())
                columns = [batch.column("key").take(at), pa.array([p for f in found for p in f], pa.string()), pa.array([n for f in found for n in f.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "pattern", "n"])

        out = rows.mapInArrow(run, f"key {kind}, pattern string, n long")
    else:
        out = _by_grams(spark, rows, asked, whole)
    return out.select(F.col("key").alias(key), "pattern", "n")


def _by_grams(spark: SparkSession, rows: DataFrame, asked: DataFrame, whole: bool) -> DataFrame:
    held = saved(spark, rows.select(F.monotonically_increasing_id().alias("row"), "key", "text"))
    grams = asked.select("pattern", F.left("pattern", F.lit(GRAM)).alias("gram"))
    lengths = sorted(r.n for r in grams.select(F.char_length("gram").alias("n")).distinct().collect())  # GRAM at most

    def cut(batches):
        for batch in batches:
            for row, own in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                found = sorted({own[i : i + n] for n in lengths for i in range(len(own) - n + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array(found, pa.string())], ["row", "gram"])

    near = held.select("row", "text").mapInArrow(cut, "row long, gram string").join(grams, "gram").select("row", "pattern")

    def count(batches):
        for batch in batches:
            n = [_occurrences(t, p, whole) for t, p in zip(batch.column("text").to_pylist(), batch.column("pattern").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("pattern"), pa.array(n, pa.int64())], ["key", "pattern", "n"])

    kind = dict(held.dtypes)["key"]
    return near.join(held, "row").select("key", "pattern", "text").mapInArrow(count, f"key {kind}, pattern string, n long").where("n > 0")


# --- globs ----------------------------------------------------------------------------


def literals(glob: str) -> list[str]:
    """The runs of plain characters of a glob, as ``fnmatch`` reads it; each is in every path that fits."""
    out, now, i = [], "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "[":
            j = i
            for sign in "!]":  # either may come first inside the brackets
                if glob[j : j + 1] == sign:
                    j += 1
            end = glob.find("]", j)
            if end >= 0:
                i, c = end + 1, "?"
        if c in "*?":
            out.append(now)
            now = ""
        else:
            now += c
    return [x for x in [*out, now] if x]


class Globs:
    """Globs by an automaton of the longest plain run of each: a path is walked once, and only globs whose run is in it are tried."""

    def __init__(self, globs: list[str]):
        self.globs = globs
        runs: dict[str, list[int]] = defaultdict(list)
        #: Globs without a plain character fit by length alone or by a set; they are tried on every path.
        self.always: list[int] = []
        for k, g in enumerate(globs):
            found = literals(g)
            runs[max(found, key=len)].append(k) if found else self.always.append(k)
        self.needles = Needles(sorted(runs))
        self.of = [runs[r] for r in self.needles.patterns]
        self._tests: dict[int, re.Pattern] = {}

    def fits(self, path: str) -> list[int]:
        """Numbers of the globs that a path fits, in order."""
        near = set(self.always)
        if self.needles.patterns:
            for _, k in self.needles.machine().iter(path):
                near.update(self.of[k])
        return [k for k in sorted(near) if self._test(k)(path)]

    def _test(self, k: int):
        if k not in self._tests:
            self._tests[k] = re.compile(fnmatch.translate(self.globs[k])).match
        return self._tests[k]
