import hashlib
import random
import re
from collections import Counter
from math import floor, log
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from lorespark.llm import resampling, words
from lorespark.llm.common import Scratch
from lorespark.llm.resampling import Settings

SCHEMA = "doc_id long, text string, score string, Rank int"


def brute_features(text, runs):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(own), [crc32(" ".join(own[i : i + n]).encode()) for n in range(1, runs + 1) for i in range(len(own) - n + 1)]


def brute(rows, target, settings):
    found = [brute_features(t, settings.runs) for _, t in rows]
    s, t = Counter(h % settings.buckets for _, f in found for h in f), Counter(h % settings.buckets for x in target for h in brute_features(x, settings.runs)[1])
    sa, ta, n = sum(s.values()), sum(t.values()), settings.buckets
    gain = {b: floor(1000 * log((t[b] + 1) * (sa + n) / ((s[b] + 1) * (ta + n)))) for b in range(n)}
    out = []
    for (d, _), (n_words, f) in zip(rows, found):
        weight = sum(gain[h % n] for h in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{settings.seed}:{d}".encode()).hexdigest()[:8], 16)
        out.append([d, n_words, len(f), weight, None if d is None else weight + floor(-1000 * log(-log((h + 0.5) / 2**32))), None])
    pool = sorted((r for r in out if r[1] >= settings.least_words and r[4] is not None), key=lambda r: (-r[4], r[0], r[2]))
    for k, row in enumerate(pool[: settings.percent * len(pool) // 100], 1):
        row[5] = k
    return sorted(([r[0], *r[2:]] for r in out), key=str)


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_equals_brute_force(spark, runs, monkeypatch):
    monkeypatch.setattr(resampling, "COPIES", 3)
    rng = random.Random(runs)
    text = lambda: " ".join(rng.choice(["Ab", "é", "x9", "lorem", "ipsum", "42", "-", "a_b", "\tQ"]) for _ in range(rng.randint(0, 60)))
    rows = [(i, text()) for i in range(150)] + [(None, text()), (None, None), (900, None), (901, ""), (-(2**63), text() * 9), (2**63 - 1, text() * 9)]
    rows += [(77, "lorem ipsum " * 30)] * 25 + [(77, "lorem " * 40)] * 5
    target = ["lorem ipsum dolor", None, "", "lorem " * 50]
    settings = Settings(buckets=50, runs=runs, percent=30)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    found = resampling.resample(spark, docs, spark.createDataFrame([(t,) for t in target], "text string"), settings)
    assert sorted(([r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in found.collect()), key=str) == brute(rows, target, settings)


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, f"lorem {'ipsum ' * (i % 30)}", "s", i) for i in range(60)], SCHEMA)
    target, settings = docs.limit(1).select("text"), Settings(percent=50)
    ids = {r.doc_id for r in resampling.resample(spark, docs, target, settings).where("rank is not null").collect()}
    found = resampling.draw(spark, docs, target, settings)
    assert found.columns == docs.columns and {r.doc_id for r in found.collect()} == ids and len(ids) == 11


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(spark, docs, docs).collect() == []
    some = spark.createDataFrame([(1, "a " * 30, "", 0)], SCHEMA)
    assert [r["rank"] for r in resampling.resample(spark, some, docs).collect()] == [None]


@pytest.mark.parametrize("k", [0, 1, 2, 7, 40, 41, 60, 61])
def test_kth_key(spark, k):
    """Over both ends of the longs, with hot keys."""
    rng = random.Random(3)
    rows = [(rng.choice([-(2**63), 2**63 - 1, 0, 5]), rng.choice([-1, 2**40, rng.randrange(2**62)])) for _ in range(40)] + [(5, 7)] * 20
    frame = spark.createDataFrame(rows, "a long, b long")
    want = sorted(rows)[k - 1] if 0 < k <= len(rows) else None
    found = resampling.kth_key(frame, ["a", "b"], k)
    assert (tuple(found) if found else None) == want
    if want:
        assert frame.where(resampling.at_most(["a", "b"], found)).count() == sum(r <= want for r in rows)


def test_ranks_are_those_of_one_sort(spark):
    frame = spark.range(0, 500).select((F.col("id") % 37).alias("a"), F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("b"))
    found = resampling.ranked(frame, ["a", "b"], Scratch(spark, "test")).orderBy("rank").collect()
    assert [(r.a, r.b) for r in found] == sorted((r.a, r.b) for r in frame.collect()) and [r["rank"] for r in found] == list(range(1, 501))


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_features_do_not_depend_on_pieces(size, monkeypatch):
    text = " ".join(random.Random(size).choice(["Ab", "é", "x9", "longer_words,and", "42"]) for _ in range(200))
    monkeypatch.setattr(words, "PIECE_BYTES", size)
    found = [h for _, part in resampling._buckets(text.encode(), Settings(buckets=997, runs=3)) for h in part.tolist()]
    assert sorted(found) == sorted(h % 997 for h in brute_features(text, 3)[1])
