import random

import pytest

from lorespark.llm import repeats


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            rank = float("inf") if doc is None else doc
            first[key] = min(first.get(key, float("inf")), rank)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (float("inf") if doc is None else doc):
                gone |= set(range(i, i + window))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch_words,limits", [(150, {}), (600_000, {}), (150, {"KEY_WINDOWS": 40, "MOST_PARTS": 5, "MERGED_ENTRIES": 400})])
def test_matches_brute_force(spark, monkeypatch, batch_words, limits):
    for name, value in limits.items():
        monkeypatch.setattr(repeats, name, value)
    if limits:
        assert repeats.Ranges.of(44, 10_000, 4).subs == 50
    rng = random.Random(5)
    make = lambda n: [rng.choice("abc") + str(rng.randrange(30)) for _ in range(n)]
    shared = [make(rng.randint(8, 30)) for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 40):
        parts = [make(rng.randint(0, 25)) for _ in range(4)] + rng.sample(shared, 2)
        rng.shuffle(parts)
        rows.append((i, "  ".join(w for p in parts for w in p)))
    copy = rows[3][1]
    rows += [(2000 + i, copy) for i in range(10)] + [(None, copy), (None, None), (7000, ""), (7001, None), (7002, "x " * 200), (7002, "x " * 200), (7003, "é é " * 30)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int").repartition(3)
    got = repeats.remove_repeats(spark, docs, 10, batch_words).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute(rows, 10)
    for r in got:
        assert sum(s.stop - s.start for s in r.removed) == r.n_removed


def test_empty_and_odd_window(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(spark, docs).collect() == []
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark, docs, 7)
