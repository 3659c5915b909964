import random
import re
from collections import Counter

import pytest

from lorespark.llm import mixing


def targets(sizes, weights=(1, 2, 3), most=3):
    """Shares of the total by weight, stopped at ``most`` times a size and the excess reshared by weight."""
    left, out = set(range(len(sizes))), [0.0] * len(sizes)
    total = float(sum(sizes))
    while left:
        weight = sum(weights[k % len(weights)] for k in left)
        given = {k: total * weights[k % len(weights)] / weight for k in left}
        above = [k for k in left if given[k] > most * sizes[k]]
        for k in above or left:
            out[k] = float(most * sizes[k]) if above else given[k]
        if not above:
            break
        total -= sum(most * sizes[k] for k in above)
        left -= set(above)
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 10, 10], [0, 5], [0, 0], [7], [3, 900, 1, 1, 40, 2, 5000, 8, 0, 60]])
def test_targets_stop_and_reshare(spark, sizes):
    rows = [(i, "w " * n, f"s{i:03d}") for i, n in enumerate(sizes)]
    got = mixing.plan(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).orderBy("source").collect()
    assert [r.target for r in got] == targets(sizes) and [r.size for r in got] == sizes


def test_many_sources_and_clashing_names(spark):
    rows = [(i, "w x y " * (i % 7), f"s{i % 3000:05d}", i, "m") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copies long, mix_whole string")
    plan = {r.source: r for r in mixing.plan(spark, docs).collect()}
    sizes = [sum(3 * (i % 7) for i in (k, k + 3000)) for k in range(3000)]
    assert [plan[f"s{k:05d}"].target for k in range(3000)] == pytest.approx(targets(sizes))
    mixed = mixing.mix(spark, docs)
    assert mixed.columns == ["doc_id", "text", "source", "mix_whole", "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    copies = {r.doc_id: r.mix_copies for r in mixed.collect()}
    out = mixing.mixture(spark, docs)
    assert out.columns == docs.columns
    found = Counter(r.doc_id for r in out.collect())
    assert found == Counter({d: n for d, n in copies.items() if n}) and all(r.mix_copies == r.doc_id and r.mix_whole == "m" for r in out.collect())


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000, "a"), (2, "word " * 10, "b")], "doc_id long, text string, source string")
    assert {r.doc_id: r.mix_size for r in mixing.mix(spark, docs).collect()} == {1: 200_000, 2: 10}


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = []
    for k, (source, n) in enumerate([("b", 900), ("a", 60), ("é", 300), (None, 200), ("", 30), ("empty", 3), ("z", 400)]):
        for _ in range(n):
            text = rng.choice([None, "", " \t"]) if source == "empty" else "w x " * rng.randint(1, 40)
            rows.append((len(rows), text, source, "clash"))
    rows += [(None, "same row here", "twins", "clash")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(5)
    got = mixing.mix(spark, docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    sources = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(size(r[1]) for r in rows if r[2] == s) for s in sources]
    want = dict(zip(sources, targets(sizes)))
    for s, total in zip(sources, sizes):
        own = [r for r in got if r.source == s]
        assert all(r.mix_size == size(r.text) and r.mix_source_size == total and r.mix_target == want[s] and 0 <= r.mix_copies <= 3 for r in own)
        taken = sum(r.mix_size * r.mix_copies for r in own)
        largest = max(r.mix_size for r in own) * (50 if s == "twins" else 1)
        assert abs(taken - want[s]) <= largest / 2 + 1e-6
    again = mixing.mix(spark, docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mixture(spark, docs).columns == docs.columns
    assert mixing.mixture(spark, docs).count() == sum(r.mix_copies for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(spark, docs).collect() == []
