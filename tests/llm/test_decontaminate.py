import random

from pyspark.sql import functions as F

from lorespark.llm import decontaminate as dc


def shingles(words, n=5):
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(docs, items):
    """Shingle sets compared one pair at a time; those of a short item are all its words."""
    out = []
    for d, t in docs:
        w = dc.words_of(t)
        for i, q in items:
            v = dc.words_of(q)
            need, have = (shingles(x, min(5, len(v))) for x in (v, w))
            c = len(need & have)
            if v and c >= 0.8 * len(need) - 1e-9:
                out.append((d, i, len(need), c, c / len(need)))
    return sorted(out, key=str)


def data():
    rng = random.Random(2)
    word = lambda: rng.choice("abcdé") + str(rng.randrange(50))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 20, 60, 200])))) for i in range(30)]
    items += [(30, None), (31, "..."), (32, items[5][1]), (None, items[6][1]), (33, "rep rep rep rep rep rep rep rep")]
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 50, 3000])))) for i in range(30)]
    for k in range(60):
        w = items[rng.randrange(30)][1].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        cut = rng.randrange(len(w))
        pad = " ".join(word() for _ in range(rng.choice([0, 2000])))
        docs.append((100 + k, f"{pad} {' '.join(w[:cut]).upper()}, \n{'; '.join(w[cut:])} {pad}"))
    docs += [(900, None), (901, ""), (None, items[7][1]), (902, items[8][1]), (902, items[8][1]), (903, "Rep " * 500), (904, (items[9][1] + " ") * 300)]
    docs += [(905, f"{items[k][1]}!") for k, _ in enumerate(items[:30]) if len(items[k][1].split()) < 5] + [(906, f"say {items[k][1]}") for k, _ in enumerate(items[:30]) if len(items[k][1].split()) < 5]
    docs += [(907, " ".join(word() for _ in range(20_000)) + " " + items[15][1])]
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = data()
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 30
    assert sorted(map(tuple, dc.matches(spark, frame, bench).collect()), key=str) == want
    assert any(d == 906 and n == 1 for d, _, n, _, _ in want)
    bad = {(d, t) for d, t in docs if brute([(d, t)], items)}
    clash = frame.withColumns({"_key": F.lit(1), "ROW": F.lit(2)})
    for block in (dc.BLOCK_BYTES, 1000):  # broadcast, then joined
        monkeypatch.setattr(dc, "BLOCK_BYTES", block)
        assert sorted(map(tuple, dc.matches(spark, frame, bench).collect()), key=str) == want
        kept = dc.decontaminate(spark, clash, bench)
        assert kept.columns == clash.columns
        assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted(((d, t) for d, t in docs if (d, t) not in bad), key=str)


def test_short_items_in_long_documents(spark, monkeypatch):
    """Of every length below a shingle's, anywhere in the text, and not where the words only come near."""
    filler = " ".join(f"f{i}" for i in range(60))
    docs = [(1, f"{filler} alpha beta gamma {filler}"), (2, f"{filler} alpha beta {filler} gamma"), (3, "Alpha, beta gamma"), (4, f"{filler} solo"), (5, "alpha beta gamma delta")]
    items = [(1, "alpha beta gamma"), (2, "solo"), (3, "alpha beta"), (4, "beta gamma delta epsilon"), (5, "alpha beta gamma delta")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {(d, i) for d, i, *_ in want} == {(1, 1), (3, 1), (5, 1), (4, 2), (1, 3), (2, 3), (3, 3), (5, 3), (5, 5)}
    for block in (dc.BLOCK_BYTES, 10):
        monkeypatch.setattr(dc, "BLOCK_BYTES", block)
        assert sorted(map(tuple, dc.matches(spark, frame, bench).collect()), key=str) == want


def test_empty_tables(spark):
    docs, items = data()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dc.matches(spark, frame.limit(0), bench).collect() == []
    assert dc.matches(spark, frame, bench.limit(0)).collect() == []
    assert dc.decontaminate(spark, frame, bench.limit(0)).count() == len(docs)
