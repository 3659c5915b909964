import random

import xxhash

from lorespark.llm import simhash


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, named=False):
    prints = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 4 and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    if named:  # the id of each component
        ids = [[rows[j][0] for j in range(len(rows)) if label[j] == k and rows[j][0] is not None] for k in set(label)]
        return sorted((min(x, default=None) for x in ids), key=str)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc, f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def texts(rng):
    base = [" ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.randint(1, 300))) for _ in range(40)]
    near = []
    for t in base[:20]:
        w = t.split()
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            near.append("\t".join(v).upper())
    return base + near + base[:5] + ["", None, "  \n", "É É é", "long " * 3000]


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i * 7 % 211, t) for i, t in enumerate(texts(rng))] + [(None, "a b c d e"), (None, None), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_duplicates(spark, docs)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    want = brute_components(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == brute_components(rows, named=True)


def test_one_of_a_group_without_ids_stays(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "other words here"), (3, "third text"), (4, "third text")], "doc_id long, text string")
    got = simhash.keep_one(spark, docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "a b c d e f"), (0, "other words here"), (3, "third text")]
    plain = simhash.keep_one(spark, docs.where("doc_id is not null"))
    assert [tuple(r) for r in plain.collect()] == [(3, "third text")]


def test_deep_splitting_finds_the_same_links(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, 3, replace=False))) for b in base for _ in range(10)]
    fps = np.unique(np.concatenate([base, np.array(near, dtype=np.uint64)]))
    free = tuple(range(64))
    want = None
    for most in (10**9, 20_000):
        monkeypatch.setattr(simhash, "MOST_VARIANTS", most)
        found = list(simhash._collisions(fps, np.full(len(fps), 2), np.arange(len(fps)), free))
        a, b = (np.concatenate(x) for x in zip(*found))
        label = simhash.forest(np.arange(len(fps)), a, b).tolist()
        want = want or label
        assert label == want
    brute = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    i, j = np.nonzero(brute)
    assert simhash.forest(np.arange(len(fps)), i, j).tolist() == want


def test_wider_keys_find_the_same_links(spark, monkeypatch):
    assert len(simhash.key_bits(0)) == len(simhash.key_bits(10**8)) == 12 and len(simhash.key_bits(10**10)) == 21
    rows = list(enumerate(texts(random.Random(5))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "KEY_FINGERPRINTS", 1)
    monkeypatch.setattr(simhash, "MOST_SENT", 3000)
    assert len(simhash.key_bits(100)) > 12
    assert sorted(map(tuple, simhash.near_duplicates(spark, docs).collect()), key=str) == brute_components(rows)


def test_very_long_text():
    rng = random.Random(9)
    text = " ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(simhash.MOST_SHINGLES + 5000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_names_of_helper_columns_stay(spark):
    docs = spark.createDataFrame([(1, "same text", "a", 1, "b", "c"), (1, "same text", "a", 1, "b", "c"), (2, "same text", "d", 2, "e", "f"), (None, "quite another one", None, 3, None, None)], "doc_id long, text string, _fp string, _id int, _key string, _ROOT string")
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(["(1, 'same text', 'a', 1, 'b', 'c')", "(None, 'quite another one', None, 3, None, None)"])


def test_empty_table(spark):
    assert simhash.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_id_on_texts_of_different_groups(spark):
    a, b = "first words of one text", "quite other words in another text"
    docs = spark.createDataFrame([(5, a), (5, b), (3, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.keep_one(spark, docs).collect()) == [(3, b), (5, a)]
