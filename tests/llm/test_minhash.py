import random
import re

import numpy as np
import pytest

from lorespark.llm import minhash, words
from lorespark.llm.minhash import Vocabulary

SCHEMA = "doc_id long, text string, Digest string, node int"


def brute_set(text):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(own[i : i + 3]) for i in range(max(1, len(own) - 2))} if own else set()


def brute(rows, percent=85):
    sets = [brute_set(t) for _, t in rows]
    label, changed = list(range(len(rows))), True
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= percent * len(a | b)]
    while changed:
        changed = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    out = []
    for (doc, _), own, mark in zip(rows, sets, label):
        ids = [d for (d, _), m in zip(rows, label) if m == mark and d is not None]
        root = min(ids, default=None) if own else doc
        out.append((doc, len(own), root, doc == root))
    return sorted(out, key=str)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in minhash.near_duplicates(spark, docs).collect()), key=str)


def near_copies(rng, base, n, most):
    """Copies with up to ``most`` words changed, at random places."""
    out = []
    for _ in range(n):
        own = base.split()
        for at in rng.sample(range(len(own)), rng.randint(0, most)):
            own[at] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_equals_brute_force(spark, monkeypatch):
    """Hot groups, chains of copies of copies, false candidates, short, repeated and null rows."""
    monkeypatch.setattr(minhash, "CENTRE_TEXTS", 4)  # a centre's pairs go to several tasks
    blocks = dict(zip(("block", "block_shingles"), (3, 300)))  # buckets and groups go to several tiles
    whole = minhash._components
    monkeypatch.setattr(minhash, "_components", lambda *a: whole(*a, **blocks))
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    base, texts = text(120), []
    texts += near_copies(rng, base, 40, 5) + [base.upper(), base.replace(" ", "\n\t ")] * 10
    chain = base
    for _ in range(8):  # each is near to the next, not to the first
        chain = near_copies(rng, chain, 1, 5)[0] + " " + text(4)
        texts.append(chain)
    shared = text(60)
    texts += [f"{shared} {text(30)}" for _ in range(20)]  # alike, but not enough
    texts += [text(rng.randint(0, 200)) for _ in range(30)] + [None, "", " \t", "one", "ONE", "one two", "one two", "one two three", "a b " * 50, "a b " * 70]
    rows = [(i, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    rows += [(None, base), (None, "alone again and again"), (None, None), (7, base), (7, text(50)), (7, None)]
    got = found(spark, rows)
    assert got == brute(rows) and len({r[2] for r in got}) < len(rows) - 60


def test_keep_one_and_empty(spark):
    docs = spark.createDataFrame([(3, "a b c d", "x", 1), (2, "A b c  d", "x", 2), (5, None, "x", 3), (6, "", "x", 4), (None, "a b c d", "x", 5)], SCHEMA)
    assert sorted(r.doc_id for r in minhash.keep_one(spark, docs).collect()) == [2, 5, 6] and minhash.keep_one(spark, docs).columns == docs.columns
    assert minhash.near_duplicates(spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 50, 5000])
def test_sketches_fill_and_estimate(size):
    """Sets alone and among others have the same sketch; agreement is near to the similarity."""
    rng = np.random.default_rng(size)
    a = rng.integers(0, 2**63, size).astype(np.uint64)
    b = np.concatenate([a[: size * 9 // 10], rng.integers(0, 2**63, size - size * 9 // 10).astype(np.uint64)])
    both = minhash.sketches([a, b])
    assert (both < np.iinfo(np.uint64).max).all() and (both[0] == minhash.sketches([a])[0]).all()
    shared = len(set(a.tolist()) & set(b.tolist()))
    assert abs((both[0] == both[1]).mean() - shared / (2 * size - shared)) < 0.15


def test_bands_find_sets_at_the_threshold():
    rng, missed = np.random.default_rng(1), 0
    for _ in range(200):
        shared, own = rng.integers(0, 2**63, 850).astype(np.uint64), rng.integers(0, 2**63, 150).astype(np.uint64)
        a, b = minhash.band_keys(minhash.sketches([np.append(shared, own[:75]), np.append(shared, own[75:])]))
        missed += not (a == b).any()
    assert missed == 0


@pytest.mark.parametrize("bits", [2, 21])
def test_shingles_are_those_of_words(bits, monkeypatch):
    """However many different words there are, and in pieces of a few bytes."""
    monkeypatch.setattr(minhash, "WORD_BITS", bits)
    monkeypatch.setattr(words, "PIECE_BYTES", 5)
    rng = random.Random(bits)
    texts = [" ".join(rng.choice("ABcdé") for _ in range(n)) for n in (3, 4, 60, 200)]
    vocabulary = Vocabulary()
    numbers = [vocabulary.read(t.encode())[0] for t in texts]
    codes = minhash.distinct_shingles(*numbers)
    for i, a in enumerate(texts):
        assert len(codes[i]) == len(brute_set(a)) == len(set(minhash.shingle_hashes(numbers[i], vocabulary.array()).tolist()))
        for j, b in enumerate(texts):
            assert len(np.intersect1d(codes[i], codes[j])) == len(brute_set(a) & brute_set(b))
    other = Vocabulary()
    other.read(b"d c b a and others before")
    assert set(minhash.shingle_hashes(other.read(texts[2].encode())[0], other.array()).tolist()) == set(minhash.shingle_hashes(numbers[2], vocabulary.array()).tolist())
    assert Vocabulary().read(b"A b")[1] == Vocabulary().read(b" a\t\nB ")[1] != Vocabulary().read(b"ab")[1]
