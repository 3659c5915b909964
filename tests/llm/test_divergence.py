import random
import re
from collections import Counter

import pytest

from lorespark.llm import divergence

SCHEMA = "lang string, source string, text string, Value int"


def brute(rows, least_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, ts in own for t in set(ts))
        kept = sorted(t for t, n in seen.items() if n >= least_docs)
        groups = sorted({s for _, s, _ in own})
        counts = {s: Counter(t for _, g, ts in own if g == s for t in ts if seen[t] >= least_docs) for s in groups}
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        whole = sum(counts.values(), Counter())
        for s in groups:
            pairs = [(-sum(abs(share(counts[s], t) - share(counts[o], t)) for t in kept), o) for o in groups if o != s]
            terms = [(share(whole, t) - share(counts[s], t), t) for t in kept if counts[s][t] and share(counts[s], t) > share(whole, t)]
            by = lambda x: (x[0], x[1].encode())
            for part, found in (("pair", sorted(pairs, key=by)), ("term", sorted(terms, key=by)[:top])):
                out += [(lang, s, part, item, -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def found(spark, rows, least_docs, top, tile=divergence.TILE):
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    own = divergence.Audit(spark, docs, least_docs, tile)
    return sorted((r.lang, r.source, part, r["item"], r.value, r["rank"]) for part, f in (("pair", own.pairs()), ("term", own.top_terms(top))) for r in f.collect())


def rows(rng, sources=8):
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "é", "Z")]
    out = [(rng.choice(["en", "fr", None]), f"s{rng.randrange(sources)}", " ".join(rng.choices(words[: rng.randint(2, 24)], k=rng.randint(0, 40)))) for _ in range(120)]
    # a hot group, repeated rows, empty and null values, a language without kept terms
    return out + [("en", "s0", "ax " * 300)] * 5 + [("en", None, None), ("en", "empty", ""), ("de", "a", "einzig"), ("de", "b", "2 3"), ("de", None, None), (None, None, "ax bx 1")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    """With buckets of many counts, rounds of few terms and tiles of few sources."""
    for name, value in (("EXACT_COUNTS", 4), ("FIRST_TERMS", 2), ("GROWTH", 2)):
        monkeypatch.setattr(divergence, name, value)
    own = rows(random.Random(seed))
    assert found(spark, own, 10, 3, tile=3) == brute(own, 10, 3)


def test_all_terms_and_one_tile(spark):
    own = rows(random.Random(5))
    assert found(spark, own, 3, 50) == brute(own, 3, 50)


def test_audit_and_empty_tables(spark):
    docs = spark.createDataFrame([("en", "a", "x y", 1)] * 3 + [("en", "b", "x", 1)], SCHEMA)
    both = divergence.audit(spark, docs, least_docs=2)
    assert both.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, both.collect())) == brute([("en", "a", "x y")] * 3 + [("en", "b", "x")], 2, 50)
    assert divergence.audit(spark, docs.limit(0)).collect() == []


def test_parts_never_cut_a_term():
    import pyarrow as pa

    terms = ["a", "a", "b", "b", "b", "c"]
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"], "i": [0], "j": [k // 4], "term": [t]}) for k, t in enumerate(terms)]
    got = [[(r["j"], r["term"]) for r in part.to_pylist()] for part in divergence._runs(batches)]
    assert [x for part in got for x in part] == [(k // 4, t) for k, t in enumerate(terms)]
    assert len({x for part in got for x in set(part)}) == sum(len(set(part)) for part in got)
