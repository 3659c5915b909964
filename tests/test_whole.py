"""Queries over whole tables, against brute force on small fixtures."""

from collections import Counter

import numpy as np
import pytest

from lorespark.operators import clustering, finance, retrieval
from lorespark.plans import load, q_models

SF = "/root/testdata/sf0.001"
QUERIES = load().QUERIES

#: Two chains of suppliers and parts; only the last rows have the quantity and the discount of the thinned graph.
ITEMS = [(1, 1, 2.0, 0.0), (1, 2, 3.0, 0.0), (2, 2, 10.0, 0.05), (2, 3, 44.0, 0.0), (3, 3, 45.0, 0.0), (4, 9, 1.0, 0.0), (5, 9, 50.0, 0.1), (6, 10, 50.0, 0.1)]


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("items")
    spark.createDataFrame(ITEMS, "l_suppkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def _near():
    near = {}
    for s, p, *_ in ITEMS:
        near.setdefault(s, set()).add(p + 1_000_000)
        near.setdefault(p + 1_000_000, set()).add(s)
    return near


def _hops(start, most=99):
    near, hops, level = _near(), {start: 0}, [start]
    for hop in range(1, most + 1):
        level = sorted({n for x in level for n in near[x]} - set(hops))
        hops |= dict.fromkeys(level, hop)
    return hops


def test_components_of_all_items(spark, items):
    got = {r.node: r.component for r in QUERIES["connected_components"](spark, items).collect()}
    assert got == {n: min(_hops(n)) for n in _near()}


def test_hops_of_all_items(spark, items):
    got = {r.node: r.hop for r in QUERIES["bfs_depth"](spark, items).collect()}
    assert got == _hops(1, 3) and len(got) == 5


def test_counts_and_unions_of_all_items(spark, items):
    near = _near()
    assert {r.a: r.n for r in QUERIES["article_keyword_counts"](spark, items).collect()} == {a: len(b) for a, b in near.items() if a < 1_000_000}
    assert {(r.a, r.b) for r in QUERIES["relation_union_distinct"](spark, items).collect()} == {(a, b) for a, bs in near.items() for b in bs}


def test_more_accounts_than_a_task_should_hold(spark):
    names = [(i, f"account number {i:05d}") for i in range(1, 12_001)] + [(20_001, "abcx"), (20_500, "abcy")]
    accounts = spark.createDataFrame(names, "id long, name string")
    asked = ["account number 11999", " ACCOUNT number 00007", "number 10500", "abca", "cash"]
    got = {r.query: (r.account_id, r.how) for r in finance.resolve_accounts(spark.createDataFrame([(x,) for x in asked], "query string"), accounts, spark.createDataFrame([("cash", "account number 00003")], "word string, name string")).collect()}
    assert got == {asked[0]: (11_999, "exact"), asked[1]: (7, "exact"), asked[2]: (10_500, "part"), asked[3]: (20_001, "similar"), asked[4]: (3, "synonym")}


def test_every_customer_is_asked(spark):
    assert QUERIES["account_cascade"](spark, SF).count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def _points(spark, n, size=8, seed=1):
    vectors = np.random.default_rng(seed).normal(size=(n, size))
    return vectors, spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")


def _cosines(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.round(unit @ unit.T, 6)


def test_more_queries_than_a_block(spark, monkeypatch):
    vectors, points = _points(spark, 60)
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 4)
    scores = _cosines(vectors)
    got = {(r.query_id, r.rank): r.vec_id for r in retrieval.knn(spark, points, points.where("vec_id % 5 = 0"), 3).collect()}
    want = {q: sorted((i for i in range(60) if i != q), key=lambda i: (-scores[q, i], i))[:3] for q in range(0, 60, 5)}
    assert got == {(q, k + 1): i for q, found in want.items() for k, i in enumerate(found)}


def test_every_fiftieth_row_is_asked(spark):
    found = QUERIES["knn_topk"](spark, SF)
    assert sorted(r.query_id for r in found.select("query_id").distinct().collect()) == list(range(0, 500, 50))


def test_first_pairs_without_a_floor(spark, tmp_path):
    eye = np.eye(8)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(eye)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = [(a, b, 0.0) for a in range(8) for b in range(a + 1, 8)][:10]
    for name in ("allpairs_similarity_top10", "near_threshold_pairs"):
        assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()] == want


def test_statistics_of_all_pairs_over_blocks(spark):
    vectors, points = _points(spark, 90)
    a, b = np.triu_indices(90, 1)
    scores = _cosines(vectors)[a, b]
    got = retrieval.counted_distribution(retrieval.score_counts(points, block=25)).first()
    want = [np.percentile(scores, p) for p in (5, 25, 50, 75, 90, 95, 99)] + [scores.min(), scores.max(), scores.mean(), scores.std()]
    assert got.n == len(scores) and np.allclose(got[1:], want, atol=1.1e-6)
    for near in (None, 0.3):
        far = -scores if near is None else np.round(np.abs(scores - near), 6)
        first = np.lexsort((b, a, far))[:10]
        assert [(r.a, r.b) for r in retrieval.first_pairs(points, 10, near, block=25).collect()] == list(zip(a[first].tolist(), b[first].tolist()))


def _greedy(vectors, least):
    """Clusters as the reference makes them: the first of the most similar running means, in a loop."""
    means, members = [], []
    for i, v in enumerate(vectors):
        best, at = -1.0, -1
        for k, m in enumerate(means):
            size = np.linalg.norm(m) * np.linalg.norm(v)
            score = float(m @ v / size) if size else 0.0
            if score > best + 1e-9:
                best, at = score, k
        if at >= 0 and best >= least:
            members[at].append(i)
            means[at] = (means[at] * (len(members[at]) - 1) + v) / len(members[at])
        else:
            means.append(v.copy())
            members.append([i])
    return members


def test_greedy_clusters_cross_labels(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    vectors = np.array([r.embedding for r in rows], dtype=np.float64)
    of = {}
    for r in QUERIES["greedy_clusters"](spark, SF).collect():
        of.setdefault(r.cluster, []).append(r.vec_id)
    want = [[rows[i].vec_id for i in m] for m in _greedy(vectors, 0.3)]
    assert sorted(sorted(x) for x in of.values()) == sorted(want) and any(len({rows[i].label for i in m}) > 1 for m in _greedy(vectors, 0.3))
    for r in QUERIES["threshold_sweep"](spark, SF).collect():
        sizes = [len(m) for m in _greedy(vectors, r.threshold)]
        assert (r.clusters, r.largest, r.singles) == (len(sizes), max(sizes), sizes.count(1))


@pytest.mark.parametrize("least", [0.2, 0.5, 0.9, 0.99])
def test_greedy_blocks_place_as_one_point_after_another(monkeypatch, least):
    monkeypatch.setattr(clustering, "GREEDY_BLOCK", 7)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 6))
    vectors[[4, 90]] = 0
    vectors[100:150] = vectors[100:150].repeat(5, axis=0)[:50]  # runs of equal vectors
    vectors[200:220] = vectors[50:70]
    found = clustering._Centroids(least, 6).place(vectors)
    assert [[i for i, c in enumerate(found) if c == k] for k in range(max(found) + 1)] == _greedy(vectors, least)


def test_concepts_cross_first_letters(spark):
    first = {}
    for r in sorted(q_models._members(spark, SF).collect(), key=lambda r: r.pos):
        first.setdefault(f"{r.word.lower()}\x1f{r.article_id}", r)
    ids = sorted(first, key=lambda i: (first[i].word.lower(), i))
    found = _greedy(np.array([first[i].embedding for i in ids]), 0.85)
    want = sorted(sorted({first[ids[i]].word for i in m}) for m in found)
    assert sorted(r.keyword_words for r in QUERIES["concept_build"](spark, SF).collect()) == want
    assert any(len({w[0] for w in words}) > 1 for words in want)
    cluster = {first[ids[i]].word: k for k, m in enumerate(found) for i in m}
    docs = {}
    for r in q_models._members(spark, SF).collect():
        docs.setdefault(r.pos, set()).add(r.word)
    pairs = {(a, b) for words in docs.values() for a in words for b in words if a < b}
    between = Counter(tuple(sorted((cluster[a], cluster[b]))) for a, b in pairs if cluster[a] != cluster[b])
    assert {(r.x, r.y): r.n_edges for r in QUERIES["concept_relations"](spark, SF).collect()} == between


def test_whole_turns_are_parsed(spark, tmp_path):
    said = "a task that is longer than forty characters by far #late\n- [x] second one #more\nclosing words"
    spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", None)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.pos, r.text, r.section, r.tags) for r in QUERIES["note_sections"](spark, str(tmp_path)).orderBy("pos").collect()]
    assert got[:2] == [(1, "a task that is longer than forty characters by far", "user", "late"), (2, "second one", "user", "more")]
    assert [(p, s, t) for p, _, s, t in got[2:]] == [(5, "assistant", "t1")]


def test_every_document_has_a_topic_row(spark, tmp_path):
    texts = ["apples pears fruit", "pears fruit garden", "apples garden fruit tree", "engine wheel motor", "wheel motor road", "engine road car", "motor car", "fruit tree", "wheel car engine", "", None, "?! --"]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.topic, r.label) for r in QUERIES["topic_model"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts)))
    assert all(got[i] == (-1, None) for i in (9, 10, 11)) and all(got[i][0] >= 0 for i in range(9))
