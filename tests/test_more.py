"""Operators that call models, databases and mixtures, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import clustering, concepts, keywords, topics
from lorespark.sources import readers


def test_full_covariances_tell_crossed_clusters_apart():
    """Two long clusters that cross at right angles have one mean; only their covariances differ."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(150, 2)) * [6.0, 0.2]
    b = rng.normal(size=(150, 2)) * [0.2, 6.0]
    labels, two = clustering.fit_mixture(np.vstack([a, b]), 2)
    far = np.concatenate([np.abs(a[:, 0]) > 1, np.abs(b[:, 1]) > 1])
    truth = np.repeat([0, 1], 150)
    agree = (labels == truth)[far].mean()
    assert max(agree, 1 - agree) > 0.98
    assert two < clustering.fit_mixture(np.vstack([a, b]), 1)[1]


def test_mixture_criterion_matches_its_definition():
    x = np.random.default_rng(1).normal(size=(80, 3)) @ np.array([[2.0, 0, 0], [1, 1, 0], [0, 0.5, 0.3]])
    _, found = clustering.fit_mixture(x, 1)
    cov = np.cov(x.T, bias=True) + 1e-6 * np.eye(3)
    apart = x - x.mean(0)
    log = -0.5 * (3 * np.log(2 * np.pi) + np.log(np.linalg.det(cov)) + np.einsum("ni,ij,nj->n", apart, np.linalg.inv(cov), apart))
    assert found == pytest.approx(-2 * log.sum() + 9 * np.log(80))


def joined(texts, budget):
    return "+".join(t[:3] for t in texts)


def test_summaries_go_by_stages():
    assert clustering.token_aware(["aaa", "bbb"], joined, 100) == "aaa+bbb"
    long = [f"{i:03d}" + "x" * 97 for i in range(12)]
    asked = []

    def watched(texts, budget):
        assert len("\n---\n".join(texts)) <= budget or len(texts) == 1
        asked.append(len(texts))
        return joined(texts, budget)

    # 250 characters hold two texts: six groups, whose summaries fit together
    assert clustering.token_aware(long, watched, 100) == "000+002+004+006+008+010" and asked == [2] * 6 + [6]
    assert clustering.token_aware(long, watched, 100, overflow="levels_only") is None
    assert clustering.token_aware(["y" * 1000], lambda t, b: t[0][:10], 100) == "y" * 10
    assert clustering.token_aware([], watched) == ""
    assert len(clustering.token_aware(long, lambda t, b: "\n".join(t), 100)) <= 250


def test_levels_only_drops_the_leaves(spark):
    assert clustering.article_summary(["up one"], ["z" * 400], joined, 100, overflow="levels_only") == "up "
    assert clustering.article_summary(["up one"], ["leaf"], joined, 100, overflow="levels_only") == "up +lea"
    assert clustering.article_summary([], ["z" * 400], joined, 100, overflow="levels_only") == ""
    rows = [("a", "a0", 0, "held", ["x"]), ("a", "a1", 0, "orphan", []), ("a", "s", 1, "summary", ["a0"]), ("b", "b0", 0, "alone", [])]
    tree = spark.createDataFrame([(a, n, level, t, [0.0], c) for a, n, level, t, c in rows], clustering.TREE)
    assert {r.article_id: r.summary for r in clustering.summarise_articles(tree, lambda texts, _: "+".join(t[:3] for t in texts)).collect()} == {"a": "sum+orp", "b": "alo"}


def test_refinement_in_two_passes(spark):
    calls = spark.sparkContext.accumulator(0)
    sizes = spark.sparkContext.accumulator(0)

    def model(batch):
        calls.add(1)
        sizes.add(len(batch))
        assert len(batch) <= 100
        if any(w == "bad" for w, _ in batch):
            raise ValueError("no answer")
        # the first pass takes a last letter off, the second one more
        return [(w, w[:-1] if len(w) > 4 else w, c) for w, c in batch]

    rows = [("a", f"w{k:03d}{s}", "x", 10 * k + i) for k in range(120) for i, s in enumerate(("s", "z"))] + [("b", "words", None, 1), ("b", "Words", "y", 2), ("c", "bad", "x", 1), ("c", " ", "x", 2)]
    got = {(r.article, r.raw): (r.word, r.category) for r in keywords.refine_batches(spark.createDataFrame(rows, "article string, word string, category string, pos long"), "article", model).collect()}
    assert len(got) == 241
    assert got["a", "w007s"] == got["a", "w007z"] == ("w007", "x") and got["b", "words"] == ("word", "other") and not any(a == "c" for a, _ in got)


def test_tables_over_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"n{i}", i / 2) for i in range(50)], "id int, name string, amount double")
    for part in (rows.where("id < 20"), rows.where("id >= 20")):
        readers.write_table(part.coalesce(1), url, "expenses", createTableColumnTypes="name VARCHAR(20)")
    found = readers.read_table(spark, url, "expenses", ("id", 0, 50, 3))
    assert found.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, found.collect())) == [(i, f"n{i}", i / 2) for i in range(50)]


def test_samples_and_resets(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else "t") for i in range(400)], "id long, text string")
    some = keywords.sampled(rows, 0.3, ["text"])
    assert 50 < some.count() < 130 and some.where("text is null").isEmpty()
    assert sorted(r.id for r in some.collect()) == sorted(r.id for r in keywords.sampled(rows, 0.3, ["text"]).collect())
    assert [f.count() for f in concepts.reset(rows, some)] == [0, 0] and concepts.reset(rows)[0].columns == rows.columns


def test_concepts_from_unmatched_words(spark):
    rows = [("Alpha", "a1", "g", "v1", 1, [1.0, 0.0]), ("alpha", "a1", "g", "v1", 2, [1.0, 0.0]), ("beta", "a2", "h", "v1", 3, [0.9, 0.1]), ("gamma", "a1", "g", "v1", 4, [0.0, 1.0])]
    found = concepts.from_unmatched(spark.createDataFrame(rows, "word string, article_id string, category string, version string, pos long, embedding array<double>"), 0.8)
    assert sorted((r.canonical_name, r.keyword_words, r.source_articles) for r in found.collect()) == [("Alpha", ["Alpha", "beta"], ["a1", "a2"]), ("gamma", ["gamma"], ["a1"])]
    state = spark.createDataFrame([("g", 1, True, ["w"], ["a"])], "concept_group_id string, version int, is_active boolean, keyword_words array<string>, source_articles array<string>")
    with pytest.raises(ValueError):
        concepts.add_concept(state, "n", spark.createDataFrame([("none",)], "word string"), spark.createDataFrame([("w", "a")], "word string, article_id string"))
    assert concepts.add_concept(state, "n", spark.createDataFrame([("w",), ("none",)], "word string"), spark.createDataFrame([("w", "a"), ("w", "b")], "word string, article_id string")).where(F.col("concept_group_id") == "n").first().source_articles == ["a", "b"]


def test_labels_are_diverse(spark):
    assert keywords.diverse(np.array([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0]]), np.array([1.0, 0.95, 0.6]), 2, 0.3) == [0, 2]
    assert keywords.diverse(np.array([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0]]), np.array([1.0, 0.95, 0.6]), 2, 0.0) == [0, 1]
    texts = ["green apple pie", "green apple tart", "green apple juice once", "steel bridge span", "steel bridge tower", "steel bridge cable twice"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assigned = spark.createDataFrame([(i, i // 3) for i in range(6)], "doc_id long, topic int")
    found = {r.topic: r.label.split(" | ") for r in topics.labels(docs, assigned).collect()}
    # only what two documents share may label a topic
    assert {w for x in found[0] for w in x.split()} == {"green", "apple"} and {w for x in found[1] for w in x.split()} == {"steel", "bridge"}
    assert len(found[0]) == 3 and any(" " in x for x in found[0])


def test_few_points_are_fitted_in_their_own_space():
    """Fewer points than places: the criterion is that of the whole space, and no pass takes more than its share of numbers."""
    x = np.random.default_rng(5).normal(size=(6, 9))
    _, found = clustering.fit_mixture(x, 1, rounds=3)
    cov = np.cov(x.T, bias=True) + 1e-6 * np.eye(9)
    apart = x - x.mean(0)
    log = -0.5 * (9 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + np.einsum("ni,ij,nj->n", apart, np.linalg.inv(cov), apart))
    assert found == pytest.approx(-2 * log.sum() + 54 * np.log(6))


def test_mixtures_are_dealt_to_all_cores(spark):
    rows = [(f"a{i % 40}", f"n{i:04d}", f"Text {i}.", [float(i % 7), float(i % 3)]) for i in range(160)]
    tree = clustering.summary_tree(spark.createDataFrame(rows, "article_id string, node_id string, text string, embedding array<double>"), lambda t: clustering.character_vector(t, 2))
    assert len({r.p for r in tree.where("level = 0").select(F.spark_partition_id().alias("p")).distinct().collect()}) >= 8
