"""The projection against numpy's singular value decomposition, and the topics that it gives."""

import random

import numpy as np
import pytest

from lorespark.operators import projection, topics

SCHEMA = "doc_id long, text string, topic string"
WORDS = ["apple pears fruits garden branch orchard", "engine wheels motor roads brake gearbox", "violin piano concert orchestra melody tempo"]


def docs(spark, each=12):
    rng = random.Random(3)
    rows = [(k * each + i, " ".join(rng.choice(WORDS[k].split()) for _ in range(30)), "x") for k in range(3) for i in range(each)]
    return rows + [(900, None, "x"), (901, "", "x"), (902, "singular words nobody shares", "x")]


def test_equals_the_decomposition_of_the_whole_table(spark):
    frame = spark.createDataFrame(docs(spark), SCHEMA).repartition(3)
    rows, terms = projection.weighted(spark, frame)
    a = np.zeros((rows.count(), terms.count()))
    for k, r in enumerate(rows.orderBy("doc_id").collect()):
        a[k, r.places] = r.x
    assert np.allclose((a**2).sum(1), 1)
    want = np.linalg.svd(a)[2][:3].T
    found = {r.doc_id: r.embedding for r in projection.project(spark, frame, 3).collect()}
    assert sorted(found) == list(range(36))
    ours = np.array([found[k] for k in range(36)])
    assert np.allclose(np.abs(ours), np.abs(a @ want), atol=1e-3)


def test_topics_are_found_with_outliers(spark):
    frame = spark.createDataFrame(docs(spark), SCHEMA).repartition(3)
    got = {r.doc_id: (r.topic, r.label) for r in topics.density_model(frame).collect()}
    assert all(got[k] == (-1, None) for k in (900, 901, 902)) and len(got) == 39
    kinds = [{got[k * 12 + i][0] for i in range(12)} - {-1} for k in range(3)]
    assert all(len(k) >= 1 for k in kinds) and not kinds[0] & kinds[1] and not kinds[1] & kinds[2] and not kinds[0] & kinds[2]
    assert sum(t >= 0 for t, _ in got.values()) >= 30
    assert all(set(label.replace(" | ", " ").split()) <= set(WORDS[d // 12].split()) for d, (t, label) in got.items() if t >= 0)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_texts_are_outliers(spark, n):
    frame = spark.createDataFrame([(k, "some text here with words", "s") for k in range(n)], SCHEMA).drop("topic")
    for found in (topics.density_model(frame), topics.model(frame)):
        assert sorted((r.doc_id, r.topic, r.label) for r in found.collect()) == [(k, -1, None) for k in range(n)]
