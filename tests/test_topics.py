"""Labels in one pass over the texts, against a plain version; texts are read twice, not once for each step."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import clustering, keywords, topics

TEXTS = [f"{a} {b} {c} {a} {b}" for a in ("river", "river bank", "steel") for b in ("bridge", "water", "tower") for c in ("north", "south", "a")] + ["", None, "alone here"]


def plain(rows, assigned, words=3):
    """``rows`` of id and text; ``assigned`` of id and topic."""
    grams = []
    for _, text in rows:
        own = [w for w in (text or "").lower().split() if len(w) >= 4]
        grams.append(Counter(own + [f"{x} {y}" for x, y in zip(own, own[1:])]))
    df = Counter(w for g in grams for w in g)
    tf = defaultdict(Counter)
    for (i, _), g in zip(rows, grams):
        for j, t in assigned:
            if i is not None and i == j and t >= 0:
                tf[t] += Counter({w: n for w, n in g.items() if df[w] >= 2})
    tf = {t: c for t, c in tf.items() if c}
    total, mean = sum(tf.values(), Counter()), sum(sum(c.values()) for c in tf.values()) / len(tf)
    out = {}
    for t, c in tf.items():
        best = sorted(((-round(n * math.log(1 + mean / total[w]), 6), w) for w, n in c.items()))[: topics.CANDIDATES]
        score = np.array([-s for s, _ in best])
        out[t] = " | ".join(best[k][1] for k in keywords.diverse(np.array([clustering.character_vector(w) for _, w in best]), score / score.max(), words, 0.3))
    return out


@pytest.mark.parametrize("slice_bytes, most", [(8 << 20, 1 << 21), (40, 8)])
def test_labels_equal_the_plain_ones(spark, monkeypatch, slice_bytes, most):
    monkeypatch.setattr(keywords, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(keywords, "MOST_COUNTS", most)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "river tower again"), (3, "steel again"), (None, "steel tower nowhere")]
    assigned = [(i, i % 4 - 1) for i in range(len(TEXTS))] + [(3, 1), (3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = topics.labels(docs, spark.createDataFrame(assigned, "doc_id long, topic int")).collect()
    assert {r.topic: r.label for r in found} == plain(rows, assigned)


def test_no_labels_without_topics(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert topics.labels(docs, docs.select("doc_id", F.lit(-1).alias("topic"))).collect() == []


def test_texts_are_read_once_for_the_model_and_once_for_its_labels(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    got = topics.model(docs.mapInArrow(count, docs.schema), topics=3).collect()
    assert len(got) == len(TEXTS) and seen.value == 2 * len(TEXTS)
