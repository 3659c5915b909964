"""Trees of pages: fits side by side, cuts and whole trees within a task, leaves that are made once."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.functions import vectors
from lorespark.operators import clustering


def plain_fit(x, k, rounds=100, ridge=1e-6):
    """One mixture by inverses and determinants."""
    n, d = x.shape
    resp = np.eye(k)[clustering._settled(x, x[clustering._spread(x, k, np.random.default_rng(42))])]
    last = -np.inf
    for _ in range(rounds):
        weight = resp.sum(0) + 10 * np.finfo(float).eps
        log = np.empty((n, k))
        for c in range(k):
            apart = x - resp[:, c] @ x / weight[c]
            cov = (resp[:, c, None] * apart).T @ apart / weight[c] + ridge * np.eye(d)
            log[:, c] = np.log(weight[c] / n) - 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + np.einsum("ni,ij,nj->n", apart, np.linalg.inv(cov), apart))
        total = np.logaddexp.reduce(log, axis=1)
        resp = np.exp(log - total[:, None])
        before, last = last, total.mean()
        if abs(last - before) < 1e-3:
            break
    return resp.argmax(1), -2 * n * last + (k * d * (d + 1) / 2 + k * d + k - 1) * np.log(n)


@pytest.mark.parametrize("n, d", [(5, 1), (24, 2), (12, 16), (40, 16), (70, 5), (90, 40)])
def test_mixtures_equal_the_plain_one(n, d):
    rng = np.random.default_rng(n + d)
    x = np.vstack([rng.normal(size=(n - n // 3, d)), np.repeat(rng.normal(size=(1, d)), n // 3, axis=0)])
    sizes = [2, 3, n // 2, n // 2 + 1]
    found = clustering._fits(x, sizes, clustering._spread(x, max(sizes), np.random.default_rng(42)))
    for (labels, criterion), k in zip(found, sizes):
        want, least = plain_fit(x, k)
        assert labels.tolist() == want.tolist() and criterion == pytest.approx(least, rel=1e-6, abs=1e-3)


def pages(spark, sizes, distinct):
    rng = np.random.default_rng(3)
    kinds = {a: rng.normal(size=(distinct[a], 4)).tolist() for a in sizes}
    # all but the last ones of an article are alike
    rows = [(a, f"{a}{k:05d}", f"Text {k} of {a}. More.", kinds[a][max(0, k - n + distinct[a])]) for a, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "article_id string, node_id string, text string, embedding array<double>")


embed = partial(clustering.character_vector, dimensions=4)


def test_a_tree_is_the_same_in_one_task_and_level_by_level(spark):
    frame = pages(spark, {"a": 300, "b": 120, "c": 9, "d": 260}, {"a": 3, "b": 120, "c": 9, "d": 260})
    whole = clustering.summary_tree(frame, embed, most=20).collect()
    for held in (20, 100, 150):
        assert sorted(map(str, clustering.summary_tree(frame, embed, most=20, held=held).collect())) == sorted(map(str, whole))


def test_few_vectors_take_few_passes(spark, monkeypatch):
    """Nodes that are nearly all alike were cut in dozens of passes, one after another."""
    made = []
    saved = clustering.saved
    monkeypatch.setattr(clustering, "saved", lambda *a: made.append(1) or saved(*a))
    found = clustering.parted(spark, pages(spark, {"a": 500}, {"a": 2}), 20)
    assert found.count() == 500 and found.groupBy("part").count().agg(F.max("count")).first()[0] <= 20
    assert len(made) <= 3


def test_leaves_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = pages(spark, {"a": 300, "b": 9}, {"a": 300, "b": 9})
    clustering.summary_tree(frame.mapInArrow(count, frame.schema), embed, most=40).collect()
    assert seen.value == 309


def test_counted_characters_equal_the_expression(spark):
    texts = ["", "a", "Straße 😀😀 İΣς", "\n\t\n", "x" * 5000, "日本語 text", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = frame.select("text", vectors.counted_characters(F.col("text")).alias("a"), vectors.character_embedding(F.col("text")).alias("b")).collect()
    assert all(r.a == (None if r.text is None else r.b) for r in rows) and len(rows) == len(texts)
