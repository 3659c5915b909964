import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from lorespark.llm import language

TABLE = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(TABLE)
    got = language.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


@pytest.fixture(scope="module")
def model():
    words = {"en": "the and of that with", "de": "der und die nicht mit", "fr": "le et que dans avec", "es": "el y que con para", "xx": "kwq zzx qqk"}
    return language.Model.fit([(" ".join(w.split()[k % 3 :] * 5), lang) for lang, w in words.items() for k in range(8)])


def test_hierarchy_and_odd_texts(spark, model):
    assert model.families == ["germanic", "romance", "xx"] and model.languages["germanic"] == ["de", "en"]
    assert model.predict("THE AND OF THE")[0] == "en" and model.predict("nicht und")[0] == "de" and model.predict("zzx kwq")[0] == "xx"
    for text in (None, "", " \n", "123 !? 45", "🔺"):
        assert model.predict(text) == ("und", 0.0)
    long = "der und die nicht mit " * 30_000
    assert model.predict(long)[0] == "de"
    rows = [(1, "the and", "en", "x"), (1, "the and", "en", "x"), (None, "le et que", None, "y"), (2, None, "fr", None), (3, "123", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language.identify(spark, docs, model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "fr"), (1, "en"), (1, "en"), (2, "und"), (3, "und")]
    kept = language.accept(spark, docs, model)
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and sorted(r.lang_pred for r in kept.collect()) == ["en", "en", "fr"]
    assert language.accept(spark, docs, model, least=2.0).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language.identify(spark, docs).collect()] == [("und", 0.0)]
    assert language.identify(spark, docs.limit(0)).collect() == []


def test_every_one_of_a_hundred_languages_is_learned(spark):
    rng = random.Random(1)
    signs = "abcdefghijklmnopqrstuvwxyzäöüßéèñçøåλπσдж"
    rows, truth = [], {}
    for k in range(100):
        own = rng.sample(signs, 6)
        words = ["".join(rng.choice(own) for _ in range(rng.randint(2, 6))) for _ in range(30)]
        for _ in range(18):
            text = " ".join(rng.choice(words) for _ in range(60)) * (400 if k == 7 else 1)
            rows.append((len(rows), text, f"l{k:03d}"))
            truth[len(rows) - 1] = f"l{k:03d}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.sample(docs).select("lang").distinct().count() == 100 and language.sample(docs).count() <= language.ALL_DOCS
    got = language.identify(spark, docs).collect()
    held = [r for r in got if r.held_out]
    assert {r.lang_pred for r in got} == set(truth.values())
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_votes_match_a_plain_version(model):
    """Family by the largest margin, then the most duels won, then the sum of margins."""
    for text in ("the and of", "der und die le", "el y que con the", "kwq und", "mit avec dans"):
        x = np.append(language.features(text), 1.0)
        family = max(range(3), key=lambda k: float(model.family_weights[k] @ x))
        own = model.languages[model.families[family]]
        duels = {pair: float(w @ x) for pair, w in zip(combinations(own, 2), model.pair_weights[model.families[family]])}
        wins = lambda lang: (sum((m >= 0) == (a == lang) for (a, b), m in duels.items() if lang in (a, b)), sum(m if a == lang else -m for (a, b), m in duels.items() if lang in (a, b)))
        assert model.predict(text)[0] == max(own, key=wins)


def test_sample_is_bounded_and_never_held_out(spark, monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 20)
    docs = spark.read.parquet(TABLE)
    found = language.sample(docs).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in found} == dict.fromkeys(["de", "en", "es", "fr"], 20)


def test_three_thousand_labels_are_bounded(spark):
    """A dirty column of labels: the languages with the most documents are learned, the rest are not."""
    rows = [(k, f"text number {'abc'[k % 3]} of many", f"dirty{k}") for k in range(3000)]
    rows += [(10_000 + k, "der und die nicht mit" if k % 2 else "the and of that with", "de" if k % 2 else "en") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.sample(docs).groupBy("lang").count().collect()
    assert len(found) <= 150 and {"de", "en"} <= {r.lang for r in found} and sum(r["count"] for r in found) <= language.ALL_DOCS
    got = {r.doc_id: r.lang_pred for r in language.identify(spark, docs).where("doc_id >= 10000").collect()}
    assert all(lang == ("de" if d % 2 else "en") for d, lang in got.items())


def test_sample_equals_a_plain_version(spark):
    """The documents that come first by the hash, with the features of their whole texts, and the machines fitted on them."""
    docs = spark.read.parquet(TABLE)
    hashed = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 1073741824) AS h").collect()}
    rows = [r for r in docs.collect() if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and language._LETTER.search(r.text)]
    want = [r for lang in sorted({r.lang for r in rows}) for r in sorted((r for r in rows if r.lang == lang), key=lambda r: (hashed[r.doc_id], r.doc_id))[: language.PER_LANGUAGE]]
    found = {r.doc_id: r for r in language.sample(docs).collect()}
    assert set(found) == {r.doc_id for r in want}
    for r in want:
        x = language.features(r.text)
        assert found[r.doc_id].places == np.flatnonzero(x).tolist() and np.allclose(found[r.doc_id].x, x[x > 0], atol=1e-6)
    model, plain = language.train(spark, docs), language.Model.fit([(r.text, r.lang) for r in want])
    assert model.families == plain.families and np.allclose(model.family_weights, plain.family_weights, atol=1e-5)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 18])
def test_features_do_not_depend_on_chunks(chunk, monkeypatch):
    text = "Über die Straße, 12 et la forêt — ça va?" * 3
    want = language.features(text)
    monkeypatch.setattr(language, "CHUNK", chunk)
    assert np.allclose(language.features(text), want)


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "the and of", "en", "a", True), (1, "the and of", "en", "a", True), (1, "le et que", "fr", "b", False), (None, "x", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, held_out boolean")
    model = language.Model.fit([("the and of that with", "en"), ("le et que dans avec", "fr")] * 3)
    got = language.identify(spark, docs, model)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and sorted(r.lang_pred for r in got.where("doc_id = 1").collect()) == ["en", "en", "fr"]
    assert language.identify(spark, docs).count() == 4


def test_unknown_alphabets_are_unsure(model):
    """Letters that nothing was learned from make no text surer; a few of them cost little."""
    for text in ("我们在这里写一些中文文本" * 5, "ж", "שלום", "ここ"):
        assert model.predict(text)[1] == 0.0
    sure = model.predict("the and of the")[1]
    assert 0.7 * sure < model.predict("the and of the ж")[1] < sure
    assert language.alphabet("Ab9 b-É").tolist() == sorted(map(ord, "abé"))
