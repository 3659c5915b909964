"""Candidates that a model decides on, and descriptions that it renews, with a model that fails at times."""

import json

import pytest

from lorespark.operators import concepts


def verifier(fails):
    """Yes with a confidence for words of letters before m; one word breaks any batch it is in."""

    def ask(prompts):
        out = []
        for p in prompts:
            word = p.split("\nWord ")[1].split(":")[0]
            if word in fails:
                raise RuntimeError(f"no answer about {word}")
            out.append({"plain": "no json here", "odd": '{"belongs": "perhaps"}'}.get(word) or f"<think>x</think>```json\n{json.dumps({'belongs': word < 'm', 'confidence': 0.9 if word < 'c' else 0.4, 'relationship': f'near {word}'})}\n```")
        return out

    return ask


@pytest.mark.parametrize("batch", [1, 3, 50])
def test_failed_batches_are_rows_with_their_message(spark, batch):
    words = ["a", "b", "bad", "d", "z", "plain", "odd", None]
    rows = [(w, "text", "Name", None, "about", "old") for w in words]
    frame = spark.createDataFrame(rows, "word string, description string, canonical_name string, domain string, about string, error string").coalesce(1)
    got = {r.word: (r.belongs, r.confidence, r.relationship, r.error) for r in concepts.verified(frame, verifier({"bad"}), batch).collect()}
    assert got["a"] == (True, 0.9, "near a", None) and got["d"] == (True, 0.4, "near d", None) and got["z"] == (False, 0.4, "near z", None)
    assert got["bad"] == (False, 0.0, "", "no answer about bad") and got["plain"] == (False, 0.0, "", "the answer has no JSON object")
    assert got["odd"] == (False, 0.0, "", None) and len(got) == len(words)
    sure = {r.word for r in concepts.verified(frame, verifier({"bad"}), batch, least=0.5).where("belongs").collect()}
    assert {"a", "b"} <= sure and "d" not in sure


def test_expansion_asks_about_candidates_only(spark):
    words = spark.createDataFrame([(1, "a", "x", [1.0, 0.0]), (2, "b", "x", [0.8, 0.6]), (3, "n", "x", [0.7, 0.714]), (4, "far", "x", [-1.0, 0.0]), (5, "bad", "x", [0.75, 0.66])], "word_id long, word string, description string, embedding array<double>")
    known = spark.createDataFrame([("c1", "Name", "d", "about", [1.0, 0.0])], "concept_id string, canonical_name string, domain string, description string, embedding array<double>")
    got = {r.word_id: (r.kind, r.concept_id, r.error) for r in concepts.expand_verified(spark, words, known, 0.95, 0.5, verifier({"a", "far", "bad"})).collect()}
    assert got == {1: ("direct", "c1", None), 2: ("candidate", "c1", None), 3: ("candidate", None, None), 4: ("unmatched", None, None), 5: ("candidate", None, "no answer about bad")}


def test_descriptions_are_renewed_batch_by_batch(spark):
    def model(prompts):
        (p,) = prompts
        if "- stop" in p:
            raise RuntimeError("too much")
        return [p.split(": ", 1)[1].split("\n")[0] + "+" + str(p.count("\n- ") )]

    rows = [(c, c.upper(), "start", f"{'stop' if c == 'b' and k == 5 else 'w'}{k:02d}", "d" * 20) for c, n in (("a", 9), ("b", 9), ("c", 1)) for k in range(n)]
    frame = spark.createDataFrame(rows, "concept_id string, canonical_name string, about string, word string, description string").repartition(3)
    got = {r.concept_id: (r.description, r.error) for r in concepts.redescribed(frame, model, tokens=80).collect()}
    assert got["c"] == ("start+1", None) and got["a"][1] is None and got["b"][1] == "too much"
    added = lambda d: [int(n) for n in d.split("+")[1:]]
    assert sum(added(got["a"][0])) == 9 and len(added(got["a"][0])) > 1 and sum(added(got["b"][0])) < 9
