import pytest
from pyspark.sql import functions as F

from lorespark.functions import models
from lorespark.operators import concepts, notes, retrieval


class Length:
    def __init__(self, step: int = 1):
        self.step = step

    def __call__(self, texts):
        return [[float(len(t) * self.step)] for t in texts]


def test_resolve():
    made = models.resolve(f"{__name__}.Length", step=2)
    assert made(["ab"]) == [[4.0]] and models.resolve("math.floor")(1.5) == 1
    for path, error in (("nodots", ValueError), ("math.nothing", ImportError), ("no.such.module", ImportError), ("math.pi", TypeError)):
        with pytest.raises(error):
            models.resolve(path)
    with pytest.raises(TypeError):
        models.resolve("math.floor", base=Length)


def test_bad_text_costs_only_itself(spark):
    def upper(texts):
        if "bad" in texts:
            raise RuntimeError("no answer")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "d")], "k int, t string").coalesce(1)
    got = {r.k: (r.answer, r.answer_error) for r in models.ask(rows, "t", upper).collect()}
    assert got == {1: ("A", None), 2: (None, "no answer"), 3: (None, None), 4: ("D", None)}
    short = models.ask(rows.where("k = 1"), "t", lambda texts: []).first()
    assert short.answer is None and short.answer_error == "0 values for 1 texts"
    vectors = models.embed(rows.where("k in (1, 3)"), "t", lambda texts: [[float(len(t))] for t in texts])
    assert {r.k: r.embedding for r in vectors.collect()} == {1: [1.0], 3: None}


def test_notes_made_and_set(spark):
    have = spark.createDataFrame([("2025-01-01", "---\nsleep-duration: 6:30\nmood: x\n---\nbody\n- [ ] t")], "note string, text string")
    wanted = spark.createDataFrame([("2025-01-01",), ("2025-01-02",), ("2025-01-02",)], "note string")
    both = notes.ensure_notes(have, wanted, "# {{note}}\n- [x] made")
    got = {r.note: r.text for r in notes.set_measures(both, {"sleep-quality": 7, "no-phone": True}).collect()}
    assert got["2025-01-01"] == '---\nsleep-duration: "6:30"\nsleep-quality: 7\nno-phone: true\nmood: x\n---\nbody\n- [ ] t'
    assert got["2025-01-02"] == "---\nsleep-quality: 7\nno-phone: true\n---\n# 2025-01-02\n- [x] made"
    day = lambda s: F.lit(s).cast("date")
    assert [(str(r.source_date), r.text) for r in notes.tasks_between(notes.lines(both), day("2025-01-02"), day("2025-01-09")).collect()] == [("2025-01-02", "made")]
    labels = spark.range(1).coalesce(1).select(notes.period_labels(day("2024-12-30")).alias("p")).first().p
    assert tuple(labels) == ("2024-12-30", "2025-W01", "2024-12")


def test_lists_and_people(spark):
    rows = spark.createDataFrame([("d", 1, "open", "a", ["x", "y"]), ("d", 2, "done", "b", []), ("d", 3, "open", "c", None)], "day string, pos int, status string, text string, people array<string>")
    assert notes.as_markdown(rows, ["day"], ["pos"], 2).first().markdown == "- [ ] a — x, y\n- [x] b\n… 1"
    assert notes.as_markdown(rows.where("pos = 2"), ["day"], ["pos"]).first().markdown == "- [x] b"
    assert [r.people for r in notes.change_people(rows, ["z", "x"], ["y"]).orderBy("pos").collect()] == [["x", "z"], ["z", "x"], ["z", "x"]]
    assert notes.vault_means(spark.createDataFrame([], "sleep_minutes int, energy double"), spark.createDataFrame([], "week_mark int")).first() == (0.0, 0.0, 0.0)


def test_concept_texts(spark):
    rows = spark.createDataFrame([("c", "b", "two"), ("c", "a", "one"), ("c", "d", " "), ("c", "e", None), ("c", "f", "one"), ("e", "g", None)], "concept_id string, word string, description string")
    assert {r.concept_id: r.description for r in concepts.described(rows).collect()} == {"c": "one; two", "e": ""}
    texts = spark.createDataFrame([("g", 1, "x" * 5), ("g", 2, "x" * 5), ("g", 3, "x" * 40), ("g", 4, None), ("h", 1, "y")], "k string, n int, text string")
    assert sorted((r.k, r.n, r.batch) for r in concepts.prompt_batches(texts, ["k"], ["n"], 10, 1.0, 1.2).collect()) == [("g", 1, 0), ("g", 2, 0), ("g", 3, 1), ("g", 4, 2), ("h", 1, 0)]
    asked = spark.createDataFrame([("1. What is this?\n- Why so long\n\nno\n3) Another one\n4. A fourth",), (None,)], "a string").coalesce(1)
    assert [r[0] for r in asked.select(retrieval.variants(F.col("a"))).collect()] == [["What is this?", "Why so long", "Another one"], []]
    made = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "concept_id string, embedding array<double>")
    between = spark.createDataFrame([("a", "b", "with", [3.0])], "source_id string, target_id string, predicate string, embedding array<double>")
    assert sorted(r.node_id for r in concepts.vector_points(made, between).collect()) == ["a", "a:b:with", "b"]
    kept, left = concepts.delete_concepts(made, between, made.where("concept_id = 'b'"))
    assert [r.concept_id for r in kept.collect()] == ["a"] and left.isEmpty()
