"""One pass for many patterns, against patterns that are tried one by one."""

import fnmatch
import random

import pytest

from lorespark.operators import acl, automata, notes
from lorespark.operators.automata import Globs, contained, literals


def texts(rng):
    rows = [(i, "".join(rng.choice("ab é_.9A ") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    return [*rows, (60, None), (60, "a b"), (None, "ab ab"), (61, "")]


def brute(rows, patterns, whole):
    inside = lambda c: c.isalnum() or c == "_"
    out = []
    for key, t in rows:
        for p in set(patterns) - {None, ""}:
            n = 0
            for i in range(len(t or "") - len(p) + 1):
                free = not (i and inside(t[i - 1])) and not (i + len(p) < len(t) and inside(t[i + len(p)]))
                n += t[i : i + len(p)] == p and (free or not whole)
            if n:
                out.append((key, p, n))
    return sorted(out, key=str)


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("most", [automata.MOST_BYTES, 10])
def test_patterns_in_texts(spark, whole, most, monkeypatch):
    """Broadcast, and joined by runs of characters."""
    monkeypatch.setattr(automata, "MOST_BYTES", most)
    rng = random.Random(1)
    rows = texts(rng)
    patterns = ["a", "ab", "é", "b é_", "a b", "not there", "ab", None, "", "9A 9A 9A 9"] + [rows[k][1][3:15] for k in range(10)]
    frame = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, pattern string").repartition(3)
    found = contained(spark, frame, spark.createDataFrame([(p,) for p in patterns], "pattern string"), whole)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, patterns, whole)
    assert contained(spark, frame.limit(0), spark.createDataFrame([("a",)], "pattern string")).collect() == []
    assert contained(spark, frame, spark.createDataFrame([], "pattern string")).collect() == []


def test_people_by_name_and_free_part(spark):
    people = spark.createDataFrame([("Ann Lee", False), ("Lee", False), ("Группа X", True), ("Bo Z", False)], "name string, is_group boolean")
    docs = spark.createDataFrame([(1, "ANN LEE met Lee, not Annabel."), (2, "leeway; x z"), (3, "группа x and bo"), (4, None)], "doc_id long, text string")
    found = notes.people_in(spark, docs, notes.aliases(people))
    assert sorted(map(tuple, found.collect())) == [(1, "Ann Lee", "ann", 1), (1, "Ann Lee", "ann lee", 1), (1, "Lee", "lee", 2), (3, "Bo Z", "bo", 1), (3, "Группа X", "группа x", 1)]


def test_plain_runs_of_globs():
    cases = {"a*b?cd": ["a", "b", "cd"], "[a-c]x[!y]": ["x"], "[]]q[!]]": ["q"], "a[b": ["a[b"], "**/*": ["/"], "?*[x]": [], "": []}
    assert {g: literals(g) for g in cases} == cases


def test_globs_are_those_of_fnmatch():
    rng = random.Random(2)
    globs = sorted({"".join(rng.choice(["a", "b", "/", "*", "?", "[ab]", "[!a]", "[", "]", ".", "c"]) for _ in range(rng.randint(0, 7))) for _ in range(3000)})
    paths = ["".join(rng.choice("ab/c.[]") for _ in range(rng.randint(0, 9))) for _ in range(150)]
    own = Globs(globs)
    for p in paths:
        assert own.fits(p) == [k for k, g in enumerate(globs) if fnmatch.fnmatchcase(p, g)]


def test_a_hundred_thousand_rules_in_one_pass(spark):
    """Each path is in one folder's rule and in those of all; the other rules are never tried on it."""
    globs = [f"team{k}/*.md" for k in range(100_000)] + ["**/*", "*"]
    rules = spark.createDataFrame([(k, g) for k, g in enumerate(globs)], "rule_id long, pattern string")
    paths = spark.createDataFrame([(f"Team{k}\\note{k}.MD",) for k in range(0, 100_000, 500)] + [("team7.md",)], "path string")
    found = acl.matched(paths, rules).collect()
    got = {}
    for r in found:
        got.setdefault(r.path, set()).add(r.pattern)
    assert got.pop("team7.md") == {"*"}
    assert got == {f"Team{k}\\note{k}.MD": {f"team{k}/*.md", "**/*", "*"} for k in range(0, 100_000, 500)}
