import random
from collections import Counter

import duckdb
import pandas as pd

from lorespark.llm import quality

JUNK = "big*** sale$$$ now%%% " * 30 + "".join(f"word{i} " for i in range(200))
CLEAN = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
ROWS = [
    (1, CLEAN), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r"), (5, JUNK), (6, CLEAN.upper()), (7, "one two three " * 40),
    (8, "\n".join(["same line here"] * 20 + CLEAN.split())), (9, "É " + CLEAN), (9, "É " + CLEAN), (None, CLEAN), (10, "a\x00b " + CLEAN), (11, "!! " + CLEAN.replace(" ", "!! ")),
    (12, CLEAN + " x" * 3), (13, "\u00a0 nbsp\u00a0word " + CLEAN), (14, "1 " * 80 + CLEAN), (15, "long" * 20000 + " " + CLEAN),
]


def test_matches_sql_and_keeps_clean(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in ROWS], "doc_id long, text string, kept string")
    got = quality.judge(spark, docs)
    base = got.drop("rejected_by").toPandas()
    documents = pd.DataFrame([r for r in ROWS if r[0] not in (9, None)], columns=["doc_id", "text"])  # noqa: F841
    want = duckdb.sql(quality.SQL).df().sort_values("doc_id")
    ours = base[base.doc_id.notna() & (base.doc_id != 9)].sort_values("doc_id")
    assert ours.astype(want.dtypes.to_dict()).values.tolist() == want.values.tolist()
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert {k for k, v in kept.items() if not v} == {2, 3, 4, 5, 6, 7, 11, 14, 15}
    assert got.count() == len(ROWS)


def test_repeated_words():
    assert quality.repeated_words(b"a b c a b c".split()) == 6
    assert quality.repeated_words(b"a b c x a b c".split()) == 6
    assert quality.repeated_words(b"a a a a".split()) == 4
    assert quality.repeated_words(b"a b".split()) == 0
    rng = random.Random(2)
    for size in (3, 4, 10, 200, 5000):
        words = [b"w%d" % rng.randrange(max(2, size // 8)) for _ in range(size)]
        seen = Counter(zip(words, words[1:], words[2:]))
        want = {p for i in range(size - 2) if seen[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        assert quality.repeated_words(words) == len(want)


def test_order_is_by_rejection_per_cost(spark):
    names, stats = quality.ordered(quality.estimates([JUNK, CLEAN] * 5))
    ratios = [stats[n]["selectivity"] / stats[n]["cost"] for n in names]
    assert ratios == sorted(ratios, reverse=True) and set(names) == {r.name for r in quality.RULES}
    assert stats["few_letter_words"]["cost"] > stats["loud_marks"]["cost"] > stats["symbols"]["cost"]
    # the sums of tasks are those of all texts, however they are dealt
    docs = spark.createDataFrame([(d, t) for d, t in ROWS], "doc_id long, text string")
    want = quality.estimates([t for _, t in ROWS])
    assert quality._sampled(docs.repartition(4)) == want == quality._sampled(docs.repartition(1))
    assert {r.rejected_by for r in quality.judge(spark, docs.repartition(4)).collect()} == {r.rejected_by for r in quality.judge(spark, docs).collect()}


def test_empty_table(spark):
    assert quality.judge(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
