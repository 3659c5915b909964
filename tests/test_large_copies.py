"""What larger tables have and the smallest don't: minutes that end in a half, and more suppliers than any constant."""

from datetime import datetime

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from lorespark.operators import blocks, keywords, projection, topics
from lorespark.plans import load

REGISTRY = load()


def both(spark, folder, name):
    """Rows of a query and of its SQL over the tables in a folder."""
    found = REGISTRY.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    want = con.sql(REGISTRY.ORACLE_SQL[name])
    return sorted(map(tuple, found.select(want.columns).collect())), sorted(want.fetchall())


@pytest.mark.parametrize("name", ["grants_active", "grants_streamed"])
def test_half_minutes_go_to_the_even_number(spark, tmp_path, name):
    values = [0.5, 1.5, 2.5, 3.5, 30.5, 31.5, 2.49, 2.51, 0.0, None]
    rows = [(k, datetime(2024, 1, 19, 23, 58 if (v or 0) < 30 else 30), 1, "signup", v, "") for k, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, tmp_path, name)
    assert got == want and [r[0] for r in want] == [1, 2, 3, 4, 5, 6, 7]


@pytest.mark.parametrize("name", ["grants_active", "grants_streamed"])
def test_each_signup_is_a_grant_though_ids_repeat(spark, tmp_path, name):
    at = datetime(2024, 1, 19, 23, 30)
    rows = [(1, at, 1, "signup", 40.0, ""), (1, at, 2, "signup", 40.0, ""), (1, at, 1, "signup", 10.0, ""), (1, at, 1, "signup", 50.0, ""), (None, at, 1, "signup", 60.0, ""), (2, at, 1, "view", 60.0, "")]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    found = [REGISTRY.QUERIES[name](spark, str(tmp_path)).collect(), duckdb.sql(REGISTRY.ORACLE_SQL[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()]
    got, want = (sorted(map(tuple, rows), key=str) for rows in found)
    assert got == want and [r[0] for r in want] == [1, 1, 1, None]


@pytest.mark.parametrize("name", ["grants_active", "grants_streamed"])
def test_a_change_of_clocks_moves_no_end(spark, tmp_path, name):
    """Times have no zone, whatever the session's: grants from summer time that end in winter, one from an hour that comes twice."""
    starts = [datetime(2023, 11, 4, 12, 0, 0, 123457), datetime(2023, 11, 5, 1, 30), datetime(2024, 1, 19, 23, 59, 59, 999999)]
    frame = spark.createDataFrame([(k, ts, 1, "signup", 115_200.0, "") for k, ts in enumerate(starts)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got, want = both(spark, tmp_path, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == want and len(want) == 3


def test_many_suppliers_are_no_parts(spark, tmp_path):
    frame = spark.createDataFrame([(10001, 1), (10002, 2), (3, 2), (1, 5)], "l_suppkey long, l_partkey long")
    frame.write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = both(spark, tmp_path, "edges_of_clusters")
    assert got == want and len(want) > 0


def test_rare_words_are_ranked_by_their_weights(spark, tmp_path, monkeypatch):
    """More words than are broadcast, and slices of few texts: the rows of the SQL."""
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(keywords, "MOST_WORDS", 200)
    monkeypatch.setattr(keywords, "SLICE_BYTES", 5000)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for name in ("keyword_tfidf_topn", "keyword_tf", "common_pairs", "ctfidf_by_source"):
        want = con.sql(REGISTRY.ORACLE_SQL[name])
        got = REGISTRY.QUERIES[name](spark, folder).select(want.columns)
        plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
        assert plain(got.collect()) == plain(want.fetchall())


def test_slices_are_bounded_by_their_text(monkeypatch):
    monkeypatch.setattr(keywords, "SLICE_BYTES", 10)
    batch = pa.record_batch({"body": ["abcd", "efgh", "ijkl", "", "m" * 50, "n", "o"]})
    parts = list(keywords._slices([batch]))
    assert [p.num_rows for p in parts] == [2, 2, 1, 2] and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


def test_only_known_terms_are_shuffled_and_a_size_is_taken_once(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = pa.array(["nobody has this", *sorted(r.word for r in keywords.document_counts(docs, grams=2).orderBy("df", "word").limit(50).collect())])
    want = keywords.mentions(docs, grams=2).where(keywords.F.col("word").isin(known.to_pylist()))
    assert sorted(map(tuple, keywords.mentions(docs, grams=2, among=known).collect())) == sorted(map(tuple, want.collect())) != []
    plans = []
    kept = projection.saved
    monkeypatch.setattr(projection, "saved", lambda s, frame: plans.append(frame._jdf.queryExecution().optimizedPlan().toString()) or kept(s, frame))
    projection.weighted(spark, docs)
    # the size is the argument of a lambda; inside one it would be taken for each term
    assert "sqrt(" in plans[-1].lower() and "/ sqrt(" not in plans[-1].lower()


def test_blocks_of_a_batch_are_given_in_slices(spark, monkeypatch):
    held = []
    monkeypatch.setattr(type(spark.range(0)), "mapInPandas", lambda self, run, schema: held.append(run) or self)
    monkeypatch.setattr(blocks, "SLICE_CHARACTERS", 100)
    blocks.html_blocks(spark.createDataFrame([("a", "x")], "article_id string, html string"))
    batch = pd.DataFrame([(str(k), "<p>" + "w" * 40 + "</p>" * 2) for k in range(9)], columns=["article_id", "body"])
    frames = list(held[0](iter([batch])))
    assert max(map(len, frames)) == 2 and [a for f in frames for a in f["article_id"]] == list(batch["article_id"])


def test_topics_take_no_dense_vectors(spark, monkeypatch):
    def dense(*_):
        raise AssertionError("a number for each feature, whatever the text")

    monkeypatch.setattr("pyspark.ml.functions.vector_to_array", dense)
    docs = spark.createDataFrame([(k, ["apple pears fruits", "engine wheels motors", "violin piano concert"][k % 3]) for k in range(9)], "doc_id long, text string")
    got = {r.doc_id: r for r in topics.model(docs, topics=3).collect()}
    assert len(got) == 9 and all(got[k].similarity == 1.0 and got[k].topic == got[k % 3].topic for k in range(9))
