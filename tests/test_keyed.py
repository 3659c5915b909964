"""Tables by key: upserts rewrite only the buckets they touch, and versions are seen whole."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorespark.sources.keyed import Conflict, KeyedTable


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_an_upsert_of_one_percent_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(0, 3000).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"), F.array("id").alias("_bucket"))
    table = KeyedTable.create(spark, path, rows, ["k"], 32)
    before, head = files(path), table.head()
    delta = rows.where("k < 8 or k = 2999").unionByName(spark.createDataFrame([(9000, "new", None)], "k long, name string, _bucket array<long>")).withColumn("name", F.concat(F.lit("x"), "name"))
    n = table.upsert(delta)
    after, now = files(path), table.head()
    assert 1 <= n <= 10 and before.items() <= after.items()
    assert sum(head["folders"].get(b) != f for b, f in now["folders"].items()) == n and len(now["folders"]) == 32
    assert len(set(after) - set(before)) == n
    got = {r.k: r.name for r in table.read().collect()}
    assert len(got) == 3001 and got[0] == "xn0" and got[9000] == "xnew" and got[100] == "n100"
    assert table.read(0).count() == 3000 and table.read(0).where("k = 9000").isEmpty()
    # two versions on, files that no version needs go
    assert table.delete(spark.createDataFrame([(0,), (77_777,)], "k long")) <= 2
    assert table.read().count() == 3000 and {r.name for r in table.read_keys(spark.createDataFrame([(1,), (0,)], "k long")).collect()} == {"xn1"}
    assert table.vacuum() >= n and table.versions() == [2] and table.read().count() == 3000
    assert len(files(path)) == len(table.head()["folders"])


def test_joins_conflicts_and_bad_keys(spark, tmp_path):
    rows = spark.range(0, 50).select(F.col("id").alias("a"), (F.col("id") % 3).alias("b"), F.lit(1).alias("x"))
    one = KeyedTable.create(spark, str(tmp_path / "one"), rows, ["a", "b"], 8)
    two = KeyedTable.create(spark, str(tmp_path / "two"), rows.where("a < 20").withColumnRenamed("x", "y"), ["a", "b"], 8)
    assert one.joined(two).count() == 20 and one.joined(two, "left").where("y is null").count() == 30
    with pytest.raises(FileExistsError):
        KeyedTable.create(spark, str(tmp_path / "one"), rows, ["a"])
    with pytest.raises(ValueError, match="once"):
        one.upsert(rows.unionByName(rows.limit(1)))
    with pytest.raises(ValueError, match="not null"):
        one.upsert(rows.limit(1).withColumn("a", F.lit(None).cast("long")))
    with pytest.raises(Conflict):
        one._put(0, one.head())
    assert one.upsert(rows.limit(0)) == 0 and one.versions() == [0]
    empty = KeyedTable.create(spark, str(tmp_path / "none"), rows.limit(0), ["a", "b"], 8)
    assert empty.read().count() == 0 and empty.upsert(rows) == 8 and empty.read().count() == 50
