"""Files of articles written all at once or not at all, and files that can't be read set apart."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorespark.operators import blocks
from lorespark.sources import article_files, quarantine, readers


def names(path):
    return sorted(p.name for p in Path(path).rglob("*") if p.is_file() and not p.name.startswith("."))


def pages(spark):
    rows = [("a", "<h1>T</h1><p>x <a href='u'>l</a></p>"), ("b/c", "<p>é</p><img src='i.png' alt='t'>"), ("d", "<ul><li>one</li></ul>")]
    return blocks.html_blocks(spark.createDataFrame(rows, "article_id string, html string"))


def test_articles_are_written_and_read_back(spark, tmp_path):
    found = pages(spark)
    article_files.write_articles(spark, found, str(tmp_path), "20250102_030405")
    article_files.write_articles(spark, found.where("article_id = 'a'"), str(tmp_path), "20250203_040506")
    assert names(tmp_path) == ["a_20250102_030405.yaml", "a_20250203_040506.yaml", "b_c_20250102_030405.yaml", "d_20250102_030405.yaml"]
    read = {(r.article, r.version): json.loads(r.json) for r in readers.yaml_documents(spark, str(tmp_path)).collect()}
    held = found.where("article_id = 'a'").orderBy("pos").collect()
    own = read["a", "20250203_040506"]
    assert own["article_id"] == "a" and [(b["type"], b["text"]) for b in own["document"]] == [(r.type, r.text) for r in held]
    assert read["b_c", "20250102_030405"]["document"][0]["text"] == "é"
    assert not list(Path(tmp_path).glob(f"{article_files.STAGED}*"))


def test_assets_have_a_file_an_article(spark, tmp_path):
    article_files.write_assets(spark, blocks.assets(pages(spark)), str(tmp_path), "20250102_030405")
    read = {r.article: json.loads(r.json)["document"] for r in readers.yaml_documents(spark, str(tmp_path)).collect()}
    assert [x["target"] for x in read["a"]["links"]] == ["u"] and read["a"]["images"] == []
    assert [(x["target"], x["text"]) for x in read["b_c"]["images"]] == [("i.png", "t")] and set(read) == {"a", "b_c"}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(article_files.ArticleFiles)
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("n"), "id").alias("article_id"), F.when(F.col("id") == 35, "no json").otherwise("[]").alias("json"))
    with pytest.raises(Exception, match="JSONDecodeError|Expecting value"):
        rows.write.format("article_files").mode("append").option("path", str(tmp_path)).save()
    time.sleep(2)  # tasks that were still at work end by themselves
    assert names(tmp_path) == [] and not any(Path(tmp_path).iterdir())
    assert readers.files(spark, str(tmp_path)).count() == 0


def test_one_broken_file_of_each_kind(spark, tmp_path):
    good = {"g.html": b"<h1>Title</h1><p>text</p>", "g.md": "# Kopf\n\n- é".encode(), "g.csv": b'id,content_html\nx/1,"<p>one</p>"\ny,"<p>two</p>"\n', "g.yaml": b"a: [1, 2]\n", "skip.bin": b"\xff"}
    bad = {"b.html": b"<p>\xff\xfe</p>", "b.md": b"a\0b", "b.csv": b"id,other\n1,2\n", "b.yaml": b"a: [1", "b2.csv": b"id,content_html\n1\n"}
    for name, content in {**good, **bad}.items():
        (tmp_path / name).write_bytes(content)
    found = quarantine.read_files(spark, str(tmp_path))
    rows = {r.name: r for r in found.selectExpr("name", "kind", "error", "to_json(result) AS json").collect()}
    assert set(rows) == set(good | bad) - {"skip.bin"}
    assert all((rows[n].json is None) == (rows[n].error is not None) == (n in bad) for n in rows)
    assert "UnicodeDecodeError" in rows["b.html"].error and "zero byte" in rows["b.md"].error and "content_html" in rows["b.csv"].error and "shorter" in rows["b2.csv"].error
    got = quarantine.good_blocks(found)
    assert got.columns == pages(spark).columns
    assert sorted((r.article_id, r.text) for r in got.collect()) == [("g", "# Kopf"), ("g", "# Title"), ("g", "- é"), ("g", "text"), ("x_1", "one"), ("y", "two")]
    assert json.loads(rows["g.yaml"].json)[0]["content"] == {"a": [1, 2]}
    assert found.where("kind = 'yaml'").selectExpr("variant_get(result, '$[0].content.a[1]', 'int') AS n").where("n is not null").first().n == 2
