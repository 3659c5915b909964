"""Readers of articles, notes, metadata and vectors, and writers of what operators return."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import text
from lorespark.functions.names import spare
from lorespark.operators import blocks

# Name patterns of notes by grain.
GRAINS = {"daily": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\.md$", "weekly": r"^[0-9]{4}-W[0-9]{2}\.md$", "monthly": r"^[0-9]{4}-[0-9]{2}\.md$"}


def articles_csv(spark: SparkSession, path: str, html: str = "content_html", ident: str = "id") -> DataFrame:
    """Blocks of the HTML articles in CSV files."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return blocks.html_blocks(rows.select(F.col(ident).alias("article_id"), F.col(html).alias("html")))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``name`` and ``text`` of whole files below a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return raw.select(F.substring_index("path", "/", -1).alias("name"), "path", F.decode("content", "utf-8").alias("text"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of Markdown, HTML and CSV files, by their suffix; of a CSV file the last article is taken.

    YAML files are documents already: ``yaml_documents`` reads them.  Other files are left out.
    """

    def last_article(batches):
        import csv
        import io

        for batch in batches:
            out = []
            for body in batch.column("html").to_pylist():
                rows = [r for r in csv.DictReader(io.StringIO(body or "")) if (r.get("content_html") or "").strip()]
                out += [(rows[-1].get("id") or "", rows[-1]["content_html"])] if rows else []
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(2)], ["article_id", "html"])

    found = files(spark, path)
    named = found.select(F.regexp_replace("name", r"\.[^.]+$", "").alias("article_id"), F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).alias("suffix"), F.col("text").alias("html"))
    tables = named.where("suffix = 'csv'").select("html").mapInArrow(last_article, "article_id string, html string")
    pages = named.where("suffix in ('html', 'htm')").select("article_id", "html").unionByName(tables)
    return blocks.html_blocks(pages).unionByName(blocks.html_blocks(named.where("suffix = 'md'"), markdown=True))


def yaml_documents(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``article``, ``version``, ``json`` and ``error`` of YAML files: one that can't be read does not stop the others."""

    def run(frames):
        import json

        import yaml

        for frame in frames:
            out = []
            for name, body in zip(frame["name"], frame["text"]):
                try:
                    out.append((name, json.dumps(yaml.safe_load(body), ensure_ascii=False, default=str), None))
                except yaml.YAMLError as e:
                    out.append((name, None, str(e)[:300]))
            yield pd.DataFrame(out, columns=["name", "json", "error"])

    found = files(spark, path, "*.y*ml").select("name", "text").mapInPandas(run, "name string, json string, error string")
    version = text.file_version(F.col("name"))
    return found.select("name", version["article"].alias("article"), version["version"].alias("version"), "json", "error")


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes of a vault with their grain, which the file's name decides; others are left out."""
    grain = None
    for name, pattern in GRAINS.items():
        hit = F.col("name").rlike(pattern)
        grain = F.when(hit, name) if grain is None else grain.when(hit, name)
    found = files(spark, path, "*.md").withColumn("grain", grain).where("grain is not null")
    return found.select(F.regexp_replace("name", r"\.md$", "").alias("note"), "grain", "text")


def metadata(spark: SparkSession, paths: list[str], ident: str = "id") -> DataFrame:
    """Rows of metadata files; of an id the last row of the last file holds, and files that aren't there are skipped."""
    context = spark.sparkContext
    there = lambda p: context._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(context._jsc.hadoopConfiguration()).exists(context._jvm.org.apache.hadoop.fs.Path(p))
    frames = [spark.read.option("header", True).csv(p).withColumns({"_file": F.lit(k), "_row": F.monotonically_increasing_id()}) for k, p in enumerate(paths) if there(p)]
    if not frames:
        raise FileNotFoundError(f"none of {paths}")
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return last_of(whole, ident, ["_file", "_row"]).drop("_file", "_row")


def upsert_vectors(state: DataFrame, delta: DataFrame, dimensions: int, key: str = "node_id", vector: str = "embedding", recreate: bool = False) -> DataFrame:
    """Points with the delta's put over them by key; a vector of the delta of another size is an error.

    With ``recreate`` old points of another size go, as when an embedder is changed and the
    collection is made anew; without it they stay until they are put over.
    """
    if recreate:
        state = state.where(F.size(vector) == dimensions)
    right = F.when(F.size(vector) == dimensions, F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector hasn't {dimensions} numbers")))
    fresh = delta.withColumn(vector, right)
    return state.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(state.columns))


def write_versions(frame: DataFrame, path: str, version: str | None = None) -> None:
    """Appends a version of articles to a table partitioned by version; without one, the versions in the column of that name."""
    (frame if version is None else frame.withColumn("version", F.lit(version))).write.mode("append").partitionBy("version").parquet(path)


def latest(frame: DataFrame, by: str = "article_id", version: str = "version") -> DataFrame:
    """Rows of the last version of each article."""
    (last,) = spare(frame.columns, "_last")
    return frame.withColumn(last, F.max(version).over(Window.partitionBy(by))).where(F.col(version) == F.col(last)).drop(last)


def write_csv(frame: DataFrame, path: str) -> None:
    """CSV with a header, lists joined by semicolons, appended."""
    flat = [F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array") else F.to_json(c).alias(c) if t.startswith(("struct", "map")) else F.col(c) for c, t in frame.dtypes]
    frame.select(*flat).write.mode("append").option("header", True).option("escape", '"').csv(path)


def plain_lines(frame: DataFrame, quoted: tuple[str, ...] = ()) -> DataFrame:
    """Each row as one ``line`` of values between commas, nothing escaped: the layout of task and wellness lists.

    A null is ``None``, a truth value ``True`` or ``False``, a list is joined by semicolons, and the
    columns ``quoted`` stand in quotes, whatever is in them.
    """

    def one(name: str, kind: str):
        c = F.col(f"`{name}`")
        plain = F.initcap(c.cast("string")) if kind == "boolean" else F.array_join(c.cast("array<string>"), ";", "None") if kind.startswith("array") else c.cast("string")
        plain = F.coalesce(plain, F.lit("None"))
        return F.concat(F.lit('"'), plain, F.lit('"')) if name in quoted else plain

    return frame.select(F.concat_ws(",", *(one(c, t) for c, t in frame.dtypes)).alias("line"))


def write_plain_csv(frame: DataFrame, path: str, quoted: tuple[str, ...] = ()) -> None:
    """Appends files of ``plain_lines`` below a header of the columns' names; they are read by people, not parsed."""
    header = ",".join(frame.columns)

    def run(batches):
        first = True
        for batch in batches:
            if batch.num_rows:
                lines = batch.column("line")
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([header], lines.type), lines]) if first else lines], ["line"])
                first = False

    plain_lines(frame, quoted).mapInArrow(run, "line string").write.mode("append").text(path)


def to_json(frame: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return frame.select(F.to_json(F.struct(*frame.columns)).alias("json"))


def token_totals(usage: DataFrame) -> DataFrame:
    """Token usage by component, and of all together as a row without one."""
    return usage.rollup("component").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("total").alias("total"), F.sum("calls").alias("calls"))


def first_of(rows: DataFrame, key: str, order: list[str], body: str = "text") -> DataFrame:
    """The first row in order of each key, among rows whose text isn't blank."""
    shown = rows.where(F.trim(body) != "")
    first = shown.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("r"))
    return first.select(key, "r.*").select(rows.columns)


def last_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row in order of each key."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("r"))
    return last.select(key, "r.*").select(rows.columns)


def with_metadata(articles: DataFrame, found: DataFrame, key: str = "article_id", ident: str = "id") -> DataFrame:
    """Every article with its metadata, nulls where there is none; columns that both have keep the article's."""
    extra = [c for c in found.columns if c != ident and c not in articles.columns]
    return articles.join(found.select(F.col(ident).alias(key), *extra), key, "left")


def upsert_points(state: DataFrame, delta: DataFrame, key: str = "node_id", lists: str = "keywords") -> DataFrame:
    """Points with the delta's over them by key; their keywords are put to the old ones, each once and in order."""
    old = state.select(key, F.col(lists).alias("held"))
    none = F.array().cast("array<string>")
    fresh = delta.join(old, key, "left").withColumn(lists, F.array_sort(F.array_union(F.coalesce("held", none), F.coalesce(lists, none)))).select(state.columns)
    return state.join(delta.select(key), key, "left_anti").unionByName(fresh)


def write_table(frame: DataFrame, url: str, name: str, **options) -> None:
    """Appends to a table of a database over JDBC, which is made where it is missing."""
    frame.write.mode("append").options(**options).jdbc(url, name)


def read_table(spark: SparkSession, url: str, name: str, split: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A table of a database over JDBC; ``split`` is a column with its bounds and a number of partitions to read side by side."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if split:
        column, low, high, parts = split
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()
