"""Files of all kinds with what can't be read set apart: one row a file, its content as a variant or the reason."""

from __future__ import annotations

import csv
import io
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import blocks

#: Columns of a CSV file of articles.
IDENT, HTML = "id", "content_html"
_KINDS = {"html": "html", "htm": "html", "md": "markdown", "csv": "csv", "yaml": "yaml", "yml": "yaml"}


def _articles(kind: str, stem: str, content: bytes) -> list[tuple[str, list[dict]]]:
    """Articles of one file with their blocks; raises what is wrong with it."""
    body = content.decode("utf-8-sig")
    if "\0" in body:
        raise ValueError("not a text: it has a zero byte")
    if kind == "yaml":
        import yaml

        return [(stem, yaml.safe_load(body))]
    if kind == "csv":
        rows = csv.DictReader(io.StringIO(body), strict=True)
        lacking = {IDENT, HTML} - set(rows.fieldnames or ())
        if lacking:
            raise ValueError(f"no column {', '.join(sorted(lacking))}")
        found = [(r[IDENT], r[HTML]) for r in rows]
        if any(i is None or h is None for i, h in found):
            raise ValueError("a row is shorter than the header")
        return [(i, blocks.read_html(h)) for i, h in found if h.strip()]
    return [(stem, blocks.read_html(blocks.markdown_to_html(body) if kind == "markdown" else body))]


def _read(batches):
    for batch in batches:
        out = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            name = path.rsplit("/", 1)[-1]
            stem, _, suffix = name.rpartition(".")
            kind = _KINDS[suffix.lower()]
            try:
                found = [{"article_id": a.replace("/", "_"), "content": b} for a, b in _articles(kind, stem, content or b"")]
                out.append((path, name, kind, json.dumps(found, ensure_ascii=False, default=str), None))
            except Exception as e:  # whatever a file holds, the others are read, and its row says why it isn't
                out.append((path, name, kind, None, f"{type(e).__name__}: {e}"[:300]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 5, ["path", "name", "kind", "json", "error"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``name``, ``kind``, ``result`` and ``error`` of the HTML, Markdown, CSV and YAML files below a folder.

    ``result`` is a variant: a list of articles, each with its blocks, or what a YAML file
    holds.  A file that can't be read has a null result and the reason, and no effect on
    others.  Files of other suffixes are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kinds = raw.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*_KINDS)).select("path", "content")
    found = kinds.mapInArrow(_read, "path string, name string, kind string, json string, error string")
    return found.select("path", "name", "kind", F.parse_json("json").alias("result"), "error")


def good_blocks(files: DataFrame) -> DataFrame:
    """The block table of all files that were read; YAML files are documents already and have none."""
    block = blocks.BLOCKS.replace("article_id string, ", "", 1)
    articles = F.from_json(F.to_json("result"), f"array<struct<article_id:string,content:array<struct<{', '.join(f.replace(' ', ':', 1) for f in _fields(block))}>>>>")
    rows = files.where("error is null and kind <> 'yaml'").select(F.explode(articles).alias("a")).select("a.article_id", F.posexplode("a.content").alias("at", "b"))
    return rows.select("article_id", "b.*")


def _fields(schema: str) -> list[str]:
    """The fields of a schema's text, not those inside of them."""
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]
