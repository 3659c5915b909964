"""A file for each article: YAML under a dated name, written by the tasks and shown all at once.

Each task writes below a folder of its own that readers don't look into.  When every task
is done, the driver moves the tasks' folders, not their files, to where they count; a job
that fails takes them away.  A task that ran twice has two folders, and only that of the
attempt that Spark kept is moved.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Fixed value: how a version is written in a file's name.
VERSION = "%Y%m%d_%H%M%S"
#: Spark's readers leave folders of this kind out.
STAGED = "_staged-"


@dataclass
class _Done(WriterCommitMessage):
    folder: str | None
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, version: str, stamp: str):
        self.path, self.version, self.stamp, self.run = path, version, stamp, uuid.uuid4().hex

    def _folder(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        return system, root.rstrip("/")

    def write(self, rows) -> WriterCommitMessage:
        import yaml

        system, root = self._folder()
        own, n = f"{root}/{STAGED}{self.run}/{uuid.uuid4().hex}", 0
        for row in rows:
            if not n:
                system.create_dir(own, recursive=False)  # fails once the job has been given up and its folder is gone
            document = {"article_id": row["article_id"], "parsed_at": self.stamp, "document": json.loads(row["json"])}
            with system.open_output_stream(f"{own}/{row['article_id'].replace('/', '_')}_{self.version}.yaml") as out:
                out.write(yaml.safe_dump(document, allow_unicode=True, sort_keys=False).encode("utf-8", "surrogatepass"))
            n += 1
        return _Done(own if n else None, n)

    def commit(self, messages) -> None:
        system, root = self._folder()
        for k, m in enumerate(sorted((m for m in messages if m and m.folder), key=lambda m: m.folder)):
            system.move(m.folder, f"{root}/{self.version}-{self.run[:8]}-{k:05d}")
        self._forget()

    def abort(self, messages) -> None:
        self._forget()

    def _forget(self) -> None:
        from pyarrow import fs

        system, root = self._folder()
        staged = f"{root}/{STAGED}{self.run}"
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


class ArticleFiles(DataSource):
    """Format ``article_files``: columns ``article_id`` and ``json``; options ``path`` and ``version``, now by default."""

    @classmethod
    def name(cls):
        return "article_files"

    def schema(self):
        return "article_id string, json string"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("versions of articles are appended")
        now = datetime.now(timezone.utc)
        own = _Writer(self.options["path"], self.options.get("version") or now.strftime(VERSION), now.replace(tzinfo=None).isoformat())
        system, root = own._folder()
        system.create_dir(f"{root}/{STAGED}{own.run}", recursive=True)  # on the driver, once for all tasks
        return own


def write_articles(spark: SparkSession, blocks: DataFrame, path: str, version: str | None = None) -> None:
    """A YAML file for each article of a block table, named ``<article>_<version>.yaml``, in folders below ``path``.

    The folder is one that all executors reach.  If any task fails, no file is left.  Read
    them back by ``readers.yaml_documents``.
    """
    spark.dataSource.register(ArticleFiles)
    own = [c for c in blocks.columns if c not in ("article_id", "pos")]
    whole = blocks.groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*own).alias("block")))).alias("b"))
    rows = whole.select("article_id", F.to_json(F.transform("b", lambda x: x["block"])).alias("json"))
    writer = rows.write.format("article_files").mode("append").option("path", path)
    (writer.option("version", version) if version else writer).save()


def write_assets(spark: SparkSession, assets: DataFrame, path: str, version: str | None = None) -> None:
    """Links and images of each article, as ``operators.blocks.assets`` lists them, in a file of its own."""
    spark.dataSource.register(ArticleFiles)
    of = lambda kind: F.filter(F.sort_array(F.collect_list(F.struct("kind", "block_id", "order", "target", "text"))), lambda x: x["kind"] == kind)
    listed = assets.groupBy("article_id").agg(F.to_json(F.struct(of("link").alias("links"), of("image").alias("images"))).alias("json"))
    writer = listed.write.format("article_files").mode("append").option("path", path)
    (writer.option("version", version) if version else writer).save()
