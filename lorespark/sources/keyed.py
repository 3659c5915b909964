"""Tables kept by key: rows lie in buckets of their key's hash, and a version names the files of each.

An upsert reads and rewrites just the buckets that its rows fall into; the others go into
the next version as they are.  A version is one small file, with a row a bucket, which is
put in place by a rename: readers see the one before or the one after.  Buckets of two
tables of as many buckets hold the same keys, so ``joined`` meets them bucket by bucket.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.names import spare

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has put the same version in place."""


class KeyedTable:
    """A table at a ``path`` that all executors reach, with unique ``keys`` that aren't null."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def create(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> KeyedTable:
        """A new table of ``rows``; a key that is null or there twice is an error."""
        out = KeyedTable(spark, path)
        if out.versions():
            raise FileExistsError(path)
        head = {"keys": keys, "buckets": buckets, "schema": rows.schema.jsonValue(), "folders": {}}
        out._put(0, head | {"folders": out._written(head, out._checked(rows, keys))})
        return out

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def head(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        row = self.spark.read.option("wholetext", True).text(f"{self.path}/versions/{version}.json").first()
        return json.loads(row[0]) | {"version": version}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default."""
        return self._rows(self.head(version), None)

    def read_keys(self, wanted: DataFrame) -> DataFrame:
        """The rows of the wanted keys; only their buckets are opened."""
        head = self.head()
        return self._rows(head, self._touched(head, wanted)).join(wanted.select(*head["keys"]).distinct(), head["keys"], "left_semi")

    def upsert(self, delta: DataFrame) -> int:
        """Puts the delta's rows over those of the same key and returns the number of buckets that were rewritten."""
        return self._change(self._checked(delta.select(self.read().columns), self.head()["keys"]), True)

    def delete(self, gone: DataFrame) -> int:
        """Takes the rows of these keys out and returns the number of buckets that were rewritten."""
        return self._change(gone.select(*self.head()["keys"]).distinct(), False)

    def joined(self, other: KeyedTable, how: str = "inner") -> DataFrame:
        """Both tables by their keys, which have the same names and as many buckets; the buckets are part of the condition."""
        one, two = self.head(), other.head()
        if (one["keys"], one["buckets"]) != (two["keys"], two["buckets"]):
            raise ValueError("tables of other keys or buckets")
        (bucket,) = spare([*self.read().columns, *other.read().columns], "_bucket")
        mark = lambda t, h: t._rows(h, None).withColumn(bucket, t._bucket(h))
        return mark(self, one).join(mark(other, two), [bucket, *one["keys"]], how).drop(bucket)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes versions but the last ``keep`` and the folders that only they name; returns how many folders went."""
        versions = self.versions()
        live = {f for v in versions[-keep:] for f in self.head(v)["folders"].values()}
        gone = {f for v in versions[:-keep] for f in self.head(v)["folders"].values()} - live
        for v in versions[:-keep]:
            self._files.delete(self._path(f"{self.path}/versions/{v}.json"), False)
        for folder in gone:
            self._files.delete(self._path(f"{self.path}/{folder}"), True)
        return len(gone)

    # --- inside ---------------------------------------------------------------------------

    def _bucket(self, head: dict) -> Column:
        return F.pmod(F.xxhash64(*head["keys"]), F.lit(head["buckets"])).cast("int")

    def _touched(self, head: dict, rows: DataFrame) -> list[int]:
        return sorted(r.b for r in rows.select(self._bucket(head).alias("b")).distinct().collect())  # a row a bucket at most

    def _rows(self, head: dict, buckets: list[int] | None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(head["schema"])
        folders = [f"{self.path}/{f}" for b, f in head["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _checked(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        bad = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1).limit(1).count()
        if bad or not rows.where(" or ".join(f"`{k}` is null" for k in keys)).isEmpty():
            raise ValueError(f"keys must be there once and not null: {keys}")
        return rows

    def _written(self, head: dict, rows: DataFrame) -> dict[str, str]:
        """The rows in a folder for each of their buckets."""
        (bucket,) = spare(rows.columns, "_bucket")
        folder = f"data/{uuid.uuid4().hex}"
        marked = rows.withColumn(bucket, self._bucket(head))
        marked.repartition(head["buckets"], bucket).sortWithinPartitions(bucket, *head["keys"]).write.partitionBy(bucket).parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.path}/{folder}")) if s.isDirectory()]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names}

    def _change(self, delta: DataFrame, put: bool) -> int:
        head = self.head()
        touched = self._touched(head, delta)
        if not touched:
            return 0
        rest = self._rows(head, touched).join(delta.select(*head["keys"]), head["keys"], "left_anti").select(self.read().columns)
        new = self._written(head, rest.unionByName(delta) if put else rest)
        folders = {b: f for b, f in head["folders"].items() if int(b) not in touched} | new
        version = head.pop("version") + 1
        self._put(version, head | {"folders": folders})
        return len(touched)

    def _put(self, version: int, head: dict) -> None:
        folder, final = f"{self.path}/versions", self._path(f"{self.path}/versions/{version}.json")
        begun = self._path(f"{folder}/_{uuid.uuid4().hex}")
        out = self._files.create(begun, False)
        out.write(bytearray(json.dumps(head), "utf-8"))
        out.close()
        if self._files.exists(final) or not self._files.rename(begun, final):
            self._files.delete(begun, False)
            raise Conflict(f"version {version} is there")
