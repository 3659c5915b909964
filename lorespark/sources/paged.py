"""A paged source of accounts and transactions as a Spark data source.

The transport is a function from a page number to rows and the number of pages, so that
tests and stubs need no network; a real one calls a service.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


def register(spark: SparkSession, name: str, schema: str, fetch: Callable[[int], tuple[list[tuple], int]]) -> None:
    """Registers a format whose rows are those of all pages, one partition for each page."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Page(k) for k in range(1, max(1, fetch(1)[1]) + 1)]

        def read(self, partition):
            yield from fetch(partition.number)[0]

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)


def transaction(kind: str, amount: str, source: int | None, target: int | None, day: str, description: str, category: str | None = None) -> dict:
    """Body of a withdrawal, transfer or deposit."""
    needed = {"withdrawal": (source,), "transfer": (source, target), "deposit": (target,)}
    if kind not in needed or None in needed[kind]:
        raise ValueError(f"no complete transaction: {kind}")
    row = {"type": kind, "amount": amount, "date": day, "description": description, "source_id": source, "destination_id": target, "category_name": category}
    return {"transactions": [{k: v for k, v in row.items() if v is not None}]}
