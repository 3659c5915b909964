"""Every query with an SQL statement, against DuckDB on the smallest tables; the others for rows and a stable schema."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from lorespark.plans import load

SF = "/root/testdata/sf0.001"
REGISTRY = load()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    found = REGISTRY.QUERIES[name](spark, SF)
    want = duck.sql(REGISTRY.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted([plain(v) for v in r] for r in found.select(columns).collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(REGISTRY.QUERIES) - set(REGISTRY.ORACLE_SQL)))
def test_gives_rows(spark, name):
    found = REGISTRY.QUERIES[name](spark, SF)
    assert len(found.columns) == len(set(found.columns)) and not found.isEmpty()
