"""Every query with SQL gives the rows that DuckDB gives for that SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from corvane.plans import catalog, changes, reads, registry, states, texts  # noqa: F401 (each registers its queries)

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)


def rows(columns: list[str], found: list) -> list:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in at) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the synthetic tables are not there")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


#: Queries whose patterns look around, which DuckDB's cannot.
WITHOUT_SQL = {"redact_counts", "guarded_messages"}


def test_every_query_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == WITHOUT_SQL
