"""Queries with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from corvane.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name, sf="/root/testdata/sf0.01"):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = db.sql(queries.ORACLE_SQL[name])
    found = queries.QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(want.fetchall())
