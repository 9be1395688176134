"""score_tags gives its SQL's rows, whatever the order of rows, at bars, ties and odd rows."""

from __future__ import annotations

import duckdb
import pytest

from corvane.plans import reads, registry  # noqa: F401 (registers its queries)

NAN, INF = float("nan"), float("inf")


def tagged(spark, rows, folder):
    spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return sorted(map(tuple, registry.QUERIES["score_tags"](spark, str(folder)).collect()), key=str)


@pytest.mark.parametrize("turn", [1, -1])
def test_a_mean_at_the_bar_reaches_it_in_any_order(spark, tmp_path, turn):
    # in doubles the sum of each of these is off in one order of rows at least
    at_bar = {1: ("error", [59.7, 59.9, 60.1, 60.3]), 2: ("view", [0.1, 0.7, 103.2, 104.0]), 3: ("click", [34.83, 35.09, 35.15, 34.93])}
    tie = [(4, "click", v) for v in (10.1, 10.2, 10.3)] + [(4, "view", v) for v in (10.2, 10.2)] + [(4, "buy", v) for v in (0.1, 0.2, 40.5, 0.0)]
    rows = [(u, k, v) for u, (k, vs) in at_bar.items() for v in vs] + tie
    want = [(1, "error", "error"), (2, "view", "view"), (3, "click", "click"), (4, "", "buy")]
    assert tagged(spark, rows[::turn], tmp_path) == want


def test_odd_rows_as_in_sql(spark, tmp_path):
    rows = [
        (None, "view", 70.0), (None, "error", 10.0), (2, None, 90.0), (2, "click", 10.0), (3, "view", None), (3, "click", 5.0), (4, "view", None), (5, "a", NAN), (5, "b", 3.0), (6, "a", INF), (6, "b", NAN),
        (7, None, 1.0), (8, "a", -INF), (8, "z", 1.0), (9, "b", 0.0), (9, "a", -0.0), (10, "a", INF), (10, "a", -INF), (11, "b", None), (11, "a", None), (12, "a", 1e300), (12, "a", 1e300), (13, "b", None), (13, None, 4.0), (14, "a", 1e-15), (14, "b", 2e-15),
    ]
    got = tagged(spark, rows, tmp_path)
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == sorted(con.execute(registry.ORACLE_SQL["score_tags"]).fetchall(), key=str)
