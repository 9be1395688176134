"""State that outlives a run: streams end where one pass over all rows ends, and what is replayed writes nothing."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.plans import flows, registry
from corvane.sources.commits import Store
from corvane.streaming import acquire

NAMES = sorted(n for n, f in vars(flows).items() if n in registry.QUERIES)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("sf", ["sf0.001"])
def test_queries_and_their_sql(spark, name, sf):
    db, path = duckdb.connect(), f"/root/testdata/{sf}"
    for t in ("events", "orders", "customer", "lineitem", "documents"):
        db.sql(f"create view {t} as select * from read_parquet('{path}/{t}.parquet')")
    found = registry.QUERIES[name](spark, path)
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted(map(tuple, found.select(want.columns).collect()), key=str) == sorted(want.fetchall(), key=str) and found.count()


PART = "array<struct<part:long,status:string,why:string>>"
MESSAGE = "room string, id long, tries long"


def deliver(messages, number):
    """A message fails for now in the first ``tries`` micro-batches; one of the room ``shut`` is withheld."""
    status = F.when(F.col("tries") > number, acquire.TRANSIENT).otherwise("posted")
    part = F.ascii("room").cast("long") * 1000 + F.col("id") * 10
    parts = F.array(F.struct(part.alias("part"), F.lit("posted").alias("status"), F.lit(None).cast("string").alias("why")), F.struct((part + 1).alias("part"), status.alias("status"), F.lit(None).cast("string").alias("why")))
    return messages.withColumns({"own": F.col("room") == "self", "withheld": (F.col("room") == "shut") & (F.col("id") == 2), "parts": parts})


BATCHES = [[("a", 1, 0), ("a", 2, 2), ("b", 1, 0), ("shut", 1, 0)], [("a", 3, 0), ("shut", 2, 0), ("shut", 3, 0), ("self", 1, 9)], [("b", 2, 0)], []]


def test_a_failure_holds_its_partition_not_the_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    after = lambda: {r.room: (r.after, r.stopped) for r in store.read("marks").collect()}
    batch = [spark.createDataFrame(b, MESSAGE) for b in BATCHES]
    assert acquire.acquire(store, batch[0], 0, deliver, "room", "id")
    assert after() == {"a": (1, "transient"), "b": (1, None), "shut": (1, None)}
    version = store.version()
    assert not acquire.acquire(store, batch[0], 0, deliver, "room", "id") and store.version() == version
    acquire.acquire(store, batch[1], 1, deliver, "room", "id")
    assert after() == {"a": (1, "transient"), "b": (1, None), "shut": (1, "withheld"), "self": (1, None)}
    assert rows(store.read("waiting").select("room", "id")) == [("a", 2), ("a", 3), ("shut", 2), ("shut", 3)]
    acquire.acquire(store, batch[2], 2, deliver, "room", "id")
    assert after() == {"a": (3, None), "b": (2, None), "shut": (1, "withheld"), "self": (1, None)}
    log = store.read("outcomes").where("room = 'a'")
    assert rows(log.select(F.col("part") - 97_000, "batch")) == [(10, 0), (11, 0), (20, 0), (20, 1), (20, 2), (21, 2), (30, 2), (31, 2)]
    assert rows(acquire.latest_outcomes(store).where("room = 'a'").select(F.col("part") - 97_000, "batch")) == [(10, 0), (11, 0), (20, 2), (21, 2), (30, 2), (31, 2)]


def test_stream_ends_like_one_pass(spark, tmp_path):
    for i, b in enumerate(BATCHES[:3]):
        spark.createDataFrame(b, MESSAGE).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    store, schema = Store(spark, str(tmp_path / "store")), spark.createDataFrame([], MESSAGE).schema
    for i in range(3):  # each file of the stream follows the one before
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/{{{','.join(map(str, range(i + 1)))},x}}")
        acquire.acquiring(stream, store, deliver, "room", "id", f"{tmp_path}/cp").awaitTermination()
    every = spark.createDataFrame([m for b in BATCHES for m in b], MESSAGE)
    stepped = acquire.steps(deliver(every, 2), None, "room", "id")
    assert rows(store.read("marks").select("room", "after")) == rows(acquire.marked(stepped, None, "room", "id").select("room", "after"))
    assert store.meta()["batch"] == 2


def test_pages_that_go_backwards(spark):
    pages = spark.createDataFrame([("a", 0, 1), ("a", 0, 5), ("a", 1, 6), ("a", 2, 6), ("b", 0, 9), ("b", 1, 3)], "room string, page int, id long")
    assert rows(acquire.backward_pages(pages, "room", "page", "id").select("room", "page")) == [("a", 2), ("b", 1)]


def test_a_watermark_that_does_not_move_stays(spark):
    marks = spark.createDataFrame([("a", 7)], "room string, after long")
    stepped = acquire.steps(deliver(spark.createDataFrame([("a", 6, 0), ("a", 8, 9)], MESSAGE), 0), marks, "room", "id")
    assert rows(acquire.marked(stepped, marks, "room", "id")) == [("a", 7, 0, "transient")]
    assert rows(acquire.outcomes(stepped, "room", "id").select("part", "status")) == [(97_080, "posted")]
