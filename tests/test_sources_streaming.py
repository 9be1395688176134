"""Logs with bad lines, and streams that end where the batch does."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from corvane.functions.text import epoch_ms
from corvane.operators.strikes import fold, ledger
from corvane.sources.logs import BAD, read_log
from corvane.streaming.events import strike_ledger, without_repeats

SCHEMA = StructType().add("a", StringType()).add("at", LongType())


def test_logs(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"a": "x", "at": 1}\n\n{"a": broken\n{"a": "y"}\n')
    path = str(tmp_path / "log.json")
    assert sorted(map(tuple, read_log(spark, path, SCHEMA, "skip").collect())) == [("x", 1), ("y", None)]
    kept = read_log(spark, path, SCHEMA, "keep").collect()
    assert len(kept) == 3 and [r[BAD] for r in kept if r[BAD]] == ['{"a": broken']
    with pytest.raises(Exception, match="(?i)malformed"):
        read_log(spark, path, SCHEMA).collect()
    with pytest.raises(ValueError):
        read_log(spark, path, SCHEMA, "else")


def test_cooldowns():
    assert fold(0, 0, [(0, "reject"), (59_999, "reject"), (60_000, "reject"), (61_000, "accept"), (61_001, "reject")]) == (3, 181_001, 1)


def _events(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where(F.col("event_type").isin("error", "signup"))
    kind = F.when(F.col("event_type") == "signup", "accept").otherwise("reject")
    return e.select("user_id", F.floor(epoch_ms(F.col("ts")) / 600).alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"))


def test_strike_stream_ends_like_the_batch(spark, sf, tmp_path):
    events = _events(spark, sf)
    middle = events.agg(F.percentile_approx("at", 0.5)).first()[0]
    for i, part in enumerate((events.where(F.col("at") < middle), events.where(F.col("at") >= middle))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    out = []
    for i in (0, 1):  # each file of the stream follows the one before
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in/{{0,{i}}}")
        q = strike_ledger(stream, "user_id").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
    last = {r.user_id: tuple(r) for r in out}
    assert last == {r.user_id: tuple(r) for r in ledger(events, "user_id").collect()}


def test_repeats(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    e.union(e).repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = without_repeats(stream, "event_id", "ts", "40 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == e.count()
