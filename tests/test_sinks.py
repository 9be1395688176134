"""Writes that can be repeated, listings, queues and sessions as streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from corvane.operators import outbox, permissions, rollup, walks
from corvane.sources import logs, objects, sinks
from corvane.streaming import events as streams

SCHEMA = StructType().add("k", LongType()).add("v", StringType())


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_publish_and_upsert(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], SCHEMA)
    path = str(tmp_path / "t")
    assert sinks.publish(a, path, "k") == 2
    assert sinks.publish(a, path, "k") == 0
    assert sinks.publish(spark.createDataFrame([(2, "other"), (3, "c")], SCHEMA), path, "k") == 1
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b"), (3, "c")]
    assert sinks.upsert(spark.createDataFrame([(1, "a"), (2, "new"), (9, None)], SCHEMA), path, "k") == 2
    assert sinks.upsert(spark.createDataFrame([(1, "a"), (2, "new"), (9, None)], SCHEMA), path, "k") == 0
    assert rows(spark.read.parquet(path).where("v is not null")) == [(1, "a"), (2, "new"), (3, "c")]
    sinks.replace(a.limit(1), path)
    assert spark.read.parquet(path).count() == 1


def test_logs_and_state(spark, tmp_path):
    path = str(tmp_path / "log")
    assert logs.read_state(spark, path, SCHEMA).count() == 0
    sinks.append_log(spark.createDataFrame([(1, "a"), (5, "b")], SCHEMA), path)
    sinks.append_log(spark.createDataFrame([(7, "c")], SCHEMA), path)
    assert rows(logs.since(logs.read_state(spark, path, SCHEMA), "k", 1)) == [(5, "b"), (7, "c")]
    (tmp_path / "log" / "bad.json").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        logs.read_state(spark, path, SCHEMA).collect()
    assert len(logs.read_state(spark, path, SCHEMA, "skip").collect()) == 3


def test_objects(spark, tmp_path):
    for name, size in (("a.bin", 3), ("b.bin", 50)):
        (tmp_path / name).write_bytes(b"x" * size)
    found = objects.listing(spark, str(tmp_path), "*.bin")
    keys = spark.createDataFrame([("a.bin",), ("none.bin",)], "key string")
    assert {r.key: r.bytes for r in objects.heads(keys, found, "key").collect()} == {"a.bin": 3, "none.bin": None}
    assert sorted((r.ok, r.reason) for r in objects.contents(spark, str(tmp_path), 10, "*.bin").collect()) == [(False, "too large"), (True, None)]


def test_queue_acts_in_order_of_names(spark, tmp_path):
    for i in (3, 1, 2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"k": i, "v": "x"}) + "\n")
    out = []
    q = streams.queued_files(spark, str(tmp_path), SCHEMA).writeStream.foreachBatch(lambda df, _: out.extend(r.k for r in df.orderBy("path").collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert out == [1, 2, 3]


def test_session_and_route_streams_end_like_the_batch(spark, tmp_path):
    schema = "user string, at long, seq long, kind string"
    data = [("a", 10, 1, "arm"), ("a", 20, 2, "use"), ("a", 30, 3, "use"), ("b", 5, 4, "use"), ("c", 1, 5, "arm"), ("c", 200_000, 6, "use")]
    df = spark.createDataFrame(data, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = []
    q = streams.armed_sessions(stream, "user").writeStream.outputMode("append").foreachBatch(lambda d, _: out.extend(map(tuple, d.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(out) == [("a", 20, "consumed"), ("a", 30, "none"), ("b", 5, "none"), ("c", 200_000, "expired")]
    batch = rollup.armed(df.withColumn("ts", F.timestamp_millis("at")), "user", ["ts", "seq"], F.col("kind") == "arm", F.col("kind") == "use", "interval 2 minutes")
    assert sorted((r.user, r.at, r.session) for r in batch.collect()) == sorted(out)
    routed = streams.routed(stream, ("arming", F.col("kind") == "arm"), ("early", F.col("at") < 25))
    q = routed.writeStream.format("memory").queryName("routes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.route for r in spark.table("routes").collect()) == ["arming", "arming", "early", "early", "image", "image"]


def test_walk_rules(spark):
    cases = [
        # trigger, restart, head, cursor, reached, attempts of its one failure -> plan
        ("sweep", False, None, None, False, None, "initial"), ("sweep", True, 5, 2, True, None, "initial"), ("command", False, 5, 2, True, None, "initial"), ("command", False, 5, 2, False, None, "resume"),
        ("rejoin", False, 5, 2, True, None, "gap"), ("rejoin", False, None, 2, False, None, "resume"), ("sweep", False, 5, 2, False, 1, "resume"), ("join", False, 5, None, True, 4, "retry"), ("join", False, 5, None, True, 5, "skip"), ("sweep", False, 5, None, True, None, "skip"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, trigger string, restart boolean, head long, cursor long, reached boolean, attempts long, want string")
    failed = F.when(F.col("attempts").isNotNull(), F.array(F.struct(F.lit(1).alias("event_id"), "attempts")))
    got = df.withColumn("plan", walks.plan(F.col("trigger"), F.col("restart"), F.col("head"), F.col("cursor"), F.col("reached"), failed)).orderBy("i").collect()
    assert [r.plan for r in got] == [r.want for r in got]


def test_sweep_stops_after_answers_that_do_not_come(spark):
    box = spark.createDataFrame([(i, i, "retry" if i in (2, 4, 5, 6) else "accepted", None if i == 1 else i) for i in range(1, 10)], "id long, queued_at long, cls string, next_try_at long")
    got = outbox.sweep(box, F.lit(100), ["next_try_at", "queued_at"], breaker=3).orderBy("i").collect()
    assert [r.id for r in got] == [1, 2, 3, 4, 5, 6]
    assert [r.id for r in outbox.sweep(box, F.lit(3), ["next_try_at", "queued_at"]).orderBy("i").collect()] == [1, 2, 3]


def test_masks_of_64_bits(spark):
    df = spark.createDataFrame([("18446744073709551615",), ("9223372036854775808",), ("8",)], "x string")
    assert [r[0] for r in df.select(permissions.unsigned(F.col("x"))).collect()] == [-1, -(1 << 63), 8]
    masks = [("own", 0, "base", "allow", True), ("admin", 8, "base", "allow", False), ("admin", 8, "group", "deny", False), ("plain", 7, "base", "allow", False), ("plain", 3, "group", "deny", False), ("plain", 1, "member", "allow", False)]
    got = permissions.folded(spark.createDataFrame(masks, "k string, m long, stage string, kind string, o boolean"), "k", "m", "stage", ["base", "group", "member"], owner="o", administrator=8)
    assert {r.k: r.permissions for r in got.collect()} == {"own": -1, "admin": -1, "plain": 5}
