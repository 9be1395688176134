"""Sessions that end by a timer, ledgers that are forgotten, and ids that are known up to a count."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from corvane.operators.strikes import fold
from corvane.streaming import timers


@pytest.fixture
def rocksdb(spark):
    before = {k: spark.conf.get(k, None) for k in timers.ROCKSDB}
    for k, v in timers.ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def replay(spark, tmp_path, batches, schema, flow, mode, **trigger):
    """The rows of each micro-batch, and the state's rows after it."""
    out, states = [], []
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).withColumn("at", F.timestamp_millis("at") if "ms long" in schema or mode == "append" and "kind" in schema else F.col("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/0").schema).parquet(f"{tmp_path}/in/{{{','.join(map(str, range(i + 1)))},x}}")
        q = flow(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda df, _: out.append(sorted(map(tuple, df.collect())))).trigger(**(trigger or {"availableNow": True})).start()
        assert q.awaitTermination(60)
        states.append(sum(s.get("numRowsTotal", 0) for s in (q.lastProgress or {}).get("stateOperators", [])) if q.lastProgress else None)
    return out, states


def test_sessions_end_by_a_timer(spark, rocksdb, tmp_path):
    s = 1_000
    batches = [
        [("a", 10 * s, 1, "arm"), ("a", 60 * s, 2, "use"), ("a", 61 * s, 3, "use"), ("b", 10 * s, 4, "arm"), ("c", 20 * s, 5, "use")],
        [("z", 300 * s, 6, "use")],  # the watermark passes the end of b's session; b itself says no more
        [("b", 310 * s, 7, "use"), ("a", 320 * s, 8, "arm"), ("a", 330 * s, 9, "arm"), ("a", 449 * s, 10, "use")],
        [("z", 900 * s, 11, "use")],
    ]
    out, states = replay(spark, tmp_path, batches, "k string, at long, seq long, kind string", lambda d: timers.timed_sessions(d, "k"), "append")
    got = sorted(x for b in out for x in b)
    assert got == sorted([("a", 60 * s, "consumed"), ("a", 61 * s, "none"), ("c", 20 * s, "none"), ("b", 130 * s, "expired"), ("z", 300 * s, "none"), ("b", 310 * s, "none"), ("a", 449 * s, "consumed"), ("z", 900 * s, "none")])
    assert states[0] > 0 and states[-1] == 0


def test_a_late_use_finds_an_expired_session(spark, rocksdb, tmp_path):
    batches = [[("a", 1_000, 1, "arm")], [("a", 200_000, 2, "use")]]
    out, states = replay(spark, tmp_path, batches, "k string, at long, seq long, kind string", lambda d: timers.timed_sessions(d, "k", delay="1 hour"), "append")
    assert sorted(x for b in out for x in b) == [("a", 121_000, "expired"), ("a", 200_000, "none")] and states[-1] == 0


def test_ledgers_like_the_fold_and_forgotten(spark, rocksdb, tmp_path):
    events = [("a", 0, 1, "reject"), ("a", 59_999, 2, "reject"), ("a", 60_000, 3, "reject"), ("a", 61_000, 4, "accept"), ("a", 61_001, 5, "reject")]
    schema, want = "k string, at long, seq long, kind string", fold(0, 0, [(e[1], e[3]) for e in events])
    out, _ = replay(spark, tmp_path / "one", [events[:2], events[2:]], schema, lambda d: timers.timed_ledger(d, "k"), "update")
    assert out[-1] == [("a", *want)]

    def later(d):
        time.sleep(3)
        return timers.timed_ledger(d, "k", ttl_ms=1)

    out, _ = replay(spark, tmp_path / "two", [events[:2], events[2:]], schema, later, "update", once=True)  # with processing time every trigger has work
    assert out[-1] == [("a", *fold(0, 0, [(e[1], e[3]) for e in events[2:]]))]


def test_repeats_within_the_last_ids(spark, rocksdb, tmp_path):
    batches = [[("a", i) for i in (1, 2, 1, 3)] + [("b", 1)], [("a", i) for i in (3, 4, 1, 2)], [("a", 4), ("b", 1)]]
    out, _ = replay(spark, tmp_path, [[(k, i, 0) for k, i in b] for b in batches], "k string, id long, at long", lambda d: timers.without_recent_repeats(d, "k", "id", last=3).drop("at"), "append")
    # of a: 1 2 3, then 4 (1 is forgotten), so 1 is new again (2 is forgotten), and 2 is
    assert [[x for x in b if x[0] == "a"] for b in out][:2] == [[("a", 1), ("a", 2), ("a", 3)], [("a", 1), ("a", 2), ("a", 4)]]
    assert out[2:] in ([], [[]]) or out[2] == []
