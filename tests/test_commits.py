"""Commits of several tables: whole or not at all, and nothing lost between writers."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from corvane.sources.commits import Append, Conflict, Replace, Store, Upsert, merged_keys


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_versions_and_tables(spark, store):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert store.version() == 0 and store.read("t") is None and store.meta() == {}
    assert store.commit(0, {"batch": 3}, t=Append(a), u=Replace(a)) == 1
    assert store.commit(1, {"more": "x"}, t=Append(a.where("k = 1")), u=Replace(a.where("k = 2"))) == 2
    assert rows(store.read("t")) == [(1, "a"), (1, "a"), (2, "b")] and rows(store.read("u")) == [(2, "b")]
    assert rows(store.read("t", 1)) == rows(store.read("u", 1)) == [(1, "a"), (2, "b")]
    assert store.meta() == {"batch": 3, "more": "x"} and store.meta(1) == {"batch": 3}
    store.commit(2, t=Replace(a.where("false")))
    assert rows(store.read("t")) == [] and store.read("t").columns == ["k", "v"]


def test_of_two_writers_one_begins_anew(spark, store):
    one, two = (spark.createDataFrame([(k, w)], "k long, w string") for k, w in ((1, "one"), (2, "two")))
    store.commit(0, t=Append(one.where("false")))
    base = store.version()
    store.commit(base, t=Append(one))
    before = len(store._fs.listStatus(store._at("data")))
    with pytest.raises(Conflict):
        store.commit(base, t=Append(two))
    assert rows(store.read("t")) == [(1, "one")] and len(store._fs.listStatus(store._at("data"))) == before
    store.update(lambda s, v: {"t": Append(two)})
    assert rows(store.read("t")) == [(1, "one"), (2, "two")]


def test_interleaved_writers_lose_no_key(spark, store):
    """A second writer commits between the first one's reading and its commit, and several write at once."""
    part = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.lit(f"{a}").alias("w"))
    seen = []

    def change(s, version):
        there = s.read("log", version)
        new = part(0, 10) if there is None else part(0, 10).join(there, "k", "left_anti")
        if not seen:
            merged_keys(Store(spark, s.path), "log", part(5, 15), ["k"])
        seen.append(version)
        return {"log": Append(new)}

    store.update(change)
    assert seen == [0, 1]
    assert rows(store.read("log")) == sorted([(k, "0") for k in range(5)] + [(k, "5") for k in range(5, 15)], key=str)
    writers = [threading.Thread(target=lambda i=i: merged_keys(Store(spark, store.path), "log", part(20 + 10 * i, 32 + 10 * i), ["k"])) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(r.k for r in store.read("log").collect()) == [*range(15), *range(20, 62)]


def test_upserts_touch_their_buckets_alone(spark, store):
    every = spark.range(500).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    store.commit(0, t=Upsert(every.union(spark.createDataFrame([(None, "none")], "k long, v string")), ["k"], 16))
    before = store._manifest(1)["tables"]["t"]["folders"]
    new = spark.createDataFrame([(7, "new"), (9_000, "more"), (None, "now")], "k long, v string")
    store.commit(1, t=Upsert(new, ["k"]))
    after = store._manifest(2)["tables"]["t"]["folders"]
    assert sum(before.get(b) != f for b, f in after.items()) <= 3
    want = {k: "old" for k in range(500)} | {7: "new", 9_000: "more", None: "now"}
    assert {r.k: r.v for r in store.read("t").collect()} == want and store.read("t").count() == len(want)
    with pytest.raises(ValueError, match="repeat"):
        store.commit(2, t=Upsert(new.union(new), ["k"]))
    assert store.version() == 2


def test_a_run_that_dies_leaves_the_version_before(spark, store, monkeypatch):
    a = spark.createDataFrame([(1, "a")], "k long, v string")
    store.commit(0, t=Replace(a))

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_create", dies)
        with pytest.raises(KeyboardInterrupt):
            store.commit(1, t=Replace(a.union(a)))
    assert store.version() == 1 and rows(store.read("t")) == [(1, "a")]


def test_sweep_keeps_what_versions_name(spark, store):
    for i in range(4):
        store.commit(i, t=Replace(spark.createDataFrame([(i,)], "k long")))
    a = store.path + "/data/orphan"
    spark.range(1).write.parquet(a)
    assert store.sweep(keep=2) == 0  # nothing is old enough
    assert store.sweep(keep=2, older_than_ms=-60_000) == 3
    assert rows(store.read("t")) == [(3,)] and rows(store.read("t", 3)) == [(2,)]
