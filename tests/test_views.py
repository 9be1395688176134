"""A view that follows a list: deltas end where one projection ends, what left the list comes back, what waits is drained."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.operators import snapshots
from corvane.sources.commits import Store, Upsert
from corvane.streaming import views

STATE = "room string, mxc string, post_id long, tags array<string>, rating string, sources map<string,array<string>>"
POSTS = "post_id long, mxc string, md5 string, flagged boolean, banished boolean"
KNOWN = "post_id long, p_tags array<string>, p_sources map<string,array<string>>, legacy array<string>, failed boolean"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    own = Store(spark, str(tmp_path / "store"))
    views.stored(own, spark.createDataFrame([(r, f"m{p}", p, ["cat", "bad", f"own{p}"], "s", {"auto": ["bad", "cat"]}) for r in ("a", "b") for p in range(1, 7)] + [("a", "m9", None, ["bad"], "s", {})], STATE))
    return own


def posts(spark, *some):
    return spark.createDataFrame([(p, f"m{p}", f"h{p}", True, False) for p in some], POSTS)


def names(spark, *some):
    return spark.createDataFrame([(n,) for n in some], "name string")


def known(spark, failed=()):
    return spark.createDataFrame([(p, [f"tag{p}", "bad", "worse"] if p != 6 else [], {"auto": ["bad", f"tag{p}"]}, ["legacy6", "bad"] if p == 6 else None, p in failed) for p in (1, 2, 3, 4, 6, 9)], KNOWN)


def visible(spark, *some):
    return spark.createDataFrame([(p, [f"seen{p}", "bad"], "q") for p in some], "post_id long, legacy array<string>, rating string")


def state(store):
    return {(r.room, r.mxc): (r.post_id, r.tags) for r in store.read("state").collect()}


def test_two_changes_are_one_projection(spark, store, tmp_path):
    none = visible(spark)
    one = views.tick(store, known(spark), none, 0, "ok", generation="1", names=names(spark, "bad"), posts=posts(spark, 1, 2, 5, 6, 9))
    assert one["projected"] == {"write": 9, "current": 0, "left": 0, "failed": 0, "complete": True}
    got = state(store)
    assert got["a", "m1"] == (1, ["tag1", "worse"]) and got["a", "m6"] == (6, ["legacy6"]) and got["a", "m5"] == (5, ["cat", "own5"])
    assert got["a", "m9"] == (9, ["tag9", "worse"]) and got["b", "m3"] == (3, ["cat", "bad", "own3"])
    # the same names: only posts that joined or left are touched, and one that left is as its post says again
    two = views.tick(store, known(spark), none, 5, "ok", generation="2", names=names(spark, "bad"), posts=posts(spark, 2, 3, 5, 6, 9))
    assert two["projected"] == {"write": 2, "current": 2, "left": 0, "failed": 0, "complete": True}
    # other names: all of both lists
    views.tick(store, known(spark), none, 9, "ok", generation="3", names=names(spark, "worse"), posts=posts(spark, 2, 3))
    got = state(store)
    assert got["b", "m2"] == (2, ["tag2", "bad"]) and got["a", "m6"] == (6, ["legacy6", "bad"]) and got["a", "m9"] == (9, ["tag9", "bad"])
    assert got["a", "m1"] == (1, ["tag1", "worse"])  # left with the second change, which did not have that name
    again = views.tick(store, known(spark), none, 10, "not-modified")
    assert again["read"] == "not-modified" and again["projected"] is None


def test_an_incomplete_projection_is_owed_again(spark, store):
    first = views.tick(store, known(spark, failed=(2,)), visible(spark), 0, "ok", generation="1", names=names(spark, "bad"), posts=posts(spark, 1, 2))
    assert first["projected"]["failed"] == 2 and not first["projected"]["complete"]
    assert state(store)["a", "m2"] == (2, ["cat", "own2"]) and not views.owed(store, 1) and views.owed(store, views.RETRY_MS)
    again = views.tick(store, known(spark), visible(spark), views.RETRY_MS, "not-modified")
    assert again["projected"]["complete"] and state(store)["a", "m2"] == (2, ["tag2", "worse"])
    assert not views.owed(store, views.RETRY_MS + 1)


def test_held_writes_wait_for_a_fresh_list(spark, store):
    held = spark.createDataFrame([("c", "m1", 1, ["x", "bad"], "s", {"auto": ["bad"]}), ("c", "m5", 5, ["y", "bad"], "s", {"auto": ["bad", "z"]}), ("shut", "m5", 5, ["y"], "s", {})], STATE)
    views.waits(store, "held", held, 1)
    views.waits(store, "held", held.limit(1), 2)
    assert store.read("held").count() == 3
    assert views.drain_held(store, known(spark), 3) == 0 and views.refresh(store, "error", 3) == "unreadable"
    views.refresh(store, "ok", 3, "1", names(spark, "bad"), posts(spark))
    assert not views.is_fresh(store, 3 + views.FRESH_MS) and views.drain_held(store, known(spark), 3 + views.FRESH_MS) == 0
    assert views.drain_held(store, known(spark), 4, spark.createDataFrame([("shut",)], "room string")) == 2
    got = state(store)
    assert got["c", "m1"] == (1, ["tag1", "worse"]) and got["c", "m5"] == (5, ["y"]) and ("shut", "m5") not in got
    assert store.read("held").count() == 0


def test_parked_rows_are_drained(spark, store, monkeypatch):
    parked = spark.createDataFrame([("d", f"m{p}", p, f"h{p}", "s") for p in (1, 2, 3, 4, 6)], "room string, mxc string, post_id long, md5 string, rating string")
    views.waits(store, "parked", parked, 1)
    listed = posts(spark, 1).union(spark.createDataFrame([(2, "m2", "h2", False, True)], POSTS))
    views.refresh(store, "ok", 2, "1", names(spark, "bad"), listed)
    assert views.drain_parked(store, known(spark, failed=(4,)), visible(spark, 4, 6), 3) == 1
    assert state(store)["d", "m6"] == (6, ["seen6"]) and rows(store.read("parked").select("post_id")) == [(1,), (4,)]
    assert [r.rating for r in store.read("state").where("room = 'd'").collect()] == ["q"]
    views.refresh(store, "ok", 5, "2", names(spark, "bad"), posts(spark))
    assert views.drain_parked(store, known(spark), visible(spark, 1, 4), 6) == 2 and store.read("parked").count() == 0
    assert state(store)["d", "m4"] == (4, ["tag4", "worse"])
    monkeypatch.setattr(views, "WAITING", 3)
    for i in range(5):
        views.waits(store, "parked", parked.where(F.col("post_id") == i + 1).withColumn("room", F.lit("e")), 10 + i)
    assert rows(store.read("parked").select("post_id")) == [(2,), (3,), (4,)]  # there is no post 5


def test_rows_without_a_post_are_not_brought_together(spark):
    posts = spark.createDataFrame([(p, f"m{p}") for p in range(4)], "post_id long, mxc string")
    state = spark.createDataFrame([("a", f"m{i}", None if i % 3 else i, ["bad"], "s", {}) for i in range(40)], STATE)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = snapshots.reprojected(state, posts, known(spark), F.array(F.lit("bad")))
        plan = got._jdf.queryExecution().executedPlan().toString()
        # what is exchanged by a post is exchanged by one that is there
        assert "hashpartitioning(post_id" not in plan and "isnotnull(coalesce(post_id" in plan
        assert rows(got.select("mxc", "post_id", "source")) == [("m0", 0, "own"), ("m1", 1, "projection"), ("m2", 2, "projection"), ("m3", 3, "projection")]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    own = Store(spark, str(tmp_path / "one"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        own.update(lambda s, v: {"rows": Upsert(spark.range(100_000).withColumn("x", F.sha2(F.col("id").cast("string"), 256)), ["id"], 1)})
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert own.read("rows").count() == 100_000 and len(own.read("rows").inputFiles()) > 4
