"""Windows by stretches of time give what plain windows over the key give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import rollup, scans, sets, snapshots, writes


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(3)
    rows = [(i, "hot" if r.random() < 0.5 else f"u{r.randrange(9)}", r.randrange(0, 4_000), r.choice(["ok", "ok", "bad"])) for i in range(1500)]
    return spark.createDataFrame([*rows, (2000, None, 5, "bad"), (2001, "one", 7, "bad")], "id long, k string, at long, kind string")


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_previous_and_runs(events):
    stretch = F.floor(F.col("at") / 100)
    keyed = events.where("k is not null")
    assert rows(rollup.with_previous(keyed, "k", ["at", "id"], "kind", stretch)) == rows(rollup.with_previous(keyed, "k", ["at", "id"], "kind"))
    failed = F.col("kind") == "bad"
    assert rows(rollup.runs(keyed, "k", ["at", "id"], failed, stretch)) == rows(rollup.runs(keyed, "k", ["at", "id"], failed))


def test_trailing(events):
    w = Window.partitionBy("k").orderBy("at").rangeBetween(-99, 0)
    want = events.withColumn("used", F.count("*").over(w))
    got = rollup.trailing(events, "k", "at", 100, 20)
    assert rows(got.drop("remaining")) == rows(want)
    assert got.where("remaining <> greatest(0, 20 - used)").count() == 0


def test_pages_of_one_generation(spark):
    schema = "g int, page int, low int, high int"
    good = [(1, 0, 1, 5), (1, 1, 6, 9), (2, 0, 1, 5), (2, 2, 8, 9), (3, 0, 1, 5), (3, 1, 4, 9)]
    df = spark.createDataFrame(good, schema)
    assert {r.g for r in scans.consistent(df, "g", "page", "low", "high").collect()} == {1}
    assert scans.consistent(df.where("g > 1"), "g", "page", "low", "high").count() == 0


def test_lists_and_writes(spark):
    df = spark.createDataFrame([(["a", "b", "a", "no_train"], ["b", "c"], ["m"])], "creator array<string>, auto array<string>, meta array<string>")
    p = df.select(sets.provenance(F.col("creator"), F.col("auto"), F.col("meta"), ["no_train"]).alias("p")).first().p
    assert (p.both, p.auto_only, p.creator_only, p.spectrum) == (["b"], ["c"], ["a", "a"], ["c", "b", "m"])
    assert not set(p.creator_only) & set(p.spectrum)
    sent = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 4, False)], "k string, at int, bad boolean")
    assert [r.state for r in writes.until_refused(sent, "k", "at", F.col("bad")).orderBy("at").collect()] == ["sent", "failed", "left out", "sent"]


@pytest.fixture(scope="module")
def odd(spark):
    """A hot key, a null key, and rows without a time."""
    r = random.Random(5)
    data = [(i, None if r.random() < 0.1 else "hot" if r.random() < 0.5 else f"u{r.randrange(4)}", None if r.random() < 0.1 else r.randrange(0, 2_000), r.choice(["ok", "bad", "bad", "arm", "use"])) for i in range(600)]
    return spark.createDataFrame(data, "id long, k string, at long, kind string")


def test_a_stretch_changes_no_row(odd):
    order, stretch, failed = ["at", "id"], F.floor(F.col("at") / 100), F.col("kind") == "bad"
    same = lambda f: rows(f(stretch)) == rows(f(None))
    assert same(lambda s: rollup.with_previous(odd, "k", order, "kind", s)) and rollup.with_previous(odd, "k", order, "kind", stretch).count() == 600
    assert same(lambda s: rollup.runs(odd, "k", order, failed, s))
    assert same(lambda s: rollup.until_failures(odd, "k", order, failed, 3, s))
    # with ids as times every row has one
    assert same(lambda s: rollup.armed(odd, "k", ["id"], F.col("kind") == "arm", F.col("kind") == "use", "9", None if s is None else F.floor(F.col("id") / 20)))
    polls = odd.select("k", "id", "at", F.when(failed, 200).when(F.col("kind") == "ok", 304).otherwise(500).alias("status"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("generation"))
    assert same(lambda s: snapshots.polled(polls, "k", order, s))


def test_until_failures_against_a_loop(odd):
    want = {}
    for r in sorted(odd.collect(), key=lambda r: (r.at is not None, r.at or 0, r.id)):
        sent, run, stopped = want.get(r.k, (0, 0, False))
        if not stopped:
            run = run + 1 if r.kind == "bad" else 0
            want[r.k] = (sent + 1, run, run >= 3)
    got = rollup.until_failures(odd, "k", ["at", "id"], F.col("kind") == "bad", 3, F.floor(F.col("at") / 50))
    assert {r.k: (r.sent, r.stopped) for r in got.collect()} == {k: (n, stopped) for k, (n, _, stopped) in want.items()}


def test_a_read_again_partition(spark):
    df = spark.createDataFrame([(["a", "no_train", "b", "b"], ["new"], {"auto": ["a"], "both": ["c", "a"], "meta": ["m", "new"]}), (None, None, None)], "creator array<string>, meta array<string>, stored map<string,array<string>>")
    p, none = (r.p for r in df.select(sets.reread(F.col("creator"), F.col("meta"), F.lit(None).cast("array<string>"), F.col("stored"), ["no_train"]).alias("p")).collect())
    assert (p.creator, p.auto, p.both, p.meta, p.oc, p.replace_creator) == (["b", "b"], ["c"], ["a"], ["m", "new"], [], True)
    assert (none.creator, none.auto, none.both, none.meta, none.oc) == ([], [], [], [], [])
