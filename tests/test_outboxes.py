"""An outbox against a plain one, pass by pass; publications and layouts that can be stopped half way."""

from __future__ import annotations

import glob
import random
import shutil

import pytest
from pyspark.sql import functions as F

from corvane.operators import outbox, scans
from corvane.sources import sinks
from corvane.sources.commits import Store
from corvane.streaming import outboxes

WAIT = [0, 600_000, 1_200_000, 2_400_000, 4_800_000, 7_200_000, 7_200_000, 7_200_000]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain_pass(box, answers, now, batch, breaker, budget):
    due = sorted((k for k, e in box.items() if e[3] is None or e[3] <= now), key=lambda k: (box[k][3] or 0, box[k][0], k))
    sent, spent, silent, stopped = [], 0, 0, None
    for k in due[:batch]:
        if spent > budget:
            stopped = "budget"
            break
        cls, took = answers[k]
        sent.append(k)
        spent += took
        silent = silent + 1 if cls == "retry" else 0
        if cls in ("accepted", *outbox.DROPPED):
            del box[k]
        else:
            q, n, _, _ = box[k]
            box[k] = (q, n + 1, cls, now + WAIT[n + 1])
        if silent >= breaker:
            stopped = "unanswered"
            break
    return len(due), len(sent), stopped


def test_passes_like_a_plain_outbox(spark, tmp_path):
    r, store, box = random.Random(4), Store(spark, str(tmp_path / "box")), {}
    for now in range(0, 3_000_000, 500_000):
        new = [(r.randrange(1, 6), f"m{r.randrange(6)}") for _ in range(12)]
        fresh = sorted(set(new) - set(box))
        room = max(0, 15 - len(box))
        said = outboxes.report(store, spark.createDataFrame([*new, (0, "m"), (3, "")], "post_id long, mxc string"), now, cap=15)
        assert said == {"queued": len(fresh[:room]), "refused": len(fresh[room:])}
        box |= {k: (now, 0, None, now) for k in fresh[:room]}
        answers = {(p, f"m{m}"): (r.choice(["accepted", "no_such_post", "404", "retry", "retry", "retry"]), r.randrange(1, 9)) for p in range(1, 6) for m in range(6)}
        told = spark.createDataFrame([(*k, *a) for k, a in answers.items()], "post_id long, mxc string, cls string, took int")
        batch, breaker, budget = r.choice([(200, 5, 1_000), (4, 5, 1_000), (200, 2, 1_000), (200, 50, 12)])
        tally = outboxes.flush(store, lambda due, told=told: due.join(told, outboxes.KEY), now, batch, breaker, budget)
        assert (tally.get("due", 0), tally.get("sent", 0), tally.get("stopped")) == plain_pass(box, answers, now, batch, breaker, budget)
        assert rows(store.read("outbox").select("post_id", "mxc", "queued_at", "attempts", "last_class", "next_try_at")) == sorted([(*k, *e) for k, e in box.items()], key=str)
    some = sorted(box)[:2]
    outboxes.answered(store, spark.createDataFrame([(*some[0], "accepted"), (*some[1], "403"), (99, "gone", "403")], "post_id long, mxc string, cls string"), 9)
    assert store.read("outbox").count() == len(box) - 1


def test_writers_of_one_outbox_lose_nothing(spark, tmp_path):
    store, other = (Store(spark, str(tmp_path / "box")) for _ in range(2))
    report = lambda s, a: outboxes.report(s, spark.range(a, a + 5).select(F.col("id").alias("post_id"), F.lit("m").alias("mxc")), a)
    report(store, 1)

    def ask(due):
        if other.version() == 1:  # while the first one asks, a second one reports
            report(other, 20)
        return due.withColumns({"cls": F.lit("404"), "took": F.lit(0)})

    outboxes.flush(store, ask, 10)
    got = {r.post_id: r.attempts for r in store.read("outbox").collect()}
    assert set(got) == {*range(1, 6), *range(20, 25)} and all(got[p] == 1 for p in range(1, 6))


def test_entries_are_published_once_and_whole(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    with pytest.raises(FileNotFoundError):
        sinks.publish_entry(df, str(tmp_path / "queue"), "one")
    assert not (tmp_path / "queue").exists()
    (tmp_path / "queue" / "ready").mkdir(parents=True)
    with pytest.raises(ValueError):
        sinks.publish_entry(df, str(tmp_path / "queue"), "../one")
    with monkeypatch.context() as m:
        m.setattr(sinks, "_rename", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            sinks.publish_entry(df, str(tmp_path / "queue"), "one")
    assert glob.glob(f"{tmp_path}/queue/ready/*") == []
    assert sinks.publish_entry(df, str(tmp_path / "queue"), "one") and not sinks.publish_entry(df.union(df), str(tmp_path / "queue"), "one")
    assert not sinks._rename(spark, f"{tmp_path}/queue/ready/one", f"{tmp_path}/queue/ready/one")
    assert rows(spark.read.json(f"{tmp_path}/queue/ready/one")) == [(1, "a")] and glob.glob(f"{tmp_path}/queue/staging/*") == []


def test_a_table_that_is_replaced_half_way_is_still_there(spark, tmp_path, monkeypatch):
    old, new = (spark.createDataFrame([(1, v)], "k long, v string") for v in ("old", "new"))
    path, real = str(tmp_path / "t"), sinks._rename
    sinks.replace(old, path)
    for at in (1, 2):  # the first or the second rename never comes
        calls = []

        def dies(*a, at=at, calls=calls):
            calls.append(a)
            if len(calls) == at:
                raise KeyboardInterrupt
            return real(*a)

        with monkeypatch.context() as m:
            m.setattr(sinks, "_rename", dies)
            with pytest.raises(KeyboardInterrupt):
                sinks.upsert(new, path, "k")
        assert rows(sinks.stored(spark, path)) == [(1, "old")]
    assert sinks.upsert(new, path, "k") == 1 and rows(sinks.stored(spark, path)) == [(1, "new")]
    with pytest.raises(ValueError, match="repeat"):
        sinks.upsert(new.union(old), path, "k")
    assert len(glob.glob(f"{tmp_path}/t*")) == 1


def test_files_of_denied_partitions_are_not_opened(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 5).alias("room"), "id")
    path = str(tmp_path / "by-room")
    scans.layout(df, path, "room")
    denied = spark.createDataFrame([(1,), (3,), (None,)], "room long")
    table = spark.read.schema(df.schema).parquet(path)
    found = scans.undenied(table, "room", denied)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "room" in plan.split("PartitionFilters:")[1][:120]
    joined = scans.undenied(table, "room", denied, most=1)
    assert rows(joined.select("room", "id")) == rows(found.select("room", "id"))
    for f in glob.glob(f"{path}/room=[13]/*.parquet"):  # what is left out cannot be missed
        with open(f, "wb") as broken:
            broken.write(b"not a table")
    assert sorted(r.id for r in found.collect()) == [i for i in range(100) if i % 5 not in (1, 3)]
    shutil.rmtree(path)
