"""A stream without what was taken back, and the walk that finds what came too late for it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from corvane.streaming import redactions

SCHEMA = "id long, at timestamp, takes long"


def at(minute):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minute)


def sides(df):
    return df.where("takes is null").select("id", "at"), df.where("takes is not null").select(F.col("takes").alias("id"), "at")


def land(spark, folder, batches, through):
    """Each batch lands and is streamed; the rows let through after each, and the last watermark."""
    out, until = [], None
    for batch in batches:
        spark.createDataFrame([(i, at(m), takes) for i, m, takes in batch], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        kept = redactions.kept(*sides(stream), "id", "at", "30 minutes", delay="5 minutes")
        q = kept.writeStream.format("parquet").option("path", through).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        until = redactions.settled_until(q) or until
        out.append(sorted(r.id for r in spark.read.schema("id long, at timestamp").parquet(through).collect()))
    return out, until


def test_stream_and_walk_give_what_a_batch_gives(spark, tmp_path):
    batches = [
        [(1, 0, None), (2, 1, None), (3, 2, None), (100, 10, 2), (101, 11, 2)],  # 2 is taken back, twice
        [(4, 100, None), (102, 40, 1), (104, 100, -1)],  # 1 is taken back only after half an hour
        [(5, 3, None), (6, 4, None), (7, 200, None), (103, 5, 6), (105, 200, -1)],  # 5 and 6 land late, and so does what takes 6 back
        [(8, 400, None), (106, 400, -1)],
    ]
    through = f"{tmp_path}/out"
    out, until = land(spark, tmp_path, batches, through)
    assert out[0] == [] and set(out[-1]) == {1, 3, 4, 7}
    landed, gone = sides(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    sent = spark.read.schema("id long, at timestamp").parquet(through)
    missed = redactions.missed(landed, sent, gone, "id", "at", "30 minutes", until)
    assert [r.id for r in missed.collect()] == [5]
    # 8 still waits: it is neither sent nor missed
    waits = {r.id for r in landed.collect()} - {r.id for r in redactions.settled(landed, "at", "30 minutes", until).collect()}
    assert waits == {8}


def test_nulls_and_repeats(spark):
    landed = spark.createDataFrame([(None, at(0), None), (1, None, None), (2, at(0), None), (2, at(0), None), (3, at(0), None)], SCHEMA)
    none = landed.where("false").select("id", "at")
    got = redactions.missed(landed.select("id", "at"), none, none.union(landed.where("id = 3").select("id", "at")), "id", "at", "1 minute", "2026-01-02")
    assert [r.id for r in got.collect()] == [2, 2]
