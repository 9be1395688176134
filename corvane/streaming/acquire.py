"""Acquisition of messages and their parts, partition by partition, as a stream.

A message counts once all its parts are delivered, held already or refused; then the
partition's watermark moves to it. A part that fails for now, or a message whose content
is withheld, stops its partition there: the watermark stays, later messages wait, other
partitions go on. What waits is tried again with every micro-batch. Watermarks, waiting
messages and the log of outcomes change in one commit that bears the micro-batch's
number, so one that is replayed writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.sources.commits import Append, Replace, Store, Upsert

#: A part that failed for now; the others are posted, held (there already) and refused.
TRANSIENT = "transient"


def _first_transient(parts: Column) -> Column:
    """Place of the first part that failed for now, from 1; 0 if none did."""
    return F.coalesce(F.array_position(F.transform(parts, lambda p: p["status"]), TRANSIENT), F.lit(0))


def steps(messages: DataFrame, marks: DataFrame | None, key: str, ident: str) -> DataFrame:
    """Messages after their partition's watermark, with ``state``: done, the one that ``stopped`` it, or waiting; and ``why``.

    ``messages(key, ident, own, withheld, parts)``, parts of (part, status, why); messages
    of the reader's own pass without a look at their parts. ``marks(key, after)`` may be
    None; a null ``after`` is before everything. One aggregation, combined before its
    exchange, finds where each partition stops; there is no ordered window.
    """
    if marks is not None:
        messages = messages.join(marks.select(key, "after"), key, "left").where(F.col("after").isNull() | (F.col(ident) > F.col("after"))).drop("after")
    failed = ~F.col("own") & (_first_transient(F.col("parts")) > 0)
    why = F.when(F.col("withheld"), "withheld").when(failed, TRANSIENT)
    stops = messages.where(why.isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(ident).alias("at"), why.alias("why"))).alias("stop"))
    state = F.when(F.col("stop").isNull() | (F.col(ident) < F.col("stop.at")), "done").when(F.col(ident) == F.col("stop.at"), "stopped").otherwise("waiting")
    return messages.join(stops, key, "left").withColumn("state", state).withColumn("why", F.col("stop.why")).drop("stop")


def outcomes(stepped: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, ident, part, status, why) of every part that was dealt with: those of done messages, and those before
    the part that stopped a message."""
    parts = F.when(F.col("state") == "done", F.col("parts")).when((F.col("state") == "stopped") & ~F.col("withheld"), F.slice("parts", F.lit(1), F.greatest(_first_transient(F.col("parts")) - 1, F.lit(0)).cast("int")))
    return stepped.where(~F.col("own")).select(key, ident, F.explode(parts).alias("p")).select(key, ident, "p.*")


def marked(stepped: DataFrame, marks: DataFrame | None, key: str, ident: str) -> DataFrame:
    """(key, after, messages, stopped) of each partition: a watermark that does not move keeps its value."""
    done = F.col("state") == "done"
    new = stepped.groupBy(key).agg(F.max(F.when(done, F.col(ident))).alias("reached"), F.count_if(done).alias("messages"), F.max(F.when(~done, F.col("why"))).alias("stopped"))
    if marks is None:
        return new.withColumnRenamed("reached", "after")
    both = new.join(marks.select(key, F.col("after").alias("was")), key, "left")
    return both.select(key, F.coalesce("reached", "was").alias("after"), "messages", "stopped")


def backward_pages(rows: DataFrame, key: str, page: str, ident: str) -> DataFrame:
    """Pages that begin at or before the end of an earlier page of their partition: a walk must stop at these.

    One row a page is ordered, not one a message.
    """
    from pyspark.sql import Window

    pages = rows.groupBy(key, page).agg(F.min(ident).alias("first"), F.max(ident).alias("last"))
    before = F.max("last").over(Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("before", before).where(F.col("first") <= F.col("before"))


def acquire(store: Store, batch: DataFrame, number: int, deliver: Callable[[DataFrame, int], DataFrame], key: str, ident: str) -> bool:
    """One micro-batch: its messages and those that wait, delivered, in one commit; False if that number is in already.

    ``deliver(messages, number)`` adds ``own``, ``withheld`` and ``parts``; a part that is
    delivered again must be ``held``, not posted twice.
    """
    version = store.version()
    if store.meta(version).get("batch", -1) >= number:
        return False
    marks, waiting = store.read("marks", version), store.read("waiting", version)
    messages = batch if waiting is None else batch.unionByName(waiting)
    stepped = steps(deliver(messages.dropDuplicates([key, ident]), number), marks, key, ident).persist()
    try:
        changed = marked(stepped, marks, key, ident)
        rest = stepped.where("state <> 'done'").select(batch.columns)
        store.commit(version, {"batch": number}, marks=Upsert(changed, [key], 16), waiting=Replace(rest), outcomes=Append(outcomes(stepped, key, ident).withColumn("batch", F.lit(number).cast("long"))))
    finally:
        stepped.unpersist()
    return True


def latest_outcomes(store: Store) -> DataFrame | None:
    """One row a part: its last outcome."""
    log = store.read("outcomes")
    if log is None:
        return None
    own = [c for c in log.columns if c != "part"]
    return log.groupBy("part").agg(F.max_by(F.struct(*own), F.col("batch")).alias("r")).select("part", "r.*")


def acquiring(stream: DataFrame, store: Store, deliver: Callable[[DataFrame, int], DataFrame], key: str, ident: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start ``acquire`` on every micro-batch of a stream of messages."""
    run = lambda batch, number: acquire(store, batch, number, deliver, key, ident)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
