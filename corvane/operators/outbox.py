"""A durable outbox: entries added once, answers that settle or delay them, one bounded sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import backoff_ms

# Answers after which an entry is dropped, the cap, a sweep's size and its breaker.
DROPPED = ("no_such_post", "mxc_mapped_elsewhere")
CAP, BATCH, BREAKER = 5_000, 200, 5


def answer_class(accepted: Column, reason: Column, status: Column) -> Column:
    """accepted, a reason to drop, 404, 403, retry, or unreadable."""
    verdict = accepted.isNotNull()
    return (
        F.when(verdict & accepted, "accepted")
        .when(verdict & reason.isin(*DROPPED), reason)
        .when(verdict, "unreadable")
        .when(status == 404, "404")
        .when(status.isin(401, 403), "403")
        .when(status.isNull() | (status >= 500), "retry")
        .otherwise("unreadable")
    )


def conflict_class(status: Column, reason: Column) -> Column:
    """kept, raw-md5-conflict, raw-md5-mismatch or failed."""
    known = F.when(reason == "poster_mismatch", "kept").when(reason == "raw_md5_conflict", "raw-md5-conflict").when(reason == "raw_md5_mismatch", "raw-md5-mismatch")
    return F.coalesce(F.when(status == 409, known), F.lit("failed"))


def added(outbox: DataFrame, new: DataFrame, key: list[str], at: Column, cap: int = CAP) -> DataFrame:
    """The outbox with new reports: one that is there already changes nothing, and past the
    cap further ones are refused, in order of their keys. Adds ``state``: held, queued, refused."""
    fresh = new.select(*key).distinct().join(outbox.select(*key), key, "left_anti")
    held = outbox.agg(F.count("*").alias("held"))
    # only as many as the cap may come in: a top-k, not a sort of all rows in one task
    first = fresh.orderBy(*key).limit(cap).withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*key)))
    taken = first.join(F.broadcast(held)).where(F.col("i") <= cap - F.col("held")).select(*key, F.lit("queued").alias("state"))
    rows = fresh.join(taken, key, "left").withColumn("state", F.coalesce("state", F.lit("refused")))
    rows = rows.select(*key, at.alias("queued_at"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("string").alias("last_class"), at.alias("next_try_at"), "state")
    return outbox.withColumn("state", F.lit("held")).unionByName(rows)


def settled(outbox: DataFrame, answers: DataFrame, key: list[str], now: Column) -> DataFrame:
    """The outbox after answers (key, cls): accepted and dropped entries go, others wait longer."""
    rows = outbox.join(answers.select(*key, "cls"), key, "left").where(F.col("cls").isNull() | ~F.col("cls").isin("accepted", *DROPPED))
    tried = F.col("cls").isNotNull()
    attempts = F.col("attempts") + tried.cast("int")
    next_try = F.when(tried, now + backoff_ms(attempts)).otherwise(F.col("next_try_at"))
    return rows.withColumn("next_try_at", next_try).withColumn("attempts", attempts).withColumn("last_class", F.coalesce("cls", "last_class")).drop("cls")


def sweep(outbox: DataFrame, now: Column, order: list[str], batch: int = BATCH, breaker: int = BREAKER) -> DataFrame:
    """The rows of one pass, in order, from ``cls``, the answer each would get: the first
    ``batch`` due ones, up to the ``breaker``-th unanswered one in a row."""
    due = outbox.where(F.coalesce(F.col("next_try_at") <= now, F.lit(True))).orderBy(*(F.col(c).asc_nulls_first() for c in order)).limit(batch)
    w = Window.partitionBy(F.lit(0)).orderBy(*(F.col(c).asc_nulls_first() for c in order))  # at most ``batch`` rows
    rows = due.withColumn("i", F.row_number().over(w)).withColumn("run", F.count_if(F.col("cls") != "retry").over(w))
    rows = rows.withColumn("silent", F.when(F.col("cls") == "retry", F.row_number().over(Window.partitionBy("run", F.col("cls") == "retry").orderBy("i"))).otherwise(0))
    stop = F.min(F.when(F.col("silent") >= breaker, F.col("i"))).over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("i") <= F.col("stop"))).drop("run", "stop")


def severity(over_24h: Column, depth: Column, cap: int = CAP) -> Column:
    """null for an empty outbox, error if anything is a day old or it is four fifths full, else warn."""
    return F.when(depth == 0, None).when((over_24h > 0) | (depth >= 0.8 * cap), "error").otherwise("warn")
