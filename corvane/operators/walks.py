"""Walks over the history of partitions: what to do next, and the checkpoint after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A failure is retried up to this many attempts.
MAX_ATTEMPTS = 5


def retryable(failed: Column) -> Column:
    """Failures with an event id and attempts left."""
    return F.filter(F.coalesce(failed, F.array()), lambda f: f["event_id"].isNotNull() & (F.coalesce(f["attempts"], F.lit(0)) < MAX_ATTEMPTS))


def plan(trigger: Column, restart: Column, head: Column, cursor: Column, reached_start: Column, failed: Column) -> Column:
    """initial, resume, gap, retry or skip, from a partition's checkpoint and what asks for the walk."""
    done = F.coalesce(reached_start, F.lit(False))
    walked = done | cursor.isNotNull() | head.isNotNull()
    return (
        F.when(F.coalesce(restart, F.lit(False)) | ~walked, "initial")
        .when(trigger == "command", F.when(done, "initial").otherwise("resume"))
        .when((trigger == "rejoin") & head.isNotNull(), "gap")
        .when(~done, "resume")
        .when(F.size(retryable(failed)) > 0, "retry")
        .otherwise("skip")
    )


def next_state(df: DataFrame) -> DataFrame:
    """The checkpoint after a run, from columns of the saved one (head, cursor, reached_start,
    abandoned), the plan, and the run's result (pages, r_head, r_cursor, r_reached_start, failures).

    Progress only goes forward: a gap moves the head, and only once it is closed; a
    resume moves the cursor; a run without a page moves nothing. Of failures of one event
    the one with most attempts counts, the first of equals; those out of attempts are abandoned.
    """
    paged, initial = F.col("pages") > 0, F.col("plan") == "initial"
    older = paged & F.col("plan").isin("initial", "resume")
    head = F.when(initial & paged, F.coalesce("r_head", "head")).when((F.col("plan") == "gap") & F.coalesce("r_reached_start", F.lit(False)) & F.col("r_head").isNotNull(), F.col("r_head")).otherwise(F.col("head"))
    failures = F.coalesce("failures", F.array().cast(df.schema["failures"].dataType))
    key = lambda f: F.coalesce(f["event_id"].cast("string"), f["url"])

    def beaten(f: Column, i: Column) -> Column:
        return F.exists(F.zip_with(failures, F.sequence(F.lit(0), F.greatest(F.size(failures) - 1, F.lit(0))), lambda g, j: (key(g) == key(f)) & ((g["attempts"] > f["attempts"]) | ((g["attempts"] == f["attempts"]) & (j < i)))), lambda x: F.coalesce(x, F.lit(False)))

    best = F.filter(failures, lambda f, i: ~beaten(f, i))
    spent = lambda f: f["event_id"].isNotNull() & (f["attempts"] >= MAX_ATTEMPTS)
    return df.select(
        *(c for c in df.columns if c not in ("head", "cursor", "reached_start", "abandoned", "failures", "pages", "r_head", "r_cursor", "r_reached_start")),
        head.alias("head"),
        F.when(older, F.col("r_cursor")).otherwise(F.col("cursor")).alias("cursor"),
        F.coalesce(F.when(older, F.col("r_reached_start")).otherwise(F.col("reached_start")), F.lit(False)).alias("reached_start"),
        F.filter(best, lambda f: ~spent(f)).alias("failed"),
        F.concat(F.coalesce("abandoned", F.array().cast(df.schema["failures"].dataType)), F.filter(best, spent)).alias("abandoned"),
    )


def summary(done: Column, **parts: Column) -> Column:
    """One line: how many are done, and each other count that is not zero, by its name."""
    said = [F.when(c > 0, F.concat_ws(" ", c.cast("string"), F.lit(name.replace("_", " ")))) for name, c in parts.items()]
    return F.concat_ws(", ", F.concat_ws(" ", done.cast("string"), F.lit("done")), *said)


def watermarks(messages: DataFrame, key: str, ident: str, transient: Column, withheld: Column) -> DataFrame:
    """How far each partition got: up to the message before the first that failed for now or was
    withheld. Two aggregations, the first combined before its exchange; no ordered window."""
    stop = F.min(F.when(transient | withheld, F.struct(F.col(ident), F.when(withheld, "withheld").otherwise("transient").alias("why"))))
    stops = messages.groupBy(key).agg(stop.alias("stop"))
    seen = messages.select(key, ident).join(stops, key)
    before = F.col("stop").isNull() | (F.col(ident) < F.col("stop")[ident])
    return seen.groupBy(key).agg(F.max(F.when(before, F.col(ident))).alias("watermark"), F.count_if(before).alias("messages"), F.max(F.col("stop")["why"]).alias("stopped"))


def carried_over(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows of this pass, and of the one before those of partitions that this one has not reached."""
    old = before.join(now.select(key), key, "left_anti")
    return now.withColumn("from_pass", F.lit("this")).unionByName(old.withColumn("from_pass", F.lit("previous")))


def needing_work(checkpoints: DataFrame, now: Column, recent_ms: int = 300_000) -> DataFrame:
    """Partitions that are not done or owe a retry, without those walked just now."""
    recent = F.coalesce(now - F.col("last_run_at") < recent_ms, F.lit(False))
    return checkpoints.where(~recent & (~F.coalesce("reached_start", F.lit(False)) | (F.size(retryable(F.col("failed"))) > 0)))


def late_events(walked: DataFrame, events: DataFrame, gone: DataFrame, key: str, ident: str) -> DataFrame:
    """Events after the head that a walk left, with ``dropped`` for those that are gone by now.

    ``walked(key, head)``; ``gone(ident)``.
    """
    rows = events.join(walked, key).where(F.col("head").isNull() | (F.col(ident) > F.col("head")))
    return rows.join(gone.select(ident, F.lit(True).alias("g")).distinct(), ident, "left").withColumn("dropped", F.coalesce("g", F.lit(False))).drop("g", "head")
