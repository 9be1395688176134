"""What a write would do to each row: keyed inserts and upserts with refusals, moves, checked publications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inserts(stored: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """Insert if absent: each incoming key is inserted, the same already, or refused because another value is there.

    Of incoming rows with one key the least value counts as the first.
    """
    new = incoming.groupBy(key).agg(F.min(value).alias("new"))
    rows = new.join(stored.select(key, F.col(value).alias("old")), key, "left")
    state = F.when(F.col("old").isNull(), "inserted").when(F.col("old") == F.col("new"), "same").otherwise("refused")
    return rows.select(key, "new", "old", state.alias("state"))


def uniquely(incoming: DataFrame, unique: str, ident: str) -> DataFrame:
    """Each row created, or the duplicate of the first one with its unique value. One aggregation and a join."""
    first = incoming.groupBy(unique).agg(F.min(ident).alias("of"))
    rows = incoming.join(first, unique)
    return rows.withColumn("state", F.when(F.col(ident) == F.col("of"), "created").otherwise("duplicate"))


def conditional_upserts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Records (md5, raw_md5, poster) against the stored ones, with ``state``.

    A null or equal poster replaces a record; another one leaves it (poster_mismatch); a
    raw digest that another record holds is refused (raw_md5_conflict), as is a record
    that names another raw digest than the stored one (raw_md5_mismatch).
    """
    old = stored.select("md5", F.col("raw_md5").alias("old_raw"), F.col("poster").alias("old_poster"), F.lit(True).alias("had"))
    holder = stored.where("raw_md5 is not null").groupBy("raw_md5").agg(F.min("md5").alias("holder"))
    rows = incoming.join(old, "md5", "left").join(holder, "raw_md5", "left")
    elsewhere = F.col("holder").isNotNull() & (F.col("holder") != F.col("md5"))
    state = (
        F.when(F.col("had") & F.col("poster").isNotNull() & ~F.col("poster").eqNullSafe(F.col("old_poster")), "poster_mismatch")
        .when(elsewhere, "raw_md5_conflict")
        .when(F.col("had") & (F.col("old_raw") != F.col("raw_md5")), "raw_md5_mismatch")
        .when(F.col("had"), "replaced")
        .otherwise("inserted")
    )
    return rows.withColumn("state", state).drop("old_raw", "old_poster", "had", "holder")


def repointed(index: DataFrame, wanted: DataFrame, key: str, md5: str, old: Column, new: Column) -> DataFrame:
    """What becomes of the wanted index rows: done where they name the old file, skipped where
    they name another one, failed where there is no row; ``md5`` after it."""
    rows = wanted.select(key).join(index.select(key, md5), key, "left")
    state = F.when(F.col(md5).isNull(), "failed").when(F.col(md5) == old, "done").otherwise("skipped")
    return rows.select(key, F.when(state == "done", new).otherwise(F.col(md5)).alias(md5), state.alias("state"))


def until_refused(rows: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """Each row sent, failed (the first of its partition) or left out after that failure.

    By one aggregation and a join, so that a large partition is no single task.
    """
    first = rows.groupBy(key).agg(F.min(F.when(failed, F.col(order))).alias("__first"))
    joined = rows.join(first, key)
    state = F.when(F.col("__first").isNull() | (F.col(order) < F.col("__first")), "sent").when(F.col(order) == F.col("__first"), "failed").otherwise("left out")
    return joined.withColumn("state", state).drop("__first")


def sidecars(rows: DataFrame, required: list[str], namespace: str, allowed: list[str], posted_at: Column) -> DataFrame:
    """Rows with ``ok`` and ``reason``, the first thing that is wrong: a required field that is
    missing or empty, an illegal namespace, an extension that is not allowed, no date."""
    reason = F.lit(None).cast("string")
    ext = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1))
    reason = F.when(posted_at.isNull(), "posted_at is not a date").otherwise(reason)
    reason = F.when(~ext.isin(allowed), "extension").otherwise(reason)
    reason = F.when(~F.col(namespace).rlike(r"^[a-z0-9]{1,10}\z"), "namespace").otherwise(reason)
    for c in reversed([*required, namespace, "filename"]):
        reason = F.when(F.coalesce(F.col(c) == "", F.lit(True)), f"{c} is missing").otherwise(reason)
    out = rows.withColumn("ext", ext).withColumn("reason", reason)
    return out.withColumn("ok", F.col("reason").isNull())


def alias_report(index: DataFrame, by_digest: DataFrame, by_raw: DataFrame, after: Column, stop: Column, size: int) -> DataFrame:
    """A page of index rows (key, md5, raw_md5, state) with what a report would say of each:
    STOP, ERR, KEEP (no post), DROP (a deleted row) or ALIAS with the post and how it was found."""
    page = index.where(after).orderBy("key").limit(size)
    one = by_digest.select("md5", F.col("post").alias("p1"))
    two = by_raw.select("raw_md5", F.col("post").alias("p2"))
    rows = page.join(one, "md5", "left").join(two, "raw_md5", "left")
    post = F.coalesce("p1", "p2")
    status = F.when(stop, "STOP").when(F.col("md5").isNull(), "ERR").when(F.col("state") == "gone", "DROP").when(post.isNull(), "KEEP").otherwise("ALIAS")
    via = F.when(F.col("p1").isNotNull(), "stripped").when(F.col("p2").isNotNull(), "raw")
    return rows.select("key", status.alias("status"), F.when(status == "ALIAS", post).alias("post"), F.when(status == "ALIAS", via).alias("via"))


def held_by(index: DataFrame, candidates: DataFrame, posts: DataFrame) -> DataFrame:
    """The post that holds each index row: by its own digest, else by the first of its candidate
    digests that has a post with variants. ``candidates(key, i, md5)``, ``posts(md5, post, variants)``."""
    own = index.join(posts.select("md5", F.col("post").alias("own")), "md5", "left").select("key", "own")
    other = candidates.join(posts.where("variants > 0"), "md5").groupBy("key").agg(F.min(F.struct("i", "post"))["post"].alias("other"))
    return own.join(other, "key", "left").select("key", F.coalesce("own", "other").alias("post"), F.when(F.col("own").isNotNull(), "own").when(F.col("other").isNotNull(), "candidate").alias("via"))
