"""Versioned snapshots of flagged names and posts, and what a change of them does to stored rows.

A snapshot is two tables: ``names(name)`` and ``posts(post_id, mxc)``. Stored state is a
table of (room, mxc, post_id, tags, rating, sources), where ``sources`` maps a kind to a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.rollup import greatest_so_far


def without_names(tags: Column, names: Column) -> Column:
    """The tags without the names; repeats and order stay."""
    return F.filter(tags, lambda x: ~F.array_contains(names, x))


def without_names_in(sources: Column, names: Column) -> Column:
    """Each list of a map without the names."""
    return F.transform_values(sources, lambda _, v: without_names(v, names))


def carries_any(tags: Column, sources: Column, names: Column) -> Column:
    """Whether the tags or any list of the map hold one of the names."""
    return F.arrays_overlap(tags, names) | F.exists(F.map_values(sources), lambda v: F.arrays_overlap(v, names))


def is_fresh(checked_at: Column, now: Column, span_ms: int = 1_800_000) -> Column:
    """Strictly less than the span ago; a time that is missing is not fresh."""
    return F.coalesce(now - checked_at < span_ms, F.lit(False))


def names_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row (changed): whether the two sets of names differ; ``old`` may be empty."""
    both = old.select("name", F.lit(1).alias("s")).union(new.select("name", F.lit(2).alias("s")))
    return both.groupBy("name").agg(F.min("s").alias("low"), F.max("s").alias("high")).agg((F.count_if(F.col("low") == F.col("high")) > 0).alias("changed"))


def affected(old: DataFrame, new: DataFrame, old_names: DataFrame, new_names: DataFrame, known: bool = True) -> DataFrame:
    """Posts that a change can have touched, once each: with other names (or unknown ones
    before) every post of either list, else those that joined or left."""
    both = old.select("post_id", "mxc", F.lit(1).alias("s")).union(new.select("post_id", "mxc", F.lit(2).alias("s")))
    sides = both.groupBy("post_id").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.max_by("mxc", "s").alias("mxc"))
    change = names_changed(old_names, new_names) if known else old.sparkSession.range(1).select(F.lit(True).alias("changed"))
    # one row without a key, so the join is bounded
    return sides.join(F.broadcast(change)).where(F.col("changed") | (F.col("low") == F.col("high"))).select("post_id", "mxc")


def reprojected(state: DataFrame, posts: DataFrame, projections: DataFrame, names: Column) -> DataFrame:
    """What a change makes of each stored row that it touches, with ``action``.

    A row is touched if its mxc or its post is among ``posts`` (two equi joins, never an
    OR). ``projections(post_id, p_tags, p_sources, legacy, failed)`` says what is known of a
    post: its tags, else a legacy list, else (no row) it is hidden and the row's own tags
    count; a failed lookup leaves a row that carries no name as it is. Names are
    stripped, and a row that would not change is ``current``.
    """
    by_mxc = state.join(posts.where("mxc is not null").select("mxc", F.col("post_id").alias("m_post")), "mxc", "left")
    # rows without a post of their own go by the one that their mxc has or not at all, so no exchange brings them together
    rows = by_mxc.withColumn("target", F.coalesce("post_id", "m_post")).where("target is not null")
    rows = rows.join(posts.select(F.col("post_id").alias("target"), F.lit(True).alias("hit")).distinct(), "target", "left").where("hit or m_post is not null")
    rows = rows.join(projections.withColumnRenamed("post_id", "target"), "target", "left")
    source = F.when(F.col("failed"), "failed").when(F.size("p_tags") > 0, "projection").when(F.col("legacy").isNotNull(), "legacy").otherwise("own")
    rows = rows.withColumn("source", source)
    tags = without_names(F.when(F.col("source") == "projection", F.col("p_tags")).when(F.col("source") == "legacy", F.col("legacy")).otherwise(F.col("tags")), names)
    sources = without_names_in(F.when(F.col("source") == "projection", F.col("p_sources")).otherwise(F.col("sources")), names)
    pairs = lambda m: F.array_sort(F.map_entries(m))
    same = (F.col("post_id").eqNullSafe(F.col("target"))) & (F.col("tags").eqNullSafe(tags)) & pairs(F.col("sources")).eqNullSafe(pairs(sources))
    left = (F.col("source") == "failed") & ~carries_any(F.col("tags"), F.col("sources"), names)
    action = F.when(left, "left").when(same, "current").otherwise("write")
    return rows.select("room", "mxc", F.col("target").alias("post_id"), tags.alias("tags"), "rating", sources.alias("sources"), "source", action.alias("action"))


def drained(parked: DataFrame, listed: DataFrame, visible: DataFrame) -> DataFrame:
    """What becomes of each parked row: kept while its post is flagged, dropped if banished
    or still hidden, else written. ``listed(md5, flagged, banished)``, ``visible(post_id)``."""
    by = listed.groupBy("md5").agg(F.bool_or("flagged").alias("flagged"), F.bool_or("banished").alias("banished"))
    seen = visible.select("post_id", F.lit(True).alias("seen")).distinct()
    rows = parked.join(by, "md5", "left").join(seen, "post_id", "left")
    return rows.withColumn("action", F.when(F.col("flagged"), "keep").when(F.col("banished"), "drop banished").when(F.col("seen").isNull(), "drop hidden").otherwise("write")).drop("flagged", "banished", "seen")


def parkable(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose bytes (``md5``) a listed post holds that is flagged and not banished, with the least such ``post_id``."""
    flagged = listed.where("flagged and not coalesce(banished, false)").groupBy("md5").agg(F.min("post_id").alias("post_id"))
    return rows.join(flagged, "md5")


def own_copies(state: DataFrame, posts: DataFrame, sender: str, denied: DataFrame) -> DataFrame:
    """Stored rows that name one of ``posts(post_id)`` and that ``sender`` wrote, outside of ``denied(room)``: what others wrote proves nothing."""
    own = state.where(F.col("sender") == sender).join(posts.select("post_id").distinct(), "post_id", "left_semi")
    return own.join(denied.select("room"), "room", "left_anti")


def polled(polls: DataFrame, key: str, order: list[str] = ["at"], stretch: Column | None = None) -> DataFrame:
    """State of a polled source after each answer, by ``order`` (``at`` first): the generation that holds (a 304
    confirms it, an error keeps it), when it was last checked, and whether that is fresh.

    ``stretch``, a column that grows with ``at``, spreads a source with very many answers
    over tasks, as in ``rollup.with_previous``.
    """
    new = F.when((F.col("status") == 200) & F.col("generation").isNotNull(), F.struct(*order, "generation"))
    rows = polls.withColumn("__held", new).withColumn("checked_at", F.when(F.col("status").isin(200, 304), F.col("at")))
    rows = greatest_so_far(rows, key, list(order), ["__held", "checked_at"], stretch, itself=True)
    # the answer that brought the generation was a check itself, so no check after it came before it
    rows = rows.withColumn("checked_at", F.when(F.col("__held").isNotNull(), F.col("checked_at")))
    return rows.withColumn("holds", F.col("__held.generation")).drop("__held").withColumn("fresh", is_fresh(F.col("checked_at"), F.col("at")))
