"""Reads by meaning: pages of a history, point reads, listings, checked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_before(df: DataFrame, order: list[str], size: int, upto: Column | None = None) -> DataFrame:
    """One page of a history, the newest rows first, none after an upper bound."""
    rows = df if upto is None else df.where(upto)
    return rows.orderBy(*(F.desc(c) for c in order)).limit(size)


def point_reads(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The wanted keys with their rows; a key without a row stays, with nulls and ``found`` false."""
    return wanted.join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def named(partitions: DataFrame, names: DataFrame, key: str, name: str, shown: int | None = None) -> DataFrame:
    """Partitions with their names where one is known, by name, unnamed ones last, then by key;
    ``more`` is how many the first ``shown`` leave out."""
    rows = partitions.join(names.select(key, name), key, "left").orderBy(F.col(name).asc_nulls_last(), key)
    if shown is None:
        return rows
    total = partitions.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))
    return rows.limit(shown).join(F.broadcast(total))  # one row


def gap(complete: DataFrame, visible: DataFrame, by: str, key: str, failed: DataFrame) -> DataFrame:
    """Distinct keys of two scans of one relation and the difference of the counts; null where a scan failed."""
    counts = complete.groupBy(by).agg(F.count_distinct(key).alias("complete")).join(visible.groupBy(by).agg(F.count_distinct(key).alias("visible")), by, "left")
    counts = counts.join(failed.select(by, F.lit(True).alias("f")).distinct(), by, "left")
    seen = F.when(F.col("f").isNull(), F.coalesce("visible", F.lit(0).cast("long")))
    return counts.select(by, "complete", seen.alias("visible"), (F.col("complete") - seen).alias("sealed"))


def exploded_after(messages: DataFrame, offsets: DataFrame, key: str, ident: str, parts: str) -> DataFrame:
    """The parts of messages after each partition's offset, one row for each, numbered."""
    new = messages.join(offsets.select(key, "offset"), key, "left").where(F.col("offset").isNull() | (F.col(ident) > F.col("offset"))).drop("offset")
    return new.select(*(c for c in messages.columns if c != parts), F.posexplode(parts).alias("i", "part"))


def next_offsets(messages: DataFrame, offsets: DataFrame, key: str, ident: str) -> DataFrame:
    """Each partition's offset after a pass: the last message, or what it was."""
    both = messages.select(key, F.col(ident).alias("offset")).union(offsets.select(key, "offset"))
    return both.groupBy(key).agg(F.max("offset").alias("offset"))


def isolated(rows: DataFrame, key: str, bad: Column, reason: Column, order: str) -> DataFrame:
    """A pass over partitions of which one that has a bad row fails alone, with its first reason."""
    first = F.min(F.when(bad, F.struct(F.col(order), reason.alias("reason"))))["reason"]
    return rows.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(~bad).alias("good"), first.alias("reason")).withColumn("ok", F.col("reason").isNull())


def consistent(pages: DataFrame, generation: str, page: str, first: str, last: str) -> DataFrame:
    """The newest generation of which every page is there and keys go on from page to page; no
    row if there is none. ``pages`` has a row for each page with its first and last key."""
    from pyspark.sql import Window

    before = F.lag(last).over(Window.partitionBy(generation).orderBy(page))
    ok = pages.withColumn("ok", F.coalesce(F.col(first) > before, F.lit(True)) & (F.col(first) <= F.col(last)))
    good = ok.groupBy(generation).agg((F.bool_and("ok") & (F.max(page) + 1 == F.count("*")) & (F.min(page) == 0)).alias("good")).where("good")
    return pages.join(good.agg(F.max(generation).alias(generation)), generation, "left_semi")


def checked(rows: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """Rows with ``reason``, the first rule that does not hold (or is unknown), null for a good row."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        reason = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("reason", reason)


def above(scores: Column, bars: Column) -> Column:
    """Keys of a map whose score reaches the bar of their kind, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(scores, lambda k, v: v >= F.coalesce(F.element_at(bars, k), F.lit(0.35)))))


def best(scores: Column) -> Column:
    """The key of the greatest score, the first in order of equal ones; missing scores come last, and an empty map has none."""
    return F.get(F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].isNull().alias("none"), (-e["value"]).alias("s"), e["key"].alias("k")))), F.lit(0))["k"]


def layout(df: DataFrame, path: str, *keys: str) -> None:
    """Write a table with a folder for each value of the keys, and one task for each, so that scans can leave folders out."""
    df.repartition(*keys).write.partitionBy(*keys).parquet(path)


def undenied(table: DataFrame, key: str, denied: DataFrame, most: int = 10_000) -> DataFrame:
    """Rows of a table in ``layout`` whose partition is not denied; the files of denied ones are not opened.

    Up to ``most`` denied values become a filter on the partitions; of more, a join decides row by row.
    """
    some = [r[0] for r in denied.select(key).where(F.col(key).isNotNull()).distinct().limit(most + 1).collect()]
    if len(some) > most:
        return table.join(denied.select(key).distinct(), key, "left_anti")
    return table.where(F.col(key).isNull() | ~F.col(key).isin(some)) if some else table
