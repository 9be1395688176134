"""Joins by meaning: ordered fallbacks, scopes, aliases, either-key matches, moves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rows: DataFrame, lookups: list[tuple[str, str, DataFrame]], value: str) -> DataFrame:
    """Match each row by the first of several keys that has a match.

    ``lookups`` are (label, key column, table of that key and ``value`` with one row for a
    key). Adds ``value`` and ``via``, the label of the key that matched.
    """
    hit, via = [], F.lit(None).cast("string")
    for i, (_, key, table) in enumerate(lookups):
        rows = rows.join(table.select(F.col(key), F.col(value).alias(f"__hit{i}")), key, "left")
        hit.append(f"__hit{i}")
    for i, (label, *_) in reversed(list(enumerate(lookups))):
        via = F.when(F.col(f"__hit{i}").isNotNull(), label).otherwise(via)
    return rows.withColumn(value, F.coalesce(*hit)).withColumn("via", via).drop(*hit)


def by_digest(rows: DataFrame, posts: DataFrame, records: DataFrame) -> DataFrame:
    """Each row with the post that holds its bytes (``post_id``, ``md5``) and ``via``: by the
    digest of the stripped bytes, else by what is on record for the raw ones, else by that of the raw ones.

    ``rows`` have ``raw_md5`` and ``stripped_md5``; ``posts(md5, post_id)`` and
    ``records(raw_md5, recorded)`` have one row for a digest. A record that names the stripped
    digest, and a raw digest that equals it, were looked up already. Keys that are not
    looked up get a value of their own that no digest has, so that they spread over tasks.
    """
    rows = rows.join(records.select("raw_md5", F.col("recorded").alias("__r")), "raw_md5", "left")
    none = F.concat(F.lit("none-"), F.coalesce("raw_md5", F.expr("uuid()")))
    stripped, raw = F.col("stripped_md5"), F.col("raw_md5")
    again = lambda c: c.isNull() | F.coalesce(c == stripped, F.lit(False))
    rows = rows.withColumns({"__k0": F.coalesce(stripped, none), "__k1": F.when(again(F.col("__r")), none).otherwise(F.col("__r")), "__k2": F.when(again(raw), none).otherwise(raw)})
    labels = ("stripped", "raw-record", "raw")
    found = first_match(rows, [(label, f"__k{i}", posts.select(F.col("md5").alias(f"__k{i}"), "post_id")) for i, label in enumerate(labels)], "post_id")
    md5 = F.when(F.col("via") == labels[0], F.col("__k0")).when(F.col("via") == labels[1], F.col("__k1")).when(F.col("via") == labels[2], F.col("__k2"))
    return found.withColumn("md5", md5).drop("__k0", "__k1", "__k2", "__r")


def in_scope(rows: DataFrame, *scopes: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose keys are in every scope."""
    return reduce(lambda d, s: d.join(s[0].select(s[1]), s[1], "left_semi"), scopes, rows)


def by_alias(rows: DataFrame, masters: DataFrame, key: str, alias: str, master: str) -> DataFrame:
    """``master`` of each row's key where it is an alias, else the key."""
    m = masters.select(F.col(alias).alias(key), F.col(master).alias("__master")).dropDuplicates([key])
    return rows.join(m, key, "left").withColumn("owner", F.coalesce("__master", F.col(key))).drop("__master")


def by_either(rows: DataFrame, ids: list[str], *sides: tuple[str, DataFrame]) -> DataFrame:
    """Rows that match any of several keys, once each: one equi join for each key, never an OR."""
    parts = [rows.join(table.select(key), key, "left_semi").select(*ids) for key, table in sides]
    return reduce(DataFrame.union, parts).distinct()


def moved(rows: DataFrame, pairs: DataFrame, key: str, old: str, new: str, survivors: DataFrame) -> DataFrame:
    """Status of each row that names a retired key: moved, or missing where its survivor is not known."""
    alive = survivors.select(F.col(key).alias(new), F.lit(True).alias("__alive"))
    status = F.when(F.col("__alive"), "moved").otherwise("missing")
    return rows.join(pairs.withColumnRenamed(old, key), key).join(alive, new, "left").withColumn("status", status).drop("__alive")


def faulty_pairs(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Pairs that break a rule: not positive, equal, a retired key twice, a survivor that is retired too."""
    twice = pairs.groupBy(old).count().where("count > 1").select(old, F.lit(True).alias("twice"))
    chained = pairs.select(F.col(old).alias(new), F.lit(True).alias("chained")).distinct()
    reason: Column = F.when((F.col(old) <= 0) | (F.col(new) <= 0), "not positive").when(F.col(old) == F.col(new), "itself").when(F.col("twice"), "twice").when(F.col("chained"), "chain")
    return pairs.join(twice, old, "left").join(chained, new, "left").withColumn("reason", reason).where("reason is not null").select(old, new, "reason")


def upsert_changes(stored: DataFrame, incoming: DataFrame, key: str, values: list[str]) -> DataFrame:
    """What a write would do to each incoming key: insert, update, or same (to be skipped)."""
    old = stored.select(key, F.struct(*values).alias("__old"))
    joined = incoming.select(key, F.struct(*values).alias("__new")).join(old, key, "left")
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("update")
    return joined.select(key, action.alias("action"))
