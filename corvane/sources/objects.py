"""Listings of object stores, and keys looked up in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, bytes) of the objects under a prefix; their contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def contents(spark: SparkSession, path: str, most: int, pattern: str = "*") -> DataFrame:
    """(path, content, ok, reason): objects larger than ``most`` bytes are refused unread, and one
    whose content is shorter than its listed length is truncated."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    small = rows.where(F.col("length") <= most)
    cut = F.when(F.length("content") < F.col("length"), "truncated")
    good = small.select("path", "content", cut.isNull().alias("ok"), cut.alias("reason"))
    large = rows.where(F.col("length") > most).select("path", F.lit(None).cast("binary").alias("content"), F.lit(False).alias("ok"), F.lit("too large").alias("reason"))
    return good.union(large)


def heads(keys: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """The wanted keys with what the listing says of each, nulls where there is no such object."""
    return keys.join(objects.withColumn(key, F.regexp_extract("path", r"([^/]+)$", 1)), key, "left")
