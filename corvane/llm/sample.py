"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows: of each value of a hash of ``key`` the row with the least second hash.

    The choice is even over the keys and the same in every run; rows with a null key
    are left out, and of rows that share a key one stays.
    """
    row = F.struct(F.xxhash64(F.lit(1), key).alias("__hash"), F.col(key).alias("__key"), *(F.col(c) for c in df.columns))
    return df.where(F.col(key).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(most)).alias("__bucket")).agg(F.min(row).alias("row")).select(*(f"row.{c}" for c in df.columns))
