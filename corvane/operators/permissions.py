"""Bit masks: what an owner's groups allow after ordered overwrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unsigned(text: Column) -> Column:
    """A decimal string of 64 unsigned bits as the long with the same bits."""
    return F.conv(text, 10, -10).cast("long")


def folded(df: DataFrame, key: str, mask: str, stage: str, stages: list[str], owner: str | None = None, administrator: int | None = None) -> DataFrame:
    """Base mask (the first stage) after each later stage's deny and allow.

    ``df`` has one row for each mask: its key, its stage, and ``kind`` allow or deny.
    Where the column ``owner`` holds, and where the base mask has a bit of
    ``administrator``, every bit is set, whatever the later stages say.
    """

    def bits(s: str, kind: str) -> Column:
        return F.coalesce(F.bit_or(F.when((F.col(stage) == s) & (F.col("kind") == kind), F.col(mask))), F.lit(0).cast("long"))

    everything = F.bool_or(F.col(owner)) if owner else F.lit(False)
    sums = df.groupBy(key).agg(*(bits(s, k).alias(f"__{s}_{k}") for s in stages for k in ("allow", "deny")), F.coalesce(everything, F.lit(False)).alias("__all"))
    base = F.col(f"__{stages[0]}_allow")
    out = base
    for s in stages[1:]:
        out = out.bitwiseAND(F.bitwise_not(F.col(f"__{s}_deny"))).bitwiseOR(F.col(f"__{s}_allow"))
    if administrator is not None:
        sums = sums.withColumn("__all", F.col("__all") | (base.bitwiseAND(F.lit(administrator)) != 0))
    return sums.select(key, F.when(F.col("__all"), F.lit(-1).cast("long")).otherwise(out).alias("permissions"))


def presence(permissions: Column, view: int, history: int, send: int, react: int) -> Column:
    """struct(view, history, send, react): nothing without view; reacting needs history as well."""
    has = lambda bit: permissions.bitwiseAND(F.lit(bit)) != 0
    return F.struct(has(view).alias("view"), (has(view) & has(history)).alias("history"), (has(view) & has(send)).alias("send"), (has(view) & has(history) & has(react)).alias("react"))
