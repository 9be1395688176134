"""Set algebra: sources of labels, changed keys, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_of(df: DataFrame, keys: list[str], side: str, left: str, right: str, labels: list[str] | None = None, value: str | None = None) -> DataFrame:
    """Each key once, with where it comes from: both, or only one side. One exchange.

    A ``value`` among the public ``labels`` is never the left side's own.
    """
    seen = df.groupBy(*keys).agg(F.bool_or(F.col(side) == left).alias("__l"), F.bool_or(F.col(side) == right).alias("__r"))
    own = F.col("__l") if not labels else F.col("__l") & ~F.col(value).isin(labels)
    which = F.when(F.col("__l") & F.col("__r"), "both").when(own, f"{left}_only").when(F.col("__r"), f"{right}_only")
    return seen.withColumn("part", which).where("part is not null").drop("__l", "__r")


def provenance(creator: Column, auto: Column, meta: Column, labels: list[str]) -> Column:
    """struct(both, auto_only, creator_only, spectrum) of two lists, in their orders; what is
    only the creator's is in no public list, and a public label is never the creator's own."""
    both = F.filter(auto, lambda x: F.array_contains(creator, x))
    auto_only = F.filter(auto, lambda x: ~F.array_contains(creator, x))
    creator_only = F.filter(kept(creator, labels), lambda x: ~F.array_contains(auto, x))
    return F.struct(both.alias("both"), auto_only.alias("auto_only"), creator_only.alias("creator_only"), F.concat(auto_only, both, meta).alias("spectrum"))


def reread(creator: Column, meta: Column, oc: Column, stored: Column, labels: list[str]) -> Column:
    """struct(creator, auto, both, meta, oc, replace_creator): a stored partition rebuilt around a fresh read.

    ``stored`` maps the parts of what is public to lists (null: nothing is known). What was
    automatic stays so, the creator's part is read anew, ``both`` is where they meet, and
    ``replace_creator`` says that the rows of the read before have to go. Missing lists are empty.
    """
    none = F.array().cast("array<string>")
    creator, meta, oc = (F.coalesce(x, none) for x in (creator, meta, oc))
    of = lambda part: F.coalesce(F.element_at(stored, part), none)
    auto = merged(of("auto"), of("both"))
    own = F.filter(kept(creator, labels), lambda x: ~F.array_contains(auto, x))
    return F.struct(
        own.alias("creator"), F.filter(auto, lambda x: ~F.array_contains(creator, x)).alias("auto"), F.filter(auto, lambda x: F.array_contains(creator, x)).alias("both"),
        merged(of("meta"), meta).alias("meta"), oc.alias("oc"), F.lit(True).alias("replace_creator"),
    )


def edited(current: Column, add: Column, remove: Column) -> Column:
    """A set column after an edit; the order of what stays is kept."""
    return F.array_union(F.array_except(current, remove), add)


def kept(values: Column, unwanted: list[str]) -> Column:
    """Values without the unwanted ones; repeats stay."""
    return F.filter(values, lambda x: ~x.isin(unwanted))


def merged(*lists: Column) -> Column:
    """All values once, in order of first appearance."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))
