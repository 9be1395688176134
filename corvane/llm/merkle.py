"""A Merkle manifest of a table, with membership proofs from stored parent preimages.

A row's leaf is the digest of its fields. The leaves of a group ascend by the key; runs
of 16 become their parents, level by level, until one node, the group's subroot, is
left. The subroots, ordered by group, make a tree in the same way, up to the root. What
is stored of a parent is its preimage: the digests of its children, one after the other,
so a child's place is a slot of 64 characters. A leaf joins the preimages of its
ancestors. Its siblings are these without its own slots; a changed leaf is folded to the
root by splicing each digest into its slot of the next preimage.

Rows are numbered within their groups by one sort over all partitions and the counts of
each partition's stretch of a group, so a group of any size is spread over many tasks.
Ancestors are joined from the root down, once for each parent, not for each leaf; the
leaves meet what their lowest parent has gathered, one entry a level.

Defined results: a null field counts as ``-``, so it differs from an empty one; rows
with a null key come first in their group, and a null group is a group, the first one;
rows that share a key ascend by their leaf, so the order of the input has no effect;
repeated rows are leaves of their own, each with the proof of its place; an empty table
has no leaves and no root. Only the named columns are
read, so further columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import cut

#: Children of a parent, and characters of a digest.
RUN, SLOT = 16, 64
#: Fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(*fields: Column) -> Column:
    """Digest of the fields, each as its length in bytes, a colon and its value; null as ``-``."""

    def written(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*map(written, fields)))


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    """The rows with ``at``, which grows along an order over all partitions."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))


def _numbered(nodes: DataFrame) -> DataFrame:
    """Nodes (group, at, ...) with ``g``, the group's number, ``i``, the place in the group, and ``n``, its size.

    A partition's rows of one group follow each other, so a place is ``at`` but for a
    shift that all of them share. There is one shift for each partition and group.
    """
    part = F.shiftright("at", 33)
    stretches = nodes.groupBy(F.col("group").alias("of"), part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("of")
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    shifts = stretches.select("of", "part", (before - F.col("first")).alias("shift"), F.min("first").over(whole).alias("g"), F.sum("rows").over(whole).alias("n"))
    placed = nodes.join(shifts, nodes["group"].eqNullSafe(shifts["of"]) & (F.shiftright(nodes["at"], 33) == shifts["part"]))
    return placed.withColumn("i", F.col("at") + F.col("shift")).drop("of", "part", "shift", "at", "group")


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The parents (g, i, n, preimage, hash) of each level, the lowest first; ``n`` counts the group's parents there.

    A parent gathers 16 digests at most, and each level has a sixteenth of the rows of the one below.
    """
    levels, below = [], nodes.where("n > 1").select("g", "i", "n", "hash")
    while True:
        children = F.array_sort(F.collect_list(F.struct((F.col("i") % RUN).alias("slot"), "hash")))
        up = below.groupBy("g", F.floor(F.col("i") / RUN).alias("i")).agg(F.ceil(F.first("n") / RUN).alias("n"), F.array_join(F.transform(children, lambda c: c["hash"]), "").alias("preimage"))
        levels.append(cut(up.withColumn("hash", digest(F.col("preimage")))))
        below = levels[-1].where("n > 1").select("g", "i", "n", "hash")
        if below.isEmpty():
            return levels


def _step(slot: Column) -> Column:
    """The path of a node whose parent's ``preimage`` and ``rest`` it has joined."""
    return F.concat(F.array(F.struct(F.col("preimage"), slot.cast("int").alias("slot"))), F.col("rest"))


def _with_paths(levels: list[DataFrame], nodes: DataFrame, start: DataFrame) -> DataFrame:
    """``nodes`` (g, i, n, ...) with ``path``, their ancestors' preimages and slots from the lowest to the root.

    ``start`` (g, rest, subroot, root) has what lies above each group's single last node.
    """
    known, above = ["preimage", "rest", "subroot", "root"], None
    for level in reversed(levels):
        joined = level.where("n = 1").join(start, "g").select("g", "i", *known)
        if above is not None:
            parents = above.withColumnRenamed("i", "up").withColumnRenamed("preimage", "over")
            mine = level.where("n > 1").withColumn("up", F.floor(F.col("i") / RUN)).join(parents, ["g", "up"])
            slot = F.struct(F.col("over").alias("preimage"), (F.col("i") % RUN).cast("int").alias("slot"))
            joined = joined.union(mine.select("g", "i", "preimage", F.concat(F.array(slot), F.col("rest")).alias("rest"), "subroot", "root"))
        above = joined
    many = nodes.where("n > 1").withColumn("up", F.floor(F.col("i") / RUN)).join(above.withColumnRenamed("i", "up"), ["g", "up"])
    many = many.withColumn("path", _step(F.col("i") % RUN)).drop("up", "preimage", "rest")
    lone = nodes.where("n = 1").join(start, "g").withColumnRenamed("rest", "path")
    return many.unionByName(lone)


@dataclass
class Manifest:
    """``leaves`` (key, hash, g, i, n and what else was carried), ``levels`` of parents, and ``groups`` (g, rest, subroot, root)."""

    leaves: DataFrame
    levels: list[DataFrame]
    groups: DataFrame

    def parents(self) -> DataFrame:
        """Every stored parent below the subroots: g, level, i, preimage, hash."""
        each = [level.select("g", F.lit(k).alias("level"), "i", "preimage", "hash") for k, level in enumerate(self.levels, 1)]
        return reduce(DataFrame.union, each)

    def proofs(self) -> DataFrame:
        """The leaves with ``path``, ``subroot`` and ``root``."""
        return _with_paths(self.levels, self.leaves, self.groups).drop("g", "i", "n")


def manifest(docs: DataFrame, group: str = "source", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, **carried: Column) -> Manifest:
    """Build the trees. ``carried`` columns of the documents go along with their leaves; texts don't."""
    rows = cut(docs.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf(*map(F.col, fields)).alias("hash"), *(c.alias(name) for name, c in carried.items())))
    # rows alike in all fields have equal leaves; the last number lets a range end between them
    rows = rows.withColumn("again", F.monotonically_increasing_id())
    nodes = cut(_numbered(_in_order(rows, "group", "key", "hash", "again").drop("again")))
    levels = _levels(nodes)
    last = reduce(DataFrame.union, [x.where("n = 1").select("g", "hash") for x in [nodes, *levels]])
    tops = cut(_numbered(_in_order(last.select(F.lit(0).alias("group"), F.col("g").alias("of_group"), "hash"), "of_group")))
    over = _levels(tops)
    none = F.array().cast("array<struct<preimage:string,slot:int>>")
    root = reduce(DataFrame.union, [x.where("n = 1").select("g", none.alias("rest"), F.col("hash").alias("subroot"), F.col("hash").alias("root")) for x in [tops, *over]])
    groups = _with_paths(over, tops.withColumnRenamed("hash", "own"), root)
    return Manifest(nodes, levels, cut(groups.select(F.col("of_group").alias("g"), F.col("path").alias("rest"), F.col("own").alias("subroot"), "root")))


def _sides(step: Column) -> tuple[Column, Column]:
    """A preimage's characters before and after a slot."""
    at = step["slot"] * SLOT
    return F.substr(step["preimage"], F.lit(1), at), F.substr(step["preimage"], at + SLOT + 1, F.lit(RUN * SLOT))


def siblings(path: Column) -> Column:
    """The proof: all siblings' digests, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(*_sides(step))), "")


def folded(path: Column, own: Column) -> Column:
    """The root that a leaf's digest leads to along a path."""

    def step(below: Column, at: Column) -> Column:
        left, right = _sides(at)
        return digest(F.concat(left, below, right))

    return F.aggregate(path, own, step)
