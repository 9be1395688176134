"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by prefixes of a hash of 60 bits. A bucket that holds more
bytes than a shard may is split on the next bit; all others keep their depth. Every
prefix length needs one small aggregation: rows are summed once to cells of ``first``
bits, and only cells that are still too large are summed again on further bits.

Defined results: null texts have 0 bytes; null ids hash like the empty string, with the
text; equal rows have equal hashes, stay together and, like one text over the limit, can
make a shard of more than the limit, which is marked ``oversized``; an empty table has
no shards. Only the two named columns are read, so further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut

BITS = 60


def hash_bits(*columns: Column) -> Column:
    """The first 60 bits of an MD5 digest, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *columns)), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, F.lit(BITS) - depth)


def directory(sizes: DataFrame, limit: int, first: int = 16, step: int = 8) -> DataFrame:
    """Buckets (depth, prefix, n_docs, n_bytes) from rows of (h, bytes).

    Each bucket is as shallow as the limit allows. ``first`` bits bound the cells of the
    first sum, ``step`` the bits that are added for cells that stay too large.
    """
    found, low, high = None, 0, first
    cells = sizes.groupBy(_prefix(F.col("h"), high).alias("cell")).agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    cells = cut(cells)
    over = None
    while True:
        depths = F.explode(F.sequence(F.lit(low), F.lit(high)))
        level = cells.select("cell", "n", "b", depths.alias("depth")).groupBy("depth", F.call_function("shiftright", F.col("cell"), F.lit(high) - F.col("depth")).cast("long").alias("prefix")).agg(F.sum("n").alias("n_docs"), F.sum("b").alias("n_bytes"))
        level = cut(level)
        fits = (F.col("n_bytes") <= limit) | (F.col("depth") == BITS)
        parent = level.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), fits.alias("parent_fits"))
        here = level.withColumn("up", F.call_function("shiftright", "prefix", F.lit(1))).join(parent, ["depth", "up"], "left")
        # below the first level of a round every bucket has a parent in it
        top = F.col("depth") == low
        buckets = here.where(fits & (F.coalesce(~F.col("parent_fits"), top))).select("depth", "prefix", "n_docs", "n_bytes")
        if low:
            buckets = buckets.where(F.col("depth") > low)
        found = buckets if found is None else found.union(buckets)
        over = cut(level.where((F.col("depth") == high) & ~fits).select(F.col("prefix").alias("up")))
        if high == BITS or over.isEmpty():
            return cut(found)
        low, high = high, min(BITS, high + step)
        rows = sizes.join(over, _prefix(F.col("h"), low) == F.col("up"), "left_semi")
        cells = cut(rows.groupBy(_prefix(F.col("h"), high).alias("cell")).agg(F.count("*").alias("n"), F.sum("bytes").alias("b")))


def shard(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``depth`` and ``shard`` (the prefix's bits) of each row, with
    ``shard_bytes``, ``shard_docs`` and ``oversized``."""
    # equal ids alone do not share a bucket: the text takes part
    h = hash_bits(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    sizes = cut(docs.select(F.col(doc_id), h.alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")))
    buckets = directory(sizes, limit)
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]  # at most 61
    bucket = buckets.select(F.col("depth").alias("d"), F.col("prefix").alias("p"), F.col("n_docs").alias("shard_docs"), F.col("n_bytes").alias("shard_bytes"))
    # each hash lies in exactly one bucket, of one of the depths that occur
    rows = sizes.select("*", F.explode(F.array(*(F.struct(F.lit(d).alias("d"), _prefix(F.col("h"), d).alias("p")) for d in sorted(depths)))).alias("k")) if depths else sizes.select("*", F.struct(F.lit(0).alias("d"), F.lit(0).cast("long").alias("p")).alias("k"))
    out = rows.select(doc_id, "bytes", "k.d", "k.p").join(bucket, ["d", "p"])
    name = F.when(F.col("d") == 0, F.lit("")).otherwise(F.substring(F.lpad(F.conv(F.col("p").cast("string"), 10, 2), BITS, "0"), BITS + 1 - F.col("d"), BITS))
    return out.select(doc_id, F.col("bytes").alias("n_bytes"), F.col("d").alias("depth"), name.alias("shard"), "shard_docs", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))
