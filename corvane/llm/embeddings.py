"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors of one label are collapsed first. The distinct ones are packed into
blocks, each vector normalised and rounded to int8 with its own scale; the length of
what rounding lost is kept with it. Two blocks of one label make a tile, one matrix
product of small integers (exact in 32-bit floats up to 1040 dimensions, in 64-bit
floats beyond). With x = s q + e it holds that

    |x.y - s_x s_y q_x.q_y| <= |e_x| |y| + |e_y| |s_x q_x| <= |e_x| + |e_y| (1 + |e_x|),

so only pairs whose product plus bound reaches the threshold are computed again, in
double precision; these decide. Tiles are dealt to the tasks one by one, so a label
with a third of all vectors is spread like any other. A label has as few blocks as its
tiles need to be dealt well (``FEW``) and to fit a task's memory (``BYTES``): each vector
is sent once for each block, so larger blocks mean fewer copies. Inside a tile the products
are taken ``BLOCK`` by ``BLOCK``.

A tile returns, for each vector, how many it links with, and a spanning forest of its
links, so what leaves a tile grows with its vectors, not with its links.

Defined results: vectors that are null, of zero length, or with null or non-finite
components, and those without a label, link with nothing; vectors of different
dimensions do not link; rows with equal ids each give a row, and count as one vector
with the links of each of them; a row with a null id links with nothing and is not kept.
An empty table gives an empty one. Only the named columns are read, so further columns
may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, tidy
from corvane.llm.graph import components

#: Vectors whose products are taken at once, and of the least block.
BLOCK = 1024
#: A label is cut into so many blocks before they grow beyond ``BLOCK``, up to so many bytes of 32-bit components.
FEW, BYTES = 2, 4 << 20


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and lengths of the rounding errors of unit vectors."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    lost = x - scale[:, None] * q
    return q, scale, np.sqrt((lost * lost).sum(1)) * (1 + 1e-12) + 1e-15


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vertex with an edge, an edge to the least vertex of its component."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    a = np.flatnonzero(root != np.arange(n))
    return a, root[a]


def _links(x: dict, y: dict | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked vectors of two blocks, or of one with itself."""
    b = x if y is None else y
    kind = np.float32 if x["q"].shape[1] <= 1040 else np.float64
    out = []
    for r in range(0, len(x["q"]), BLOCK):
        rows = slice(r, r + BLOCK)
        left = x["q"][rows].astype(kind)
        for c in range(r if y is None else 0, len(b["q"]), BLOCK):
            columns = slice(c, c + BLOCK)
            product = (left @ b["q"][columns].astype(kind).T).astype(np.float64) * x["scale"][rows, None] * b["scale"][None, columns]
            bound = x["lost"][rows, None] + b["lost"][None, columns] * (1 + x["lost"][rows, None]) + 1e-9
            i, j = np.nonzero(product + bound >= least)
            i, j = i + r, j + c
            if y is None:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 50_000):
                p, q = i[at : at + 50_000], j[at : at + 50_000]
                good = (x["v"][p] * b["v"][q]).sum(1) / (x["norm"][p] * b["norm"][q]) >= least
                out.append((p[good], q[good]))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, int), np.zeros(0, int))


def _packed(classes: DataFrame, block: int) -> DataFrame:
    """One row for each block: (label, dims, blocks, block, x)."""
    n = F.count("*")
    most = F.greatest(F.lit(block), F.floor(F.lit(BYTES) / (4 * F.col("dims"))))
    blocks = F.greatest(F.ceil(n / most), F.least(F.ceil(n / block), F.lit(FEW)))
    sizes = classes.groupBy("label", "dims").agg(blocks.cast("int").alias("blocks"))
    rows = classes.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, ["label", "dims"])
    return rows.groupBy("label", "dims", "blocks", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list(F.struct("rep", "copies", "v")).alias("x"))


def near_duplicates(vectors: DataFrame, least: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of each row: vectors of one label
    link if their cosine is at least ``least``."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = cut(rows.where("usable").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("dims", F.size("v")))
    packed = cut(_packed(classes, block))
    last = F.col("blocks") - 1
    x = packed.select("label", "dims", "x", F.col("block").alias("low"), F.explode(F.sequence(F.col("block"), last)).alias("high"))
    y = packed.select("label", "dims", F.col("x").alias("y"), F.col("block").alias("high"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("low")).where("low < high")
    tiles = x.join(y, ["label", "dims", "low", "high"], "left").where("y is not null or low = high").select("dims", "x", "y")
    return _result(rows, classes, _tiles(tiles, least)).withColumnRenamed("vec_id", vec_id)


def _tiles(tiles: DataFrame, least: float) -> DataFrame:
    """(rep, links, other): links to add, and one edge of the forest or null."""

    def block_of(lists_: pa.Array, r: int, dims: int) -> dict | None:
        s = lists_[r].values if lists_[r].is_valid else None
        if s is None or not len(s):
            return None
        v = s.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        largest = np.abs(v).max(1, keepdims=True)
        scaled = v / largest  # so that no square over- or underflows
        norm = np.sqrt((scaled * scaled).sum(1))
        q, scale, lost = quantise(scaled / norm[:, None])
        return {"rep": s.field("rep").to_numpy(), "copies": s.field("copies").to_numpy(), "v": scaled, "norm": norm, "q": q, "scale": scale, "lost": lost}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dims = batch["dims"][r].as_py()
                x, y = block_of(batch["x"], r, dims), block_of(batch["y"], r, dims)
                i, j = _links(x, y, least)
                both = x["rep"] if y is None else np.r_[x["rep"], y["rep"]]
                copies = x["copies"] if y is None else np.r_[x["copies"], y["copies"]]
                j = j if y is None else j + len(x["rep"])
                counts = np.bincount(i, copies[j], len(both)).astype(np.int64) + np.bincount(j, copies[i], len(both)).astype(np.int64)
                a, root = forest(i, j, len(both))
                at = np.flatnonzero(counts)
                other = np.full(len(both), -1)
                other[a] = root
                yield pa.RecordBatch.from_arrays([pa.array(both[at]), pa.array(counts[at]), pa.array(both[other[at]], mask=other[at] < 0)], ["rep", "links", "other"])

    return cut(tiles.mapInArrow(tidy(run), "rep long, links long, other long"))


def _result(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    of_class = classes.join(counts, "rep", "left").join(joined, classes.rep == joined.node, "left").select("label", "v", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # only classes that link or have copies say more than the row itself
    of_class = cut(of_class.where("n_links > 0"))
    right = of_class.select("label", *_digest(F.col("v")), "n_links", "component_id")
    left = rows.select("id", "label", *_digest(F.when(F.col("usable"), F.col("v"))))
    out = left.join(right, ["label", "h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    kept = F.coalesce(component == F.col("id"), F.lit(False))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def _digest(v: Column) -> tuple[Column, Column]:
    """128 bits that stand for a vector where rows get their class back (two of a billion
    vectors share them with a chance of about one in 10**20); null for none."""
    return F.when(v.isNotNull(), F.xxhash64(v)).alias("h1"), F.when(v.isNotNull(), F.xxhash64(F.lit(1), v)).alias("h2")
