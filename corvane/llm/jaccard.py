"""N-gram Jaccard join: a grouped prefix join over word shingles.

A document's set is that of its ``k``-word shingles, as 64-bit hashes, in one order
for all documents: rarest first. Two sets of the wanted similarity share a token of
their prefixes. Documents of one size and prefix (copies among them) form one group,
and only groups are joined:

1. Count shingles over all documents, in hashed counters whose number follows the
   input up to ``2 ** MOST_BITS``; what is broadcast of them is one byte each, the
   count's magnitude. Any order gives right results; the counters put the frequent
   shingles last. At a size at which all counters are full, shingles that are not far
   more frequent than the mean of a counter are in the order of their hashes.
2. Write each document's size, digest, prefix; collapse equal ones into groups.
3. Exchange (prefix token, part, group) once; keep the tokens that two groups share. A
   token that the counters call frequent is dealt to several parts, by its group.
4. Filter group pairs by length, by position and by a bitmap of each set (differing
   bits bound the difference of the sets from below), and verify them, with whole
   sets, in three rounds. First each group with the one before it and the first one of
   its token, each member with its group's first. Then posting lists, one of those
   with equal members, cut into blocks, are compared block by block (a tile), and of
   the pairs that pass the filters a tile sends those of a spanning forest of its
   components. Last, of the lists from which that left out a pair, every pair of members
   that is still not connected is verified: lists that left out ``MANY`` pairs a member
   at most send these pairs; in the others tiles get the whole sets and verify their
   pairs where they lie. Pairs inside one component would add nothing to it, so none is
   missed, and what leaves a tile grows with its members only.

Hashes of 64 bits stand for shingles, so two shingles may count as one with a chance
of about one in 10**19 for each pair in one document or compared pair. Posting lists
count as equal by three sums of 32-bit hashes, which two different lists share with a
chance of about one in 10**28.

Defined results: null and empty texts have an empty set and link with nothing; rows
with a null id keep their set's size, have no component and link with nothing; rows
that share an id are one document that has the links of each of its texts; ties in
frequency go by hash. Texts count whole; an empty table gives an empty result. Only the
two named columns are read, so further columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACE, all_shingles, bits_for, block_sums, cut, distinct_in, hashed_words, id_bits, pieces, tidy
from corvane.llm.graph import components

#: Hashed counters of shingles are 2 ** 18 to 2 ** MOST_BITS: 16 MB at most where they are broadcast.
MOST_BITS = 24
#: Rows of a token that go to one part, about.
PART = 4096
#: How many parts a token has.
PARTS = "shiftleft(1, cast(token & 255 as int))"
#: 64-bit words of a set's bitmap.
MARKS = 16
#: Pairs that a list may write for each member; one that would write more gets its members' sets.
MANY = 32
#: About how many members of a posting list are compared as one block.
BLOCK = 1024


def _sets_of(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with their texts' sets: hashes, and where each set begins and ends."""
    for part, some in pieces(batch, "text"):
        yield part, *distinct_in(*all_shingles(*hashed_words(some, SPACE), k))


def frequencies(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """The magnitude (eighths of a power of two) of how many documents' sets have a
    shingle in each of the hashed counters, over all rows of (id, text)."""

    def count(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        total, mask = np.zeros(1 << bits, np.uint32), np.uint64((1 << bits) - 1)
        for batch in batches:
            for _, s, _ in _sets_of(batch, k):
                np.add.at(total, (s & mask).astype(np.intp), np.uint32(1))
        return total

    return magnitude(block_sums(docs.select("text"), 1 << bits, count))


def magnitude(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.floor(8 * np.log2(1.0 + counts))).astype(np.uint8)


def _parts(level: np.ndarray, floor: int) -> np.ndarray:
    """Into how many parts, as a power of two, tokens of these counters are dealt; ``floor`` is what any counter has."""
    return np.ceil(np.log2(np.maximum(1, (2.0 ** ((level.astype(float) + 1) / 8) - 2 * floor) / PART))).astype(np.uint64)


def _list(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _sets(docs: DataFrame, k: int, level: np.ndarray, num: int, den: int) -> DataFrame:
    """(id, n, digest, prefix_digest, prefix, marks) of each row.

    A prefix token is a hash without its last byte, which says into how many parts the token is dealt.
    """
    floor = int(2.0 ** (np.median(level) / 8))
    sent = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = sent.value
        mask, low = np.uint64(len(counters) - 1), np.uint64(0xFF)
        for batch in batches:
            for part, s, ends in _sets_of(batch, k):
                n = np.diff(ends)
                size = np.where(n > 0, n - -(-num * n // den) + 1, 0)
                rank = counters[(s & mask).astype(np.intp)]
                key = rank.astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
                digest, prefix_digest, first, marks = [], [], [], np.zeros((len(n), 64 * MARKS), bool)
                spot = (s & np.uint64(64 * MARKS - 1)).astype(np.intp)
                for i, (a, b, p) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), size.tolist(), strict=True)):
                    digest.append(xxhash.xxh3_128_digest(s[a:b]))
                    at = a + np.argsort(key[a:b], kind="stable")[:p]
                    prefix_digest.append(xxhash.xxh3_128_digest(s[at]))
                    first.append(at)
                    marks[i] = np.bincount(spot[a:b], minlength=64 * MARKS) & 1
                at = np.concatenate(first) if first else np.zeros(0, np.intp)
                prefix = (s[at] & ~low | _parts(rank[at], floor)).view(np.int64)
                marks = np.packbits(marks, axis=1).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(prefix_digest, pa.binary()), _list(prefix, np.r_[0, np.cumsum(size)]), _list(marks, MARKS * np.arange(len(n) + 1))],
                    ["id", "n", "digest", "prefix_digest", "prefix", "marks"],
                )

    out = cut(docs.mapInArrow(tidy(run), "id long, n int, digest binary, prefix_digest binary, prefix array<long>, marks array<long>"))
    sent.destroy()
    return out


def _postings(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, n, m, pos, token) of each group's prefix.

    Only rows that a bitmap holds for members of larger groups are joined with the
    groups; the others are surely alone and keep their prefix where it is.
    """
    key, several = F.xxhash64("n", "prefix_digest").alias("key"), groups.where("copies > 1")
    bits = bits_for(several.count())
    sent = sets.sparkSession.sparkContext.broadcast(id_bits(several.select(key), "key", bits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            h = batch["bit"].to_numpy()
            yield batch.drop_columns(["bit"]).append_column("alone", pa.array(bitmap[h >> 3] >> (h & 7) & 1 == 0))

    rows = sets.select(F.col("id").alias("gid"), "n", "prefix_digest", "prefix", F.pmod(F.xxhash64(key), F.lit(1 << bits)).alias("bit"))
    rows = rows.mapInArrow(tidy(run), "gid long, n int, prefix_digest binary, prefix array<long>, alone boolean")
    alone = rows.where("alone").select("gid", "n", F.lit(1).alias("m"), "prefix")
    first = rows.where("not alone").join(groups, ["gid", "n", "prefix_digest"]).select("gid", "n", "m", "prefix")
    return alone.union(first).select("gid", "n", "m", F.posexplode("prefix").alias("pos", "token"))


def _part(of: str) -> Column:
    """The part of its token to which a row goes, by the column ``of``."""
    return F.pmod(F.xxhash64(of), F.expr(PARTS)).alias("part")


def _every_part(tokens: DataFrame) -> DataFrame:
    """``tokens`` once for each part of each token."""
    return tokens.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(PARTS) - 1)))


def _shared(postings: DataFrame, num: int, den: int) -> DataFrame:
    """The postings whose token two groups may share, or whose group has several members.

    Adds the group before it in the same part of its token and the first one of about
    its size there, and ``bucket``, that size. Each task streams through its sorted
    postings and remembers one row. Tokens of several parts count as shared.
    """
    names = ["token", "part", "n", "gid", "pos", "m"]
    steps = np.log(den / num)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row seen, not yet sent, its partners, and whether the row before shares its token
        held: dict | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {x: batch[x].to_numpy() for x in names}
            if held:
                c = {x: np.r_[held[x], c[x]] for x in names}
            size = len(c["token"])
            same = np.r_[False, (c["token"][1:] == c["token"][:-1]) & (c["part"][1:] == c["part"][:-1])]
            c["bucket"] = np.floor(np.log(c["n"]) / steps)
            new = ~same | np.r_[True, c["bucket"][1:] != c["bucket"][:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(size), 0))
            out = {}
            for x in ("gid", "n", "pos"):
                out[f"prev_{x}"], out[f"first_{x}"] = np.where(same, np.r_[0, c[x][:-1]], -1), c[x][start]
            if held:
                out |= {x: np.r_[held[x], v[1:]] for x, v in out.items()}
                goes_on = start == 0
                for x in ("gid", "n", "pos"):
                    out[f"first_{x}"][goes_on] = held[f"first_{x}"]
            shared = same | np.r_[same[1:], False] | (c["m"] > 1) | (c["token"] & 0xFF > 0)
            if held:
                shared[0] |= held["shared"]
            done = np.flatnonzero(shared[:-1])
            if len(done):
                yield _rows(c | out, done)
            held = {x: v[-1] for x, v in (c | out).items()} | {"shared": bool(shared[-1])}
        if held and held["shared"]:
            yield _rows({x: np.array([v]) for x, v in held.items()}, np.array([0]))

    kinds = {x: "long" if "gid" in x or x == "token" else "int" for x in [*names, "bucket", *(f"{a}_{x}" for a in ("prev", "first") for x in ("gid", "n", "pos"))]}

    def _rows(c: dict, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[x][at].astype(np.int64 if k == "long" else np.int32)) for x, k in kinds.items()], list(kinds))

    rows = postings.select("token", _part("gid").cast("int").alias("part"), "n", "gid", "pos", "m").repartition("token", "part")
    return rows.sortWithinPartitions("token", "part", "n", "gid").mapInArrow(tidy(run), ", ".join(f"{x} {k}" for x, k in kinds.items()))


def _across_parts(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of the first group of each part of a token and size, and the first of all parts."""
    first = shared.where((F.col("token").bitwiseAND(0xFF) > 0) & (F.col("gid") == F.col("first_gid"))).groupBy("token", "bucket", "part").agg(F.min(F.struct("n", "gid", "pos")).alias("own"))
    of_all = first.groupBy("token", "bucket").agg(F.min("own").alias("least"))
    both = first.join(of_all, ["token", "bucket"])
    return both.where(_possible(F.col("own.n"), F.col("own.pos"), F.col("least.n"), F.col("least.pos"), num, den)).select(F.col("own.gid").alias("a"), F.col("least.gid").alias("b"))


def _possible(n1: Column, pos1: Column, n2: Column, pos2: Column, num: int, den: int) -> Column:
    """Length filter, and the overlap that is left from the first common token on."""
    least = F.ceil(num * (n1 + n2) / (num + den) - 1e-6)
    return (den * F.least(n1, n2) >= num * F.greatest(n1, n2)) & (1 + F.least(n1 - pos1 - 1, n2 - pos2 - 1) >= least)


def _least_overlap(n, num: int, den: int):
    """The smallest overlap of two linked sets of ``n`` tokens together."""
    return -(-num * n // (num + den))


def _forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges of a spanning forest of light edges: each component takes its lightest edge, again and again."""
    _, ends = np.unique(np.r_[a, b], return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    size, at, out = int(ends.max(initial=-1)) + 1, np.argsort(weight, kind="stable"), []
    x, y = x[at], y[at]
    while len(at):
        n = len(at)
        both = np.r_[x, y]
        place = np.r_[np.arange(n), np.arange(n)]
        first = np.full(size, n)
        np.minimum.at(first, both, place)
        used = np.unique(first[first < n])
        out.append(at[used])
        root = np.arange(size)
        while True:
            new = root.copy()
            np.minimum.at(new, x[used], root[y[used]])
            np.minimum.at(new, y[used], root[x[used]])
            new = new[new]
            if (new == root).all():
                break
            root = new
        x, y = root[x], root[y]
        x, y, at = x[x != y], y[x != y], at[x != y]
    return np.concatenate(out) if out else np.zeros(0, int)


def _distinct_lists(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """Of the posting lists with the same members, the one whose token comes first.

    Tokens have one order, so the first token of such lists comes first in each member,
    and the first common token of two members is that one or one before it: the later
    lists add no pair. Lists with an id of several sets (``twice``) all stay.
    """
    def added(i: int) -> Column:
        return F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(i), "rep"), 32)).alias(f"h{i}")

    kinds = rows.join(twice.withColumn("twice", F.lit(True)), "rep", "left")
    lists_ = kinds.groupBy("token").agg(F.count("*").alias("size"), *map(added, range(3)), F.sum("pos").alias("place"), F.max("twice").alias("twice"))
    first = lists_.groupBy("size", "h0", "h1", "h2", F.when(F.col("twice"), F.col("token"))).agg(F.min_by("token", F.struct("place", "token")).alias("token"))
    return rows.join(_every_part(first.select("token")), ["token", "part"], "left_semi")


def _open_lists(rows: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (token, n, pos, rep) of the posting lists that span several components, with
    the component ``c`` and the other columns of ``sets``, and the number of ``blocks`` of the list."""
    more = [c for c in rows.columns if c == "many"]
    rows = rows.join(found, rows.rep == found.node, "left").select("token", "part", "n", "pos", "rep", F.coalesce("component", "rep").alias("c"), *more)
    # a block has about BLOCK members, fewer where their sets are large
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / (512 * BLOCK)))
    several = rows.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), blocks.alias("blocks")).where("c1 <> c2").select("token", "blocks")
    return rows.join(_every_part(several), ["token", "part"]).drop("part").join(sets.withColumnRenamed("id", "rep"), "rep")


def _tiles(rows: DataFrame, num: int, den: int, what: str) -> DataFrame:
    """Pairs (a, b) of ``_open_lists`` that share a token but not the component ``c`` and pass all filters.

    ``all`` of them, or those of a spanning ``forest`` of each tile's components; then a
    row (null, null, token, pairs, members) tells how many pairs each tile left out. For
    ``links`` the pairs' sets ``s`` are compared, and a spanning forest of the links returned.
    """
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # a row of a list of one block is sent once; of a longer list to the tile of its block and each other one
    own = ["rep", "n", "pos", "c", "marks", *(["s"] if what == "links" else [])]
    tile = ["token", "low", "high"]
    rows = rows.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") == F.least("block", "other")).alias("left"), *own)

    def pairs_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        c = {x: t[x].to_numpy(zero_copy_only=False) for x in ("rep", "n", "pos", "c", "left")}
        marks = t["marks"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, MARKS)
        two = t["low"][0].as_py() < t["high"][0].as_py()
        x = y = np.arange(len(c["rep"]))
        if two:
            x, y = x[c["left"]], x[~c["left"]]
        found = []
        for at in range(0, len(x), 256):  # so that what compares rows stays small
            p = x[at : at + 256, None]
            n = c["n"][p] + c["n"][None, y]
            least = _least_overlap(n, num, den)
            ok = (c["c"][p] != c["c"][None, y]) & (den * np.minimum(c["n"][p], c["n"][None, y]) >= num * np.maximum(c["n"][p], c["n"][None, y]))
            ok &= 1 + np.minimum(c["n"][p] - c["pos"][p] - 1, (c["n"] - c["pos"] - 1)[None, y]) >= least
            if not two:
                ok &= p < y[None]
            i, j = np.nonzero(ok)
            for at2 in range(0, len(i), 50_000):
                p2, q2 = i[at2 : at2 + 50_000], j[at2 : at2 + 50_000]
                differ = np.bitwise_count(marks[x[at + p2]] ^ marks[y[q2]]).sum(1, dtype=np.int32)
                good = differ <= n[p2, q2] - 2 * least[p2, q2]
                found.append((x[at + p2[good]], y[q2[good]], (differ / n[p2, q2])[good]))
        if not found or not sum(len(f[0]) for f in found):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        i, j, weight = map(np.concatenate, zip(*found, strict=True))
        if what == "all":
            kept = np.arange(len(i))
        elif what == "links":
            kept = np.array(_linked(i, j, weight, c["c"], t["s"].combine_chunks(), num, den), int)
        else:
            kept = _forest(c["c"][i], c["c"][j], weight)
        return c["rep"][i[kept]], c["rep"][j[kept]], len(i) - len(kept) if what == "forest" else 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray, left: list[tuple[int, int, int]]) -> pa.RecordBatch:
            void, none = pa.nulls(len(left), pa.int64()), pa.nulls(len(a), pa.int64())
            said = [pa.concat_arrays([none, pa.array([x[i] for x in left], pa.int64())]) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a), void]), pa.concat_arrays([pa.array(b), void]), *said], ["a", "b", "token", "pairs", "members"])

        held: list[pa.RecordBatch] = []

        def judged(last: bool) -> Iterator[pa.RecordBatch]:
            """The tiles that ended; the last one may go on and is kept."""
            t = pa.Table.from_batches(held)
            keys = [t[x].to_numpy() for x in tile]
            edges = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), t.num_rows]
            held[:] = [] if last else t.slice(edges[-2]).to_batches()
            for a, b in zip(edges[:-1] if last else edges[:-2], edges[1:], strict=False):
                if b - a > 1:
                    low, high, left = pairs_of(t.slice(a, b - a))
                    if len(low) or left:
                        yield out(low, high, [(int(keys[0][a]), left, b - a)] if left else [])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from judged(False)
        if held:
            yield from judged(True)

    return rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(tidy(run), "a long, b long, token long, pairs long, members long")


def _linked(i: np.ndarray, j: np.ndarray, weight: np.ndarray, c: np.ndarray, s: pa.ListArray, num: int, den: int) -> list[int]:
    """Places of the pairs whose sets are similar enough, the most alike first, without those that are connected by then."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    flat, ends, out = s.flatten().to_numpy(), np.r_[0, np.cumsum(s.value_lengths().to_numpy())], []
    for at in np.argsort(weight, kind="stable").tolist():
        a, b = top(int(c[i[at]])), top(int(c[j[at]]))
        if a != b:
            x, y = (flat[ends[r] : ends[r + 1]] for r in (i[at], j[at]))
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            if den * common >= num * (len(both) - common):
                root[a] = b
                out.append(at)
    return out


def _alike(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose bitmaps do not differ too much."""
    def of(x: str) -> DataFrame:
        return sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("marks").alias(f"marks_{x}"))

    differ = F.aggregate(F.zip_with("marks_a", "marks_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    n = F.col("n_a") + F.col("n_b")
    return pairs.join(of("a"), "a").join(of("b"), "b").where(differ <= n - 2 * F.ceil(num * n / (num + den) - 1e-6)).select("a", "b")


def _whole_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, s) of the documents of ``ids(id)``, which has each id once."""
    bits = bits_for(ids.count())
    needed = docs.sparkSession.sparkContext.broadcast(id_bits(ids, "id", bits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = needed.value
        for batch in batches:
            h = batch["bit"].to_numpy()
            batch = batch.filter(pa.array(bitmap[h >> 3] >> (h & 7) & 1 == 1))
            if batch.num_rows:
                for part, s, ends in _sets_of(batch, k):
                    yield pa.RecordBatch.from_arrays([part["id"], _list(s.view(np.int64), ends)], ["id", "s"])

    sets = docs.where("id is not null").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("bit")).mapInArrow(tidy(run), "id long, s array<long>")
    return sets.join(ids, "id", "left_semi")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    pairs = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = _whole_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), k)
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return cut(both.where(den * common >= num * (F.size("sa") + F.size("sb") - common)).select("a", "b"))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links, which are written; without any they stay as they are."""
    if links.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of each row: documents link if the
    Jaccard similarity of their sets is at least ``num / den``; ``component_id`` is the
    least id that is reachable by links, the row's own included. ``bits`` sets the number
    of counters, which else follows the bytes of the texts."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    if bits is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 1
        bits = min(MOST_BITS, max(18, math.ceil(math.log2(size / 512))))
    sets = _sets(docs, k, frequencies(docs, k, bits), num, den)
    own = sets.where("n > 0 and id is not null")
    classes = cut(own.groupBy("n", "prefix_digest", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    groups = cut(classes.groupBy("n", "prefix_digest").agg(F.min("rep").alias("gid"), F.count("*").cast("int").alias("m"), F.sum("copies").alias("copies")))
    shared = cut(_shared(_postings(own, groups), num, den))
    members = cut(classes.join(groups.where("m > 1"), ["n", "prefix_digest"]).select("gid", "rep"))

    def partner(p: str) -> DataFrame:
        return shared.where(F.col(f"{p}_gid") >= 0).where(_possible(F.col("n"), F.col("pos"), F.col(f"{p}_n"), F.col(f"{p}_pos"), num, den)).select(F.col("gid").alias("a"), F.col(f"{p}_gid").alias("b"))

    near = partner("prev").union(partner("first")).union(_across_parts(shared, num, den)).union(members.select(F.col("gid").alias("a"), F.col("rep").alias("b")))
    own = own.select("id", "n", "marks")
    found = components(_verified(docs, _alike(near.where("a <> b").distinct(), own, num, den), k, num, den))

    rows = shared.select("token", "gid", "n", "pos").join(members, "gid", "left").select("token", "n", "pos", F.coalesce("rep", "gid").alias("rep")).withColumn("part", _part("rep"))
    rows = cut(_distinct_lists(rows, classes.groupBy("rep").count().where("count > 1").select("rep")))
    marks = own.select("id", "marks")
    rest = cut(_tiles(_open_lists(rows, found, marks), num, den, "forest"))
    found = _joined(found, _verified(docs, rest.where("a is not null").select("a", "b"), k, num, den))
    left = rest.where("token is not null").groupBy("token").agg((F.sum("pairs") > MANY * F.sum("members")).alias("many"))
    rows = cut(_open_lists(rows.join(_every_part(left), ["token", "part"]), found, marks))
    found = _joined(found, _verified(docs, _tiles(rows.where("not many"), num, den, "all").select("a", "b"), k, num, den))
    rows = rows.where("many")
    if not rows.isEmpty():
        rows = rows.join(_whole_sets(docs, rows.select(F.col("rep").alias("id")).distinct(), k).withColumnRenamed("id", "rep"), "rep")
        found = _joined(found, cut(_tiles(rows, num, den, "links")).select("a", "b"))

    copies = classes.where("copies > 1").select("digest", "rep")
    out = sets.select("id", "n", "digest").join(copies, "digest", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    out = out.join(found, out.rep == found.node, "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
