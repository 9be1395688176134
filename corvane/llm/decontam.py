"""Benchmark decontamination: a prefix-filtered set join of documents and item windows.

A window is ``window`` consecutive words of an item (the whole item if it is
shorter); equal windows count once, with all their items. Its set is that of its word
shingles. A document holds the window only if it holds all of them, so one shingle is a
sufficient prefix: the one that is rarest in the documents, by hashed counters over all
of them. Documents' shingles are joined with these prefix tokens; a hit fixes where the
window would lie in the document. It must lie inside the text (length and positional
bound), and its words are then compared: by their hashes, then byte by byte. A text of
one repeated word has one window, so work is in proportion to its words.

The windows go to the tasks in blocks of at most about ``block_bytes`` of items, so what
is broadcast is bounded at any size of the benchmark. With one block the documents are
never shuffled. With more, each block's hits are found in a scan of its own, as rows of
a text's digest and its spans, and joined to the documents by that digest; no text is
written in between.

Defined results: null and empty texts have no words and no hits; an item without
words is in no document; rows are judged one by one, so repeated rows repeat their
result; items with a null id hit words but are not listed; ties in rarity go to the
smaller hash. An empty benchmark or an empty table of documents is no error. The new
columns replace columns of their names; ``prefix`` gives them others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ALNUM, OWN, all_shingles, alnum_words, block_sums, hashed_words, pieces, shingles, tidy

#: Hashed counters of the documents' shingles (4 MB).
COUNTERS = 1 << 20
#: Places of the bitmap in front of the search for a token.
_BITS = 1 << 20
#: Pairs of a token in a document and a window that are compared at once.
_AT_ONCE = 100_000


@dataclass
class Tokens:
    """Sorted shingle hashes with a bitmap in front of the search."""

    hashes: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> Tokens:
        bitmap = np.zeros(_BITS, bool)
        bitmap[hashes & np.uint64(_BITS - 1)] = True
        return cls(hashes, bitmap)

    def find(self, of_document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the document that have a token, and which."""
        at = np.flatnonzero(self.bitmap[of_document & np.uint64(_BITS - 1)])
        if not len(at):
            return at, at
        which = np.minimum(np.searchsorted(self.hashes, of_document[at]), len(self.hashes) - 1)
        same = self.hashes[which] == of_document[at]
        return at[same], which[same]


@dataclass
class Windows:
    """The distinct windows of one length, by their prefix tokens."""

    length: int
    shingle: int
    tokens: Tokens
    bounds: np.ndarray  # of each token's windows
    offset: np.ndarray  # the token's place in the window
    start: np.ndarray  # the window's place among the words of all items
    item_bounds: np.ndarray  # of each window's items
    items: np.ndarray


@dataclass
class Index:
    """The windows of one block of items."""

    ids: list[str | None]
    words: np.ndarray  # hashes of the words of all items
    text: bytes  # these words with a blank after each
    at: np.ndarray  # where each word begins, and the end
    windows: list[Windows]


def _index(ids: list[str | None], some: list[bytes], counts: np.ndarray, window: int, k: int) -> Index:
    """Each distinct window under its rarest shingle; windows with one that no document has are left out."""
    words = [alnum_words(t) for t in some]
    hashed, ends = hashed_words(some, ALNUM)
    size = np.diff(ends)
    out = []
    for length in sorted({min(window, n) for n in size.tolist() if n}):
        n = min(k, length)
        of = np.flatnonzero(size >= window) if length == window else np.flatnonzero(size == length)
        start = np.concatenate([np.arange(ends[i], ends[i + 1] - length + 1) for i in of.tolist()])
        item = np.repeat(of, size[of] - length + 1)
        whole = shingles_at(hashed, start, length)
        _, first, which = np.unique(whole, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([which, item], 1), axis=0)
        token = shingles_at(hashed, start[first][:, None] + np.arange(length - n + 1), n)
        count = counts[(token & np.uint64(len(counts) - 1)).astype(np.intp)]
        # the least of (count, hash): the tokens whose count is the least, then the smallest of them
        least = count.min(1, keepdims=True)
        best = np.where(count == least, token, np.uint64((1 << 64) - 1)).argmin(1)
        held = least[:, 0] > 0
        prefix, rows = token[np.arange(len(first)), best], np.flatnonzero(held)
        rows = rows[np.argsort(prefix[rows], kind="stable")]
        used, at = np.unique(prefix[rows], return_index=True)
        item_bounds = np.searchsorted(pairs[:, 0], np.r_[rows, -1])
        item_ends = np.searchsorted(pairs[:, 0], rows, "right")
        many = item_ends - item_bounds[:-1]
        flat = pairs[np.repeat(item_bounds[:-1] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()), 1] if len(rows) else pairs[:0, 1]
        out.append(Windows(length, n, Tokens.of(used), np.r_[at, len(rows)], best[rows], start[first][rows], np.r_[0, np.cumsum(many)], flat))
    flat = [w for ws in words for w in ws]
    return Index(ids, hashed, b"".join(w + b" " for w in flat), np.cumsum([0, *(len(w) + 1 for w in flat)]), out)


def shingles_at(words: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """The shingle of ``n`` words that begins at each place."""
    return shingles(words, n)[start] if len(words) >= n else np.zeros(start.shape, np.uint64)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hits(index: Index, some: list[bytes], hashed: np.ndarray, ends: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """Of each text with hits: the spans of hit words, and the items."""
    found: dict[int, tuple[list, set]] = {}
    words: dict[int, list[bytes]] = {}
    of_length: dict[int, tuple] = {}
    for w in index.windows:
        if not len(w.tokens.hashes):
            continue
        if w.shingle not in of_length:
            of_length[w.shingle] = all_shingles(hashed, ends, w.shingle)
        s, s_ends = of_length[w.shingle]
        at, which = w.tokens.find(s)
        if not len(at):
            continue
        text = np.searchsorted(s_ends, at, "right") - 1
        place = at - s_ends[text] + ends[text]
        many = w.bounds[which + 1] - w.bounds[which]
        total = np.r_[0, np.cumsum(many)]
        for low in range(0, int(total[-1]), _AT_ONCE):
            n = np.arange(low, min(low + _AT_ONCE, int(total[-1])))
            i = np.searchsorted(total, n, "right") - 1
            window = w.bounds[which[i]] + n - total[i]
            start, t = place[i] - w.offset[window], text[i]
            inside = (start >= ends[t]) & (start + w.length <= ends[t + 1])
            start, t, window = start[inside], t[inside], window[inside]
            same = np.ones(len(start), bool)
            for x in range(w.length):
                same &= hashed[np.where(same, start + x, 0)] == index.words[w.start[window] + x]
            for a, r, v in zip(start[same].tolist(), t[same].tolist(), window[same].tolist(), strict=True):
                if r not in words:
                    words[r] = alnum_words(some[r])
                a, b = a - int(ends[r]), int(w.start[v])
                if b"".join(x + b" " for x in words[r][a : a + w.length]) != index.text[index.at[b] : index.at[b + w.length]]:
                    continue
                spans, items = found.setdefault(r, ([], set()))
                if spans and a <= spans[-1][1] and a >= spans[-1][0]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], a + w.length))
                else:
                    spans.append((a, a + w.length))
                items.update(index.ids[j] for j in w.items[w.item_bounds[v] : w.item_bounds[v + 1]].tolist())
    return {r: (merged(spans), items - {None}) for r, (spans, items) in found.items()}


def shingle_counts(docs: DataFrame, lengths: list[int]) -> np.ndarray:
    """How often shingles of these lengths occur in ``docs(text)``, in hashed counters."""

    def count(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for _, some in pieces(batch, "text"):
                words = hashed_words(some, ALNUM)
                for n in lengths:
                    np.add.at(total, (all_shingles(*words, n)[0] & np.uint64(COUNTERS - 1)).astype(np.intp), np.uint32(1))
        return total

    return block_sums(docs, COUNTERS, count) if lengths else np.zeros(COUNTERS, np.int64)


def _spans(df: DataFrame, text: str, index, state: dict[str, str], only_hits: bool) -> DataFrame:
    """``df`` with the columns of ``state``, from a broadcast index or none; with ``only_hits`` the rows that have hits."""
    kinds = {"n_words": pa.int64(), "from": pa.list_(pa.int32()), "to": pa.list_(pa.int32()), "items": pa.list_(pa.string())}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in pieces(batch, text):
                hashed, ends = hashed_words(some, ALNUM)
                found = _hits(index.value, some, hashed, ends) if index is not None else {}
                rows = sorted(found) if only_hits else range(len(some))
                none: tuple = ([], set())
                columns = {
                    "n_words": np.diff(ends)[list(rows)] if only_hits else np.diff(ends),
                    "from": [[a for a, _ in found.get(r, none)[0]] for r in rows],
                    "to": [[b for _, b in found.get(r, none)[0]] for r in rows],
                    "items": [sorted(found.get(r, none)[1]) for r in rows],
                }
                if only_hits:
                    part = part.take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(columns[c], kinds[c]) for c in state)], [*part.schema.names, *state.values()])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(tidy(run), schema + f", `{state['n_words']}` bigint, `{state['from']}` array<int>, `{state['to']}` array<int>, `{state['items']}` array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 3, block_bytes: int = 8 << 20, prefix: str = "") -> DataFrame:
    """Add to each row ``n_words``, ``hit_from`` and ``hit_to`` (disjoint runs of hit
    words, end exclusive), ``n_hit``, ``items`` (ids as sorted strings) and ``n_items``.

    ``prefix`` goes before the new columns' names, for tables that have such names.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    names = {c: f"{prefix}{c}" for c in ("n_words", "hit_from", "hit_to", "n_hit", "items", "n_items")}
    state = {c: f"{OWN}{c}" for c in ("n_words", "from", "to", "items")}
    plain = docs.select(F.col(text).alias("text"))
    counts = shingle_counts(plain, list(range(1, shingle + 1)) if size else [])

    def block(b: int):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()  # at most about block_bytes, by the number of blocks
        return sc.broadcast(_index([r.id for r in rows], [r.text.encode() for r in rows], counts, window, shingle))

    if blocks == 1:
        out = _spans(docs, text, block(0) if size else None, state, only_hits=False)
    else:
        digest = f"{OWN}digest"
        keyed = plain.where("text is not null").select(F.md5(F.encode("text", "UTF-8")).alias("key"), "text")
        hits = [_spans(keyed, "text", block(b), state, only_hits=True).select("key", F.lit(b).alias("b"), state["from"], state["to"], state["items"]).dropDuplicates(["key"]) for b in range(blocks)]
        hits = _merged_rows(reduce(DataFrame.union, hits), state).withColumnRenamed("key", f"{OWN}key")  # at most one row of each block for a text
        out = _spans(docs, text, None, {**state, "from": f"{OWN}a", "to": f"{OWN}b", "items": f"{OWN}c"}, only_hits=False).drop(f"{OWN}a", f"{OWN}b", f"{OWN}c")
        out = out.withColumn(digest, F.md5(F.encode(F.col(text), "UTF-8"))).join(hits, F.col(digest) == F.col(f"{OWN}key"), "left")
        for c, kind in (("from", "array<int>"), ("to", "array<int>"), ("items", "array<string>")):
            out = out.withColumn(state[c], F.coalesce(state[c], F.array().cast(kind)))

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)

    return out.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in names.values()),
        F.col(state["n_words"]).alias(names["n_words"]),
        F.col(state["from"]).alias(names["hit_from"]),
        F.col(state["to"]).alias(names["hit_to"]),
        (total(state["to"]) - total(state["from"])).alias(names["n_hit"]),
        F.col(state["items"]).alias(names["items"]),
        F.size(state["items"]).cast("long").alias(names["n_items"]),
    )


def _merged_rows(hits: DataFrame, state: dict[str, str]) -> DataFrame:
    """One row (key, from, to, items) of each text from those of the blocks."""
    spans = F.flatten(F.collect_list(F.arrays_zip(F.col(state["from"]).alias("a"), F.col(state["to"]).alias("b"))))
    rows = hits.groupBy("key").agg(F.array_sort(spans).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(state["items"])))).alias(state["items"]))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (x["a"] <= last["b"])
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(joins, longer).otherwise(F.concat(acc, F.array(x)))

    both = F.aggregate("spans", F.array().cast("array<struct<a:int,b:int>>"), step)
    return rows.withColumn("spans", both).select("key", F.transform("spans", lambda x: x["a"]).alias(state["from"]), F.transform("spans", lambda x: x["b"]).alias(state["to"]), state["items"])


def is_contaminated(n_words: str = "n_words", n_hit: str = "n_hit") -> Column:
    """Some words are hit, and at least a twentieth of all."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
