"""Ranked lexical search over a tiered index, exact.

A document's score for an item is the sum, over the item's terms, of the term's weight
times the posting's impact, both whole numbers. The index has one row a document with
its postings, and each term's postings lie in tiers: those of high impact first, a
sixty-fourth of the documents deep, then a sixteenth, then the rest. Of each term and
tier the residual bound is known, the greatest impact in lower tiers.

Searching goes in three steps. The highest tier alone gives each item its most promising
documents; these are scored in full, and the k-th best of them is a threshold that the
answer cannot fall below. An item is proven at a tier if its terms' residual bounds
below it add up to less than the threshold: a document that is in none of its lists down
to that tier cannot be in the answer. Items without proof fall through to the next
tier; at the last one nothing is left out. At its tier an item takes the documents whose
scores so far and bounds reach the threshold, scores these in full, and keeps the best.

Documents stay in the tasks that read them; what is exchanged is counts for each term
and the k best of each task and item. Items go in blocks of about ``block_bytes`` of
text, so that what is sent to the tasks is bounded at any number of items: a block's
terms and, for each of them, its items, weights and bounds. A block has an index of its
terms alone, which is deleted when the block is answered; each further block reads the
documents once more.

Defined results: null and empty texts have no terms and are not counted; items without
terms have no answer; documents with a score of 0 are not listed; equal scores ascend by
document id, null ids last. Rows that share an id are documents of their own, and so are
items that share an id but not the text; items alike in both count once. Empty tables
give an empty result. Only the named columns are read, so further columns may have any
names. Document ids must be whole numbers.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import alnum_words, checkpoint_dir, cut, lists, pieces, slices, tidy

#: Depth of each tier but the last, as a share of the documents.
DEPTHS = (1 / 64, 1 / 16)
#: Impacts are below 1,000,000; those that agree but for so many low bits share a tier.
_SHIFT = 12
#: Documents an item may name for the threshold, for each one that it wants.
_PROMISING = 2
#: Cells (document and item) that are added up at once.
_CELLS = 1 << 20


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Impact of postings from the term's occurrences and the document's length, in 64-bit integers."""
    m = 25 + (75 * n * documents) // max(1, terms)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def postings(docs: DataFrame, vocabulary: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, terms, tfs) of each document: its length in terms, and how often it has each term of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(sent.value)}.get
        for batch in batches:
            for part, some in pieces(batch, "text"):
                n, terms, tfs = [], [], []
                for t in some:
                    words = alnum_words(t)
                    found = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                    each, tf = np.unique(found[found >= 0], return_counts=True)
                    n.append(len(words))
                    terms.append(each)
                    tfs.append(tf)
                yield pa.RecordBatch.from_arrays([part["doc"], pa.array(n, pa.int64()), lists(terms, pa.int32()), lists(tfs, pa.int64())], ["doc", "n", "terms", "tfs"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).mapInArrow(tidy(run), "doc long, n long, terms array<int>, tfs array<long>")


@dataclass
class TieredIndex:
    """``rows`` (row, doc, terms, impacts, tiers) in a folder, and by term the weights and residual bounds."""

    rows: DataFrame
    path: str
    weights: np.ndarray
    #: residual[j][t]: the greatest impact of term t below tier j
    residual: np.ndarray

    @property
    def last(self) -> int:
        return len(self.residual) - 1


def build(docs: DataFrame, vocabulary: list[bytes], doc_id: str = "doc_id", text: str = "text", depths: tuple[float, ...] = DEPTHS) -> TieredIndex:
    """Index every document by the terms of a vocabulary, which must be small enough to be sent to every task.

    To the driver come one row a term: its documents, and its bounds.
    """
    spark = docs.sparkSession
    top = f"{checkpoint_dir(spark)}/search-{uuid.uuid4().hex}"
    postings(docs, vocabulary, doc_id, text).write.parquet(f"{top}/postings")
    counted = spark.read.parquet(f"{top}/postings")
    documents, terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        term, ends = slices(batch["terms"])
        tf, _ = slices(batch["tfs"])
        n = np.repeat(batch["n"].to_numpy(), np.diff(ends))
        return term, impacts(tf.astype(np.int64), n, documents, terms), ends

    def by_level(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, impact, _ = flat(batch)
            order = np.lexsort((impact, term))
            key = (term[order].astype(np.int64) << 32) | (impact[order] >> _SHIFT)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            after = np.append(first[1:], len(key))[: len(first)]
            yield pa.RecordBatch.from_arrays([pa.array(key[first] >> 32, pa.int32()), pa.array(key[first] & 0xFFFFFFFF, pa.int32()), pa.array(after - first, pa.int64()), pa.array(impact[order][after - 1], pa.int64())], ["term", "level", "many", "most"])

    levels = counted.select("n", "terms", "tfs").mapInArrow(tidy(by_level), "term int, level int, many long, most long").groupBy("term", "level").agg(F.sum("many").alias("many"), F.max("most").alias("most"))
    down = Window.partitionBy("term").orderBy(F.desc("level"))  # at most 10**6 >> _SHIFT rows a term
    deep = [max(64, math.ceil(documents * d)) for d in depths]
    tier = reduce(lambda rest, j: F.when(F.sum("many").over(down) <= deep[j], j).otherwise(rest), reversed(range(len(deep))), F.lit(len(deep)))
    levels = levels.withColumn("tier", tier)
    bounds = [F.coalesce(F.max(F.when(F.col("tier") > j, F.col("most"))), F.lit(0)).alias(f"residual{j}") for j in range(len(deep))]
    starts = [F.coalesce(F.min(F.when(F.col("tier") <= j, F.col("level"))), F.lit(1 << 30)).alias(f"start{j}") for j in range(len(deep))]
    weights, residual = np.zeros(len(vocabulary), np.int64), np.zeros((len(deep) + 1, len(vocabulary)), np.int64)
    start = np.full((len(deep), len(vocabulary)), 1 << 30)
    for r in levels.groupBy("term").agg(F.sum("many").alias("df"), *bounds, *starts).collect():
        weights[r.term] = weight(documents, r.df)
        for j in range(len(deep)):
            residual[j, r.term], start[j, r.term] = r[f"residual{j}"], r[f"start{j}"]
    sent = spark.sparkContext.broadcast(start)

    def tiered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, impact, ends = flat(batch)
            tier = (impact >> _SHIFT < sent.value[:, term]).sum(0).astype(np.int8)
            offsets = pa.array(ends, pa.int32())
            columns = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((term, pa.int32()), (impact, pa.int32()), (tier, pa.int8()))]
            yield pa.RecordBatch.from_arrays([batch["doc"], *columns], ["doc", "terms", "impacts", "tiers"])

    rows = counted.mapInArrow(tidy(tiered), "doc long, terms array<int>, impacts array<int>, tiers array<tinyint>")
    rows.select(F.monotonically_increasing_id().alias("row"), "*").write.parquet(f"{top}/index")
    _remove(spark, f"{top}/postings")
    return TieredIndex(spark.read.parquet(f"{top}/index"), top, weights, residual)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@dataclass
class Asked:
    """Items by term: ``items[start[t]:start[t + 1]]`` have term t, each with its weight times its repeats."""

    start: np.ndarray
    items: np.ndarray
    worth: np.ndarray
    n: int

    @classmethod
    def of(cls, queries: list[dict[int, int]], weights: np.ndarray, chosen: Iterable[int] | None = None) -> Asked:
        """Of the chosen items, or of all; items keep their numbers' order and count from 0."""
        chosen = range(len(queries)) if chosen is None else list(chosen)
        rows = [(t, k, c * int(weights[t])) for k, i in enumerate(chosen) for t, c in queries[i].items() if weights[t] > 0]
        rows.sort()
        term, items, worth = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        return cls(np.searchsorted(term, np.arange(len(weights) + 1)), items, worth, len(chosen))

    def bound(self, residual: np.ndarray) -> np.ndarray:
        """What each item's terms can add below a tier."""
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.items, self.worth * np.repeat(residual, np.diff(self.start)))
        return out


@dataclass
class Postings:
    """Postings of some documents, as flat arrays with the document's place."""

    at: np.ndarray
    term: np.ndarray
    impact: np.ndarray
    tier: np.ndarray
    n: int

    def where(self, keep: np.ndarray) -> Postings:
        return Postings(self.at[keep], self.term[keep], self.impact[keep], self.tier[keep], self.n)

    def add(self, asked: Asked, into: np.ndarray, less: np.ndarray | None = None) -> None:
        """Add each posting's share to the cells (item, document) of all items that have the term.

        ``less`` is taken from the impact, by term.
        """
        impact = self.impact if less is None else self.impact - less[self.term]
        first, many = asked.start[self.term], np.diff(asked.start)[self.term]
        step = max(1, len(self.term) * _CELLS // max(1, int(many.sum())))  # about _CELLS shares at once
        for a in range(0, len(self.term), step):
            m = many[a : a + step]
            which = np.repeat(first[a : a + step] - np.cumsum(m) + m, m) + np.arange(m.sum())
            np.add.at(into, asked.items[which] * self.n + np.repeat(self.at[a : a + step], m), asked.worth[which] * np.repeat(impact[a : a + step], m))


def _parts(batches: Iterable[pa.RecordBatch], items: int) -> Iterator[tuple[pa.RecordBatch, Postings]]:
    size = max(1, min(8192, _CELLS // max(1, items)))
    for batch in batches:
        for a in range(0, batch.num_rows, size):
            part = batch.slice(a, size)
            term, ends = slices(part["terms"])
            impact, tier = slices(part["impacts"])[0].astype(np.int64), slices(part["tiers"])[0]
            yield part, Postings(np.repeat(np.arange(part.num_rows), np.diff(ends)), term, impact, tier, part.num_rows)


class Best:
    """The k best (score, then order) of each item among those that are put in."""

    def __init__(self, k: int):
        self.k, self.rows, self.many = k, [], 0

    def put(self, item: np.ndarray, score: np.ndarray, order: np.ndarray, *more: np.ndarray) -> None:
        self.rows.append((item, score, order, *more))
        self.many += len(item)
        if self.many > 200_000:
            self.rows = [self.kept()]
            self.many = len(self.rows[0][0])

    def kept(self) -> tuple[np.ndarray, ...]:
        columns = tuple(np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((columns[2], -columns[1], columns[0]))
        columns = tuple(c[order] for c in columns)
        first = np.searchsorted(columns[0], columns[0])
        keep = np.arange(len(first)) - first < self.k
        return tuple(c[keep] for c in columns)


def _promising(index: TieredIndex, asked: Asked, k: int) -> DataFrame:
    """(item, row, score): of each item the k documents with the greatest scores in the highest tier."""
    spark = index.rows.sparkSession
    sent = spark.sparkContext.broadcast(asked)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = sent.value, Best(k)
        for part, found in _parts(batches, asked.n):
            cells = np.zeros(asked.n * found.n, np.int64)
            found.where(found.tier == 0).add(asked, cells)
            cells = cells.reshape(asked.n, found.n)
            few = np.argpartition(-cells, min(k, found.n) - 1, axis=1)[:, :k]
            item = np.repeat(np.arange(asked.n), few.shape[1])
            score, row = cells[item, few.ravel()], part["row"].to_numpy()[few.ravel()]
            best.put(item[score > 0], score[score > 0], row[score > 0])
        if best.rows:
            item, score, row = best.kept()
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(row), pa.array(score)], ["item", "row", "score"])

    some = index.rows.select("row", "terms", "impacts", "tiers").mapInArrow(tidy(run), "item long, row long, score long")
    return _first(some, k, "row")


def _first(rows: DataFrame, k: int, *order: str) -> DataFrame:
    """Of each item the k rows with the greatest scores; each task has sent k at most."""
    best = Window.partitionBy("item").orderBy(F.desc("score"), *(F.asc_nulls_last(c) for c in order))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def thresholds(index: TieredIndex, asked: Asked, k: int) -> np.ndarray:
    """A score that each item's k-th best document reaches at least; 1 where fewer than k are known."""
    some: dict[int, list[int]] = {}
    for r in _promising(index, asked, _PROMISING * k).collect():
        some.setdefault(r.row, []).append(r.item)
    rows = np.array(sorted(some), np.int64)
    sent = index.rows.sparkSession.sparkContext.broadcast((asked, rows, some))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, rows, some = sent.value
        for part, found in _parts(batches, asked.n):
            own = part["row"].to_numpy()
            named = np.isin(own, rows)
            if named.any():
                cells = np.zeros(asked.n * found.n, np.int64)
                found.where(named[found.at]).add(asked, cells)
                pairs = [(i, at) for at in np.flatnonzero(named).tolist() for i in some[int(own[at])]]
                item, at = np.array(pairs, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(cells[item * found.n + at])], ["item", "score"])

    scored: dict[int, list[int]] = {}
    for r in index.rows.select("row", "terms", "impacts", "tiers").mapInArrow(tidy(run), "item long, score long").collect():  # _PROMISING * k rows an item
        scored.setdefault(r.item, []).append(r.score)
    return np.array([max(1, sorted(s, reverse=True)[k - 1]) if len(s := scored.get(i, [])) >= k else 1 for i in range(asked.n)], np.int64)


def proven_at(index: TieredIndex, asked: Asked, threshold: np.ndarray) -> np.ndarray:
    """The highest tier at which each item is proven; the last one needs no proof."""
    at = np.full(asked.n, index.last)
    for j in reversed(range(index.last)):
        at = np.where(asked.bound(index.residual[j]) < threshold, j, at)
    return at


def answers(index: TieredIndex, queries: list[dict[int, int]], k: int) -> DataFrame:
    """(item, rank, doc, score) of the k best documents of each query, a count of the terms' repeats."""
    asked = Asked.of(queries, index.weights)
    threshold = thresholds(index, asked, k)
    at = proven_at(index, asked, threshold)
    groups = []
    for j in range(index.last + 1):
        if len(chosen := np.flatnonzero(at == j)):
            own = Asked.of(queries, index.weights, chosen.tolist())
            groups.append((j, chosen, own, index.residual[j], own.bound(index.residual[j]), threshold[chosen]))
    sent = index.rows.sparkSession.sparkContext.broadcast((groups, asked.n))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (groups, n), best = sent.value, Best(k)
        for part, found in _parts(batches, n):
            doc = part["doc"]
            order = doc.fill_null(np.iinfo(np.int64).max).to_numpy()
            for j, chosen, own, residual, bound, threshold in groups:
                score, more = np.zeros(own.n * found.n, np.int64), np.zeros(own.n * found.n, np.int64)
                high = found.where(found.tier <= j)
                high.add(own, score)
                high.add(own, more, residual)
                able = (more.reshape(own.n, found.n) + bound[:, None] >= threshold[:, None]).ravel()
                if not able.any():
                    continue
                still = able.reshape(own.n, found.n).any(0)
                found.where((found.tier > j) & still[found.at]).add(own, score)
                cell = np.flatnonzero(able)
                item, row = np.divmod(cell, found.n)
                keep = score[cell] >= threshold[item]
                item, row = item[keep], row[keep]
                best.put(chosen[item], score[cell[keep]], order[row], doc.is_null().to_numpy(zero_copy_only=False)[row])
        if best.rows:
            item, score, doc, null = best.kept()
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=null.astype(bool)), pa.array(score)], ["item", "doc", "score"])

    found = index.rows.select("doc", "terms", "impacts", "tiers").mapInArrow(tidy(run), "item long, doc long, score long")
    return _first(found, k, "doc")


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list]:
    """The distinct items, in blocks of about so many bytes, chosen by a hash."""
    every = items.select(F.col(f"`{item_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).distinct()
    n = max(1, math.ceil((every.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    for b in range(n):
        yield (every.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b) if n > 1 else every).collect()


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_bytes: int = 4 << 20, depths: tuple[float, ...] = DEPTHS, report: Callable[[np.ndarray], None] | None = None) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the k best documents of each item.

    ``report`` gets the tier at which each item of a block was proven.
    """
    spark, found = docs.sparkSession, []
    names = f"item long, `{item_id}` {items.schema[item_id].dataType.simpleString()}"
    for block in _blocks(items, item_id, text, block_bytes):
        counts = [Counter(alnum_words(r.text.encode())) for r in block]
        vocabulary = sorted(set().union(*counts)) if counts else []
        number = {w: i for i, w in enumerate(vocabulary)}
        queries = [{number[w]: n for w, n in c.items()} for c in counts]
        index = build(docs, vocabulary, doc_id, text, depths)
        if report:
            asked = Asked.of(queries, index.weights)
            report(proven_at(index, asked, thresholds(index, asked, k)))
        ids = spark.createDataFrame([(i, r.id) for i, r in enumerate(block)], names)
        rows = answers(index, queries, k).join(ids, "item")
        found.append(cut(rows.select(f"`{item_id}`", "rank", F.col("doc").alias(doc_id), "score")))
        _remove(spark, index.path)
    return reduce(DataFrame.union, found)
