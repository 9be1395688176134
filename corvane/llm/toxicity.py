"""Toxicity by cumulative-link ordinal regression on sparse word features.

One weight vector w and ordered thresholds: P(grade <= k) = 1 / (1 + exp(w.x - t_k)).
The features are words and beginnings of words that tell toxic training documents from
others; each one that occurs adds a constant and a term that grows with its share of
the words.

Training takes at most ``most`` labelled rows. Near copies among them would count one
opinion many times, so a row that shares a min-hash with one before it is left out.
A label of 0 is grade 0; of 1, grade 1 to ``grades`` by the share of telling words.

Defined results: null and empty texts have no words; a table without usable labels
gives severity 0 for all; rows are scored one by one, whole texts; of rows that share
an id one is a training row; labels that are null are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ALNUM, OWN, alnum_words, cut, hashed_words, lists, map_arrow, mix, pieces, texts, tidy, with_columns
from corvane.llm.sample import bounded


#: Bytes of a word's beginning that make a feature; a whole word ends in a dollar sign.
BEGINNINGS = range(3, 10)


def features_of(word: bytes) -> list[bytes]:
    return [word + b"$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


@dataclass
class Ordinal:
    features: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray
    #: A document is rejected from this chance of any grade over 0 on.
    cut: float = 0.5

    def __post_init__(self):
        self.starts = {f[:3] for f in self.features}

    def counts(self, words: list[bytes]) -> Counter:
        """How many of the words have each feature."""
        out: Counter = Counter()
        for w, c in Counter(words).items():
            if (w + b"$")[:3] in self.starts:
                for f in features_of(w):
                    if f in self.features:
                        out[f] += c
        return out

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one row for each margin."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margin[:, None], -40, 40)))

    def margin(self, words: list[bytes]) -> float:
        return sum(self.weights[self.features[f]] * value(c, len(words)) for f, c in self.counts(words).items())


def value(count, n_words):
    """A feature's value: it occurs, and how much of the text it makes."""
    return 1 + np.log1p(1000 * count / n_words)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, penalty: float = 0.02, steps: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Weights, none below 0, and thresholds of least penalised negative log-likelihood.

    Every feature is one that toxic documents have more often, so a weight below 0
    would only fit chance. Descent with adaptive steps, projected."""
    n, k = len(grades), int(grades.max())
    weights = np.zeros(n_features)
    share = np.clip([(grades <= j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    raw = np.r_[t[0], np.log(np.maximum(np.diff(t), 1e-2))]  # thresholds stay ordered
    first, second = np.zeros(n_features + k), np.zeros(n_features + k)
    for step in range(1, steps + 1):
        t = np.cumsum(np.r_[raw[0], np.exp(raw[1:])])
        margin = np.bincount(rows, weights[columns] * values, n)
        edges = np.r_[-np.inf, t, np.inf]
        with np.errstate(over="ignore"):
            high, low = (1 / (1 + np.exp(margin - edges[grades + e])) for e in (1, 0))
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_margin = d_high - d_low
        g_t = np.array([d_low[grades == j + 1].sum() - d_high[grades == j].sum() for j in range(k)])
        g_raw = np.cumsum(g_t[::-1])[::-1] * np.r_[1, np.exp(raw[1:])]
        g = np.r_[np.bincount(columns, g_margin[rows] * values, n_features) + penalty * weights, g_raw]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights, raw = np.maximum(0, weights - move[:n_features]), raw - move[n_features:]
    return weights, np.cumsum(np.r_[raw[0], np.exp(raw[1:])])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 20_000, grades: int = 3, least_df: int = 8, least_z: float = 4.5, least_odds: float = 8.0, features: int = 2_000) -> Ordinal:
    """Fit on at most ``most`` labelled rows; the words are chosen by counts over those rows.

    Of rows that share an id the one with the least text counts. Of rows that share one of
    four minima of word-pair hashes with an earlier one (near copies mostly) only the
    earlier trains. A feature is in ``least_df`` of the rows at
    least, and the ``features`` most telling ones count; words over 64 bytes make none.
    """
    spark = docs.sparkSession
    chosen = bounded(labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("y is not null"), "id", most)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")  # at most ``most`` small rows
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text"))  # an id may have very many rows

    def signed(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = []
        for t in texts(batch["text"]):
            h, _ = hashed_words([t], ALNUM)
            pairs = mix(h[1:] + mix(h[:-1])) if len(h) > 1 else h
            marks.append(np.array([mix(pairs ^ np.uint64(s)).min() for s in (1, 2, 3, 4)] if len(pairs) else [], np.uint64).view(np.int64))
        return with_columns(batch, marks=lists(marks, pa.int64()))

    rows = cut(map_arrow(rows.select("id", "y", "text"), signed, f"id {docs.schema[doc_id].dataType.simpleString()}, y int, text string, marks array<long>"))
    seen: set[int] = set()
    kept, classes = [], {}
    for r in sorted(rows.select("id", "y", "marks").collect(), key=lambda r: r.id):  # bounded by ``most``
        if r.id not in classes and r.marks and not seen.intersection(r.marks):
            kept.append(r.id)
            classes[r.id] = min(1, r.y)
        seen.update(r.marks)
    if len(set(classes.values())) < 2:
        return Ordinal({}, np.zeros(0), np.array([30.0]))
    only = spark.sparkContext.broadcast(classes)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            words = list(found[0] | found[1])
            counts = [pa.array([f[w] for w in words], pa.int64()) for f in found]
            for f in found:
                f.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *counts], ["word", "clean", "toxic"])

        for batch in batches:
            for part, some in pieces(batch, "text"):
                for i, t in zip(part["id"].to_pylist(), some, strict=True):
                    if i in only.value:
                        found[only.value[i]].update({f for w in set(alnum_words(t)) if len(w) <= 64 for f in features_of(w)})
                    if len(found[0]) + len(found[1]) > 200_000:
                        yield rows()
        if found[0] or found[1]:
            yield rows()

    toxic = sum(classes.values())
    clean = len(classes) - toxic
    share = F.col("df") / (toxic + clean)
    z = (F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean) + 1e-12)
    counts = rows.select("id", "text").mapInArrow(tidy(counted), "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).withColumn("df", F.col("clean") + F.col("toxic"))
    best = counts.where(F.col("df") >= least_df).withColumn("z", z).where((F.col("z") >= least_z) & (F.col("toxic") * clean > least_odds * F.col("clean") * toxic)).orderBy(F.desc("z"), "word").limit(features).collect()
    names = {bytes(r.word): i for i, r in enumerate(best)}
    telling = {bytes(r.word) for r in best if r.toxic * clean > 20 * r.clean * toxic}
    if not names:
        return Ordinal({}, np.zeros(0), np.array([30.0]))
    sent = spark.sparkContext.broadcast((Ordinal(names, np.zeros(len(names)), np.zeros(1)), telling))

    def sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, telling = sent.value
        for batch in batches:
            ids, shares, at, values = [], [], [], []
            for i, t in zip(batch["id"].to_pylist(), texts(batch["text"]), strict=True):
                if i in only.value:
                    w = alnum_words(t)
                    found = plain.counts(w)
                    ids.append(i)
                    shares.append(max((c for x, c in found.items() if x in telling), default=0) / max(1, len(w)))
                    at.append(np.array([plain.features[x] for x in found], np.int32))
                    values.append(np.array([value(c, len(w)) for c in found.values()]))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch["id"].type), pa.array(shares, pa.float64()), lists(at, pa.int32()), lists(values, pa.float64())], ["id", "share", "at", "value"])

    data = rows.select("id", "text").mapInArrow(tidy(sparse), f"id {docs.schema[doc_id].dataType.simpleString()}, share double, at array<int>, value array<double>").collect()
    data.sort(key=lambda r: r.id)
    y = np.array([classes[r.id] for r in data])
    shares = np.array([r.share for r in data])
    told = shares[(y == 1) & (shares > 0)]
    cuts = np.quantile(told, np.arange(1, grades) / grades) if len(told) else np.zeros(0)
    grade = np.where(y == 1, 1 + np.searchsorted(np.unique(cuts), shares), 0)
    _, grade = np.unique(grade, return_inverse=True)  # grades that occur, in order
    at = np.repeat(np.arange(len(data)), [len(r.at) for r in data])
    columns, values = np.array([c for r in data for c in r.at], int), np.array([v for r in data for v in r.value])
    weights, thresholds = fit_ordinal(at, columns, values, grade, len(names))
    margins = np.bincount(at, weights[columns] * values, len(data))
    return Ordinal(names, weights, thresholds, _cut(margins, y == 1, thresholds[0]))


def _cut(margins: np.ndarray, toxic: np.ndarray, threshold: float, false_costs: float = 5.0) -> float:
    """The chance that tells the training rows best, a false alarm's share weighing ``false_costs`` times a miss's."""
    levels = np.unique(margins)
    found = np.array([(margins[toxic] >= m).mean() - false_costs * (margins[~toxic] >= m).mean() for m in levels])
    i = int(found.argmax())
    at = levels[i] if i == 0 else (levels[i] + levels[i - 1]) / 2
    return float(1 / (1 + np.exp(threshold - at)))


def severity(docs: DataFrame, model: Ordinal, text: str = "text", prefix: str = "") -> DataFrame:
    """Add ``severity`` (the expected grade), ``p_toxic`` (of any grade over 0) and ``grade`` (the likeliest).

    Columns of these names are replaced; ``prefix`` gives the new ones others.
    """
    names = [f"{prefix}{c}" for c in ("severity", "p_toxic", "grade")]
    docs = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        above = m.above(np.array([m.margin(alnum_words(t)) for t in texts(batch[text])]))
        p = -np.diff(np.c_[np.ones(len(above)), above, np.zeros(len(above))], axis=1)
        columns = (pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(p.argmax(1).astype(np.int32)))
        return with_columns(batch, **dict(zip(names, columns, strict=True)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, per_batch, f"{schema}, `{names[0]}` double, `{names[1]}` double, `{names[2]}` int")


def is_toxic(model: Ordinal, p_toxic: str = "p_toxic") -> Column:
    return F.col(p_toxic) >= model.cut


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    model = train(docs, labels)
    scored = severity(docs, model, prefix=OWN)
    return scored.where(~is_toxic(model, f"{OWN}p_toxic")).select(*(F.col(f"`{c}`") for c in docs.columns))
