"""Language-model scores by class-based bigrams.

P(word | word before) = P(class | class before) P(word | class). Exchange clustering
assigns the ``clustered`` most frequent words to ``classes`` classes: each word in turn
moves to the class that makes the training text likeliest, given all others. Every
further word of the training texts, rare ones too, then joins the class with the greatest
exchange gain, from how often each class stands before and after it; all words of a round
are dealt at once. The ``frequent`` words have two such rounds, the rest one after them,
in which neighbours that are rare themselves count as one class. The end of a text is a
class of its own and also stands before each text.

A rare word's chance is that of any rare word after the class before, times that of its
class among rare words there, times its share of these; after it stands its class. Unknown
words have a fixed small share of the rare ones. Emissions are smoothed by additive counts,
transitions by the classes' shares, so the model sums to 1 over the known words and one
unknown.

All counts cover all training texts and grow with them: word counts are a shuffled
table. Only the ``frequent`` most frequent words (of at most 256 bytes) are broadcast, and
the class of each; counts and classes of the rest reach the texts by a join on a 64-bit
hash. Of v distinct words two share a hash, and so a count, with a chance of about
v ** 2 / 2 ** 65: one in 30 for a billion words.

Tokens: words between blanks (x20, x09 to x0D), A-Z in lower case, then one end. Null
and empty texts are one end token. Rows are scored one by one, so repeated rows repeat
their score; an empty table gives an empty one. Without training texts every count is 0.
A kept column that has the name of a result is an error.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import block_sums, cut, lists, space_words, texts, tidy

#: Spark's seed of xxhash64.
SEED = 42
LONGEST = 256


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c) over the texts of ``docs(text)``, summed in the tasks before the exchange."""

    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for t in texts(batch["text"]):
                found.update(space_words(t))
                if len(found) > 400_000:
                    yield rows(found)
                    found = Counter()
        if found:
            yield rows(found)

    return docs.select("text").mapInArrow(tidy(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def exchange(counts: np.ndarray, clustered: int, classes: int, rounds: int = 6) -> np.ndarray:
    """Class of each symbol from the matrix of bigram counts.

    The first ``clustered`` symbols are assigned to ``classes`` classes by exchange; each
    other symbol keeps a class of its own.
    """
    size = len(counts)
    classes = max(1, min(classes, clustered))
    of = np.r_[np.arange(clustered) % classes, classes + np.arange(size - clustered)].astype(int)
    k = classes + size - clustered
    a = counts.astype(np.float64)
    to_class, from_class = np.zeros((size, k)), np.zeros((k, size))
    np.add.at(to_class.T, of, a.T)
    np.add.at(from_class, of, a)
    n = np.zeros((k, k))
    np.add.at(n, of, to_class)
    total = n.sum(1)
    own, word_total = a.diagonal(), a.sum(1)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    for _ in range(rounds):
        moved = 0
        for w in range(clustered):
            old, s = of[w], own[w]
            r, q = to_class[w].copy(), from_class[:, w].copy()
            n[old] -= r
            n[:, old] -= q
            n[old, old] += s
            total[old] -= word_total[w]
            r[old] -= s
            q[old] -= s
            here, b = n[:classes], np.arange(classes)
            gain = (f(here + r) - f(here)).sum(1) + (f(n[:, :classes] + q[:, None]) - f(n[:, :classes])).sum(0)
            both = n[b, b]
            gain += f(both + r[b] + q[b] + s) + f(both) - f(both + r[b]) - f(both + q[b])
            gain -= 2 * (f(total[:classes] + word_total[w]) - f(total[:classes]))
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            r[new] += s
            q[new] += s
            n[new] += r
            n[:, new] += q
            n[new, new] -= s
            total[new] += word_total[w]
            if new != old:
                moved += 1
                of[w] = new
                to_class[:, old] -= a[:, w]
                to_class[:, new] += a[:, w]
                from_class[old] -= a[w]
                from_class[new] += a[w]
        if not moved:
            break
    return of


@dataclass
class Model:
    index: dict[bytes, int]  # frequent words
    counts: np.ndarray  # of the frequent words
    class_of: np.ndarray  # of the frequent words, then of the rest and of the end
    transition: np.ndarray  # log10
    emission: np.ndarray  # log10, of the frequent words
    n: int  # training tokens
    v: int  # distinct training tokens
    ends: int  # training texts
    rest_n: int  # tokens of words that are not frequent
    rest_v: int  # such words
    rest_transition: np.ndarray  # log10, from each class to a rare word of each class, last an unknown one
    rest_emission: np.ndarray  # tokens and words among the rare ones, of each class

    def base(self, c):
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))


def _symbols(counts: np.ndarray, clustered: int) -> np.ndarray:
    """Symbol of each frequent word: its own, or that of its count's magnitude."""
    out = np.arange(len(counts))
    if len(counts) > clustered:
        band = np.floor(np.log2(counts[clustered:])).astype(int)
        _, band = np.unique(-band, return_inverse=True)
        out[clustered:] = clustered + band
    return out


def train(docs: DataFrame, text: str = "text", frequent: int = 100_000, clustered: int = 1_500, classes: int = 60, weight: float = 50.0) -> tuple[Model, DataFrame]:
    """The model and the table (h, c) of the words that are not broadcast."""
    docs = docs.select(F.col(text).alias("text"))
    counts = cut(word_counts(docs))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = docs.count()
    short = counts.where(F.octet_length("word") <= LONGEST)
    # how many words have each count up to 4096, above it each power of a tenth: few rows at any size
    level = F.when(F.col("c") <= 4096, F.col("c")).otherwise(F.lit(4096) + F.floor(F.log("c") * 10))
    least, seen = None, 0
    for r in sorted(short.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        seen += r["count"]
        if seen > frequent:
            break
        least = r["level"]
    is_frequent = (F.octet_length("word") <= LONGEST) & (level >= least) if least is not None else F.lit(False)
    best = counts.where(is_frequent).toArrow()  # at most ``frequent`` words of at most ``LONGEST`` bytes
    words = sorted(zip(best["word"].to_pylist(), best["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    c = np.array([x[1] for x in words], np.int64)
    clustered = min(clustered, len(words))
    symbol = _symbols(c, clustered)
    size = int(symbol.max(initial=-1)) + 3  # the last two: the rest, the end
    symbols = np.r_[symbol, size - 2, size - 1]
    index = {x[0]: i for i, x in enumerate(words)}
    seq = cut(_sequences(docs, index))
    of = exchange(_bigrams(seq, symbols, size), clustered, classes)
    classes = max(1, min(classes, clustered))
    class_of, k = of[symbols], int(of.max()) + 1
    for old in (False, True):
        if len(words) > clustered:
            h, new = _dealt_frequent(seq, class_of, k, clustered, _bigrams(seq, class_of, k), classes, class_of if old else None)
            class_of[h] = new
        class_of[-2:], k = [classes, classes + 1], classes + 2
    n = _bigrams(seq, class_of, k).astype(float)
    dealt = cut(_dealt(_rare_neighbours(seq, class_of, k), n, classes))
    of_word = dealt.where("h is not null").select("h", "class")
    rest = cut(counts.where(~is_frequent).select(F.xxhash64("word").alias("h"), "c").groupBy("h").agg(F.sum("c").alias("c"), F.count("*").alias("v")).join(of_word, "h"))

    before, after, both = np.zeros((k, classes)), np.zeros((classes, k)), np.zeros((classes, classes))
    for r in dealt.where("h is null").groupBy("class", "x").agg(F.sum("c").alias("c")).collect():
        if r.x < k:
            before[r.x, r["class"]] = r.c
        else:
            after[r["class"], r.x - k] = r.c
    pairs = _rare_pairs(seq, len(index)).join(of_word.select("h", F.col("class").alias("one")), "h").join(of_word.select(F.col("h").alias("g"), F.col("class").alias("two")), "g")
    for r in pairs.groupBy("one", "two").agg(F.sum("c").alias("c")).collect():
        both[r.one, r.two] = r.c
    # rare neighbours are known by their classes now; the row of unknown words is that of all rare ones
    before[classes], after[:, classes] = both.sum(0), both.sum(1)
    before[:classes] += both
    in_class, kinds = np.bincount(class_of[:-2], c, k), np.bincount(class_of[:-2], minlength=k)
    filled = np.r_[kinds[:classes] > 0, True, True]  # a class that only rare words have stands before others only
    share = np.where(filled, n.sum(0) + 0.5, 0) / (n.sum() + 0.5 * filled.sum())
    n[:classes] += after
    transition = np.log10(np.maximum((n + weight * share) / (n.sum(1, keepdims=True) + weight), 1e-300))
    emission = np.log10((c + 0.1) / (in_class + 0.1 * kinds)[class_of[:-2]])
    of_rest = np.zeros((2, classes))
    for r in rest.groupBy("class").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():
        of_rest[:, r["class"]] = r.c, r.v
    rest_n, rest_v = total[0] - int(c.sum()), total[1] - len(words)
    unknown = 0.1 / (rest_n + 0.1 * (rest_v + 1))
    own = (before + weight * of_rest[0] / max(1, rest_n)) / (before.sum(1, keepdims=True) + weight) * (1 - unknown)
    rest_transition = transition[:, classes, None] + np.log10(np.maximum(np.c_[own, np.full(k, unknown)], 1e-300))
    return Model(index, c, class_of, transition, emission, total[0] + ends, total[1] + bool(ends), ends, rest_n, rest_v, rest_transition, of_rest), rest


def _sequences(docs: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """Rows of many texts: ``ids`` of the words (the rest have the one after the last) and an end after each text, ``others``, hashes of the rest."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, rest = sent.value.get, len(sent.value)
        for batch in batches:
            for some in _some(texts(batch["text"])):
                split = [space_words(t) for t in some]
                words = [w for ws in split for w in (*ws, None)]
                ids = np.array([get(w, rest) for w in words], np.int32)
                ids[np.cumsum([len(ws) + 1 for ws in split]) - 1] = rest + 1
                others = np.array([xxhash.xxh64_intdigest(words[i], SEED) for i in np.flatnonzero(ids == rest).tolist()], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([others.tobytes()], pa.binary())], ["ids", "others"])

    return docs.select("text").mapInArrow(tidy(run), "ids binary, others binary")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, others in zip(batch["ids"].to_pylist(), batch["others"].to_pylist(), strict=True):
            yield np.frombuffer(ids, np.int32), np.frombuffer(others, np.int64)


def _bigrams(seq: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """Counts of the pairs of symbols; an end stands before each text."""
    sent = seq.sparkSession.sparkContext.broadcast(of)

    def count(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(size * size, np.int64)
        for ids, _ in _read(batches):
            s = sent.value[np.r_[len(sent.value) - 1, ids]]
            out += np.bincount(s[:-1] * size + s[1:], minlength=size * size)
        return out

    return block_sums(seq, size * size, count).reshape(size, size)


def _summed(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, in order, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [x[order] for x in columns]
    if not len(order):
        return columns, np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in columns], axis=0)])
    return [x[start] for x in columns], np.add.reduceat(np.ones(len(order), np.int64) if counts is None else counts[order], start)


def _table(seq: DataFrame, names: list[str], each: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], schema: str, most: int = 4_000_000) -> DataFrame:
    """The rows that ``each`` gives of a row's ids and others, equal ones of a task with their count ``c``."""

    def rows(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        found, c = _summed([np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip((*found, c), kinds, strict=True)], [*names, "c"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for ids, others in _read(batches):
            held.append(each(ids, others))
            n += len(held[-1][0])
            if n > most:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    kinds = [np.int64 if x.endswith("long") else np.int32 for x in schema.split(", ")]
    return seq.mapInArrow(tidy(run), schema)


#: Words whose counters are exchanged and judged together.
_WORDS = 2_048


def _dealt_frequent(seq: DataFrame, of: np.ndarray, k: int, clustered: int, n: np.ndarray, classes: int, old: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and new classes of the frequent words after the clustered ones that occur.

    Each task counts their neighbours' classes in one array of ``2 k`` counters a word and
    sends what is not zero, in blocks of words; a block is summed up and judged in one
    task. What a task sends is bounded by the array, whatever it reads.
    """
    sc = seq.sparkSession.sparkContext
    sent, model = sc.broadcast(of), sc.broadcast((n.astype(float), old))
    words = len(of) - 2 - clustered
    size = 2 * k * _WORDS
    kind = "block int, cells binary"

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = sent.value, np.zeros(2 * k * words, np.uint32)
        for ids, _ in _read(batches):
            s = of[np.r_[len(of) - 1, ids]]
            at = np.flatnonzero((ids >= clustered) & (ids < len(of) - 2))
            w = 2 * k * (ids[at] - clustered)
            np.add.at(total, np.r_[w + s[at], w + k + s[at + 2]], np.uint32(1))
        for b in range(0, -(-words // _WORDS)):
            some = total[b * size : (b + 1) * size]
            if len(cells := np.flatnonzero(some)):
                packed = zlib.compress(np.diff(cells, prepend=0).astype(np.uint32).tobytes() + some[cells].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([packed], pa.binary())], ["block", "cells"])

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, old = model.value
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, packed in zip(batch["block"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                both = np.frombuffer(zlib.decompress(packed), np.uint32)
                cells, c = np.cumsum(both[: len(both) // 2], dtype=np.int64), both[len(both) // 2 :]
                blocks.setdefault(b, np.zeros(size, np.int64))[cells] += c
        for b, total in blocks.items():
            cells = np.flatnonzero(total)
            h = clustered + b * _WORDS + cells // (2 * k)
            yield from _judge(h, cells % (2 * k), total[cells], n, classes, old)

    rows = seq.mapInArrow(tidy(partial), kind).repartition(max(1, -(-words // _WORDS)), "block").mapInArrow(tidy(judged), "h long, class long").collect()  # one row a frequent word
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _classes_of(h: np.ndarray, x: np.ndarray, c: np.ndarray, n: np.ndarray, classes: int, old: np.ndarray | None, most: int = 50_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, their best classes, and the number of its word in each sorted row (h, x, c)."""
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    ends = np.r_[first, len(h)]
    word = np.repeat(np.arange(len(first)), np.diff(ends))
    own, a = np.zeros(len(first), np.int64), 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        i = slice(ends[a], ends[b])
        own[a:b] = best_classes(word[i] - a, x[i], c[i], n, classes, None if old is None else old[h[first[a:b]]])
        a = b
    return h[first], own, word


def _judge(h: np.ndarray, x: np.ndarray, c: np.ndarray, n: np.ndarray, classes: int, old: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if len(h):
        words, own, _ = _classes_of(h, x, c, n, classes, old)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(own)], ["h", "class"])


def _rare_neighbours(seq: DataFrame, of: np.ndarray, k: int) -> DataFrame:
    """(h, x, c) of the rest's words: x is the class before times ``k`` plus the class after."""
    sent = seq.sparkSession.sparkContext.broadcast(of)

    def each(ids: np.ndarray, others: np.ndarray) -> list[np.ndarray]:
        of = sent.value
        at = np.flatnonzero(ids == len(of) - 2)
        s = of[np.r_[len(of) - 1, ids]]
        return [others, s[at] * k + s[at + 2]]

    return _table(seq, ["h", "x"], each, "h long, x int, c int")


def _rare_pairs(seq: DataFrame, rest: int) -> DataFrame:
    """(h, g, c) of the rare words g that follow rare words h."""

    def each(ids: np.ndarray, others: np.ndarray) -> list[np.ndarray]:
        i = np.flatnonzero(np.diff(np.flatnonzero(ids == rest)) == 1)
        return [others[i], others[i + 1]]

    return _table(seq, ["h", "g"], each, "h long, g long, c int")


def best_classes(w: np.ndarray, x: np.ndarray, c: np.ndarray, n: np.ndarray, classes: int, old: np.ndarray | None = None) -> np.ndarray:
    """The class of greatest exchange gain of each word, from the counts ``c`` of its neighbours' classes ``x``.

    ``w`` numbers the words from 0 in order, one row for each (w, x). ``n`` are the
    classes' bigrams; they hold the word's own ones in its class ``old``.
    """
    k = len(n)
    m = np.r_[n[:, :classes], n[:classes].T]
    start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    many = np.bincount(w, np.where(x < k, c, 0))[:, None]
    base, ins, outs = m[x], n[:, :classes].sum(0)[None].repeat(len(start), 0), n[:classes].sum(1)[None].repeat(len(start), 0)
    if old is not None:
        base[np.arange(len(w)), old[w]] -= c
        ins[np.arange(len(start)), old] -= many[:, 0]
        outs[np.arange(len(start)), old] -= many[:, 0]
        base, ins, outs = (np.maximum(y, 0) for y in (base, ins, outs))
    gain = np.add.reduceat(f(base + c[:, None]) - f(base), start, axis=0)
    gain -= f(ins + many) - f(ins) + f(outs + many) - f(outs)
    q, r = np.zeros((2, len(start), classes))
    for y, some in ((q, x < classes), (r, (x >= k) & (x < k + classes))):
        y[w[some], x[some] % k] = c[some]
    i, j = np.nonzero((q > 0) & (r > 0))  # the cell of a class after itself takes both
    both = n[j, j]
    gain[i, j] += f(both + q[i, j] + r[i, j]) + f(both) - f(both + q[i, j]) - f(both + r[i, j])
    return gain.argmax(1)


def _dealt(found: DataFrame, n: np.ndarray, classes: int, most: int = 50_000) -> DataFrame:
    """(h, class) of each word of ``found(h, x, c)`` from ``_rare_neighbours``, and without h the
    sums (class, x, c) over words, where x is the class before, or k and the class after."""
    k = len(n)
    sent = found.sparkSession.sparkContext.broadcast(n.astype(float))

    def judged(h: np.ndarray, x: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        (h, x), c = _summed([np.r_[h, h], np.r_[x // k, k + x % k]], np.r_[c, c])
        words, own, word = _classes_of(h, x, c, sent.value, classes, None, most)
        (of, at), sums = _summed([own[word], x], c)
        none = pa.nulls(len(of), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(own), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64())], ["h", "class", "x", "c"])
        yield pa.RecordBatch.from_arrays([none, pa.array(of), pa.array(at), pa.array(sums)], ["h", "class", "x", "c"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [batch[y].to_numpy().astype(np.int64) for y in ("h", "x", "c")]
            if not len(new[0]):
                continue
            held = new if held is None else [np.r_[y, z] for y, z in zip(held, new, strict=True)]
            at = int(np.searchsorted(held[0], held[0][-1]))  # the last word may go on
            if at >= most:
                yield from judged(*(y[:at] for y in held))
                held = [y[at:] for y in held]
        if held:
            yield from judged(*held)

    return found.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(run), "h long, class long, x long, c long")


def _some(found: list[bytes], size: int = 2_000_000) -> Iterator[list[bytes]]:
    """Texts in groups of about ``size`` bytes."""
    some, n = [], 0
    for t in found:
        some.append(t)
        n += len(t)
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def score(docs: DataFrame, model: Model, rest: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if clash := {c.lower() for c in docs.select(*keep).columns} & set(results):
        raise ValueError(f"kept columns have the names of results: {sorted(clash)}")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*keep).alias("keep"), F.col(text).alias("text"))
    k, unknown = len(model.transition), int(model.class_of[-2])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        base, end, get = m.base(m.counts), m.class_of[-1], m.index.get
        for batch in batches:
            n, known, b, s, others, around = [], [], [], [], [], []
            for t in texts(batch["text"]):
                words = space_words(t)
                ids = np.array([get(w, -1) for w in words], np.int64)
                there = ids[ids >= 0]
                classes = np.r_[end, np.where(ids >= 0, m.class_of[ids], -1), end]
                sure = np.flatnonzero((classes[:-1] >= 0) & (classes[1:] >= 0))
                at = np.flatnonzero(ids < 0)
                n.append(len(words) + 1)
                known.append(len(there) + bool(m.ends))
                b.append(base[there].sum() + m.base(m.ends))
                s.append(m.emission[there].sum() + m.transition[classes[sure], classes[sure + 1]].sum())
                others.append(np.array([xxhash.xxh64_intdigest(words[i], SEED) for i in at.tolist()], np.uint64).view(np.int64))
                around.append((classes[at] + 1) * (k + 1) + classes[at + 2] + 1)  # 0 for a word that is not frequent
            yield pa.RecordBatch.from_arrays([batch["keep"], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(b, pa.float64()), pa.array(s, pa.float64()), lists(others, pa.int64()), lists(around, pa.int32())], ["keep", "n", "known", "b", "s", "others", "around"])

    kinds = rows.schema["keep"].dataType.simpleString()
    parts = cut(rows.mapInArrow(tidy(run), f"keep {kinds}, n long, known long, b double, s double, others array<long>, around array<int>")).withColumn("row", F.monotonically_increasing_id())

    def looked_up(values: np.ndarray, i: Column) -> Column:
        return F.get(F.split(F.lit(",".join(map(repr, values.ravel().tolist()))), ",").cast("array<double>"), i.cast("int"))

    word = F.coalesce("class", F.lit(unknown))
    c = F.coalesce("c", F.lit(0))
    size = len(model.rest_transition[0])
    before, after = F.floor(F.col("around") / (k + 1)) - 1, F.col("around") % (k + 1) - 1
    logs = looked_up(np.log10(np.maximum(model.rest_emission[0] + 0.1 * model.rest_emission[1], 0.1)), F.col("class"))
    own = F.when(F.col("class").isNotNull(), F.log10(c + 0.1) - logs).otherwise(0.0)
    own += F.when(before >= 0, looked_up(model.rest_transition, before * size + word)).otherwise(0.0)
    own += F.when(after >= 0, looked_up(model.transition, word * k + after)).otherwise(0.0)
    each = parts.select("row", F.posexplode(F.arrays_zip("others", "around")).alias("i", "x")).select("row", "i", F.col("x.others").alias("h"), F.col("x.around").alias("around")).join(rest.select("h", "c", "class"), "h", "left")
    # of neighbours that are both not frequent, each one's class comes back to its row and is compared there
    beside = (before < 0) | (after < 0)
    each = each.select("row", F.col("c").isNotNull().alias("is_known"), F.log10(c + 0.1).alias("log"), own.alias("own"), F.when(beside, F.struct("i", (before < 0).alias("follows"), word.cast("int").alias("w"))).alias("one"))
    more = each.groupBy("row").agg(F.count_if("is_known").alias("known2"), F.sum("log").alias("logs"), F.sum("own").alias("own"), F.count("*").alias("k"), F.array_sort(F.collect_list("one")).alias("ones"))
    last = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("w"))
    step = lambda acc, x: F.struct((acc["sum"] + F.when(x["follows"], looked_up(model.rest_transition, F.when(acc["w"] >= 0, acc["w"]).otherwise(unknown) * size + x["w"])).otherwise(0.0)).alias("sum"), x["w"].alias("w"))
    more = more.withColumn("own", F.col("own") + F.when(F.size("ones") > 0, F.aggregate("ones", last, step, lambda acc: acc["sum"])).otherwise(0.0)).drop("ones")
    none = F.lit(0)
    base = F.col("b") + F.coalesce("logs", none) - F.coalesce("k", none) * float(np.log10(model.n + 0.1 * (model.v + 1)))
    s = F.col("s") + F.coalesce("own", none)
    return parts.join(more, "row", "left").select("keep.*", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("known2", none)).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), s.alias("score"))
