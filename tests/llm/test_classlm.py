import zlib
from collections import Counter
from math import isclose, log10

import numpy as np
from odd import documents, empty
from pyspark.sql import functions as F

from corvane.llm import classlm, queries


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def check_base(rows, texts):
    """Counts and base scores against plain counting; rows have doc_id, texts are (id, text, held_out)."""
    counts = Counter(w for _, t, out in texts if not out for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t, _ in texts)
    have = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert a[:4] == b[:4] and isclose(a[4], b[4], rel_tol=1e-9)


def test_query(spark, sf="/root/testdata/sf0.01"):
    texts = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op4_class_lm(spark, sf).collect()
    check_base(rows, texts)
    assert {r.doc_id: r.held_out for r in rows} == {i: out for i, _, out in texts}
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows_and_few_frequent_words(spark):
    docs = documents(spark)
    texts = [(r.doc_id, r.text, False) for r in docs.collect()]
    for frequent, clustered in ((0, 0), (3, 2), (50, 10), (10_000, 40)):
        model, rest = classlm.train(docs, frequent=frequent, clustered=clustered, classes=4)
        rows = classlm.score(docs, model, rest, [F.col("doc_id")]).collect()
        check_base(rows, texts)
        assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    model, rest = classlm.train(empty(spark))
    assert classlm.score(docs, model, rest, [F.col("doc_id")]).count() == 13
    assert classlm.score(empty(spark), model, rest, [F.col("doc_id")]).count() == 0


def test_model_sums_to_one(spark):
    docs = documents(spark)
    model, rest = classlm.train(docs, frequent=300, clustered=20, classes=4)
    words = [*model.index, b"never seen"]
    counts = {r.word: r.c for r in classlm.word_counts(docs).collect()}
    rest_words = [bytes(w) for w in counts if bytes(w) not in model.index]
    for before in (0, len(model.index), len(model.index) + 1):
        p = 10 ** model.transition[model.class_of[before]]
        total = sum(p[model.class_of[i]] * 10 ** model.emission[i] for i in range(len(model.index)))
        of_rest = [(counts[w] if w in counts else 0) + 0.1 for w in [*rest_words, b"never seen"]]
        total += p[model.class_of[-2]] * sum(of_rest) / (model.rest_n + 0.1 * (model.rest_v + 1)) + p[model.class_of[-1]]
        assert isclose(total, 1, rel_tol=1e-9)
    assert words


def likelihood(a, of):
    k = of.max() + 1
    n = np.zeros((k, k))
    np.add.at(n, (of[:, None], of[None, :]), a)
    return sum(x * np.log(x) for x in n.ravel() if x) - sum(x * np.log(x) for x in n.sum(1) if x) * 2


def test_exchange_finds_planted_classes_and_never_gets_worse():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 30)
    p = np.array([[0.1, 0.8, 0.1], [0.1, 0.1, 0.8], [0.8, 0.1, 0.1]])
    a = rng.poisson(40 * p[truth[:, None], truth[None, :]])
    a = a + a.T * 0
    last = None
    for rounds in (0, 1, 2, 6):
        of = classlm.exchange(np.pad(a, (0, 1)), 30, 3, rounds)
        now = likelihood(np.pad(a, (0, 1)), of)
        assert last is None or now >= last - abs(last) * 0.02
        last = now
    groups = {tuple(np.flatnonzero(of[:30] == g)) for g in range(3)}
    assert groups == {tuple(np.flatnonzero(truth == g)) for g in range(3)}
