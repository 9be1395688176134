"""Answers against the scores of all documents for all items in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from odd import documents, empty
from pyspark.sql import functions as F

from corvane.llm import queries, search
from corvane.llm.common import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """docs and items as (id, text): sorted (item, rank, doc, score)."""
    each = [(i, Counter(t := terms(x)), len(t)) for i, x in docs]
    counted = [d for d in each if d[2]]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weights = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in set(items):
        scored = []
        for doc, c, n in counted:
            m = 100 - 75 + ((75 * n * total) // length)
            scored.append((-sum(weights[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c), doc is None, doc))
        best = sorted((s for s in scored if s[0] < 0), key=lambda s: (*s[:2], s[2] or 0))[:k]
        out += [(item, i, doc, -score) for i, (score, _, doc) in enumerate(best, 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    docs, items = ([tuple(r) for r in table(spark, path, t).select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows(queries.op11_search(spark, path)) == brute(docs, items)


ITEMS = [(1, "one two THREE three"), (2, ""), (3, None), (4, "!!! --"), (None, "w1 w2 w3 twice"), (1, "one two THREE three"), (1, "wörtchen 日本語 x"), (5, "absent words only here zzzz"), (6, "row without an id very same")]


def test_odd_rows_ties_and_blocks(spark):
    """More copies of a text than are wanted, nulls, repeats, and items in several blocks."""
    docs = documents(spark, [(500 - i, "one two three three copies") for i in range(40)] + [(None, "one two three three copies")] * 3)
    items = spark.createDataFrame([(*x, "own") for x in ITEMS], "item_id long, text string, doc_id string")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    for size in (4 << 20, 30):
        for depths in ((1 / 64, 1 / 16), (), (0.0, 0.5)):
            assert rows(search.search(docs, items, block_bytes=size, depths=depths)) == want
    assert rows(search.search(docs, items, k=1)) == brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS, 1)


def test_empty_tables(spark):
    items = spark.createDataFrame([x for x in ITEMS], "item_id long, text string")
    assert search.search(empty(spark), items).count() == 0
    assert search.search(documents(spark), items.where("false")).count() == 0


def test_items_fall_through_the_tiers(spark, sf="/root/testdata/sf0.1"):
    """Items are proven at every tier, with fewer postings than all; a depth of all documents proves each at once."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    tiers, all_at_once = [], []
    found = rows(search.search(docs, items, report=tiers.append))
    assert len(np.unique(tiers[0])) >= 2
    assert rows(search.search(docs, items, depths=(1.0,), report=all_at_once.append)) == found
    assert set(all_at_once[0]) == {0}


def test_tiers_hold_every_posting_below_their_bounds(spark, sf="/root/testdata/sf0.01"):
    docs = table(spark, sf, "documents")
    words = sorted({t.encode() for r in docs.limit(20).collect() for t in terms(r.text)})
    index = search.build(docs, words, depths=(0.05, 0.3))
    got = index.rows.select("row", F.explode(F.arrays_zip("terms", "impacts", "tiers")).alias("p")).select("row", "p.*").collect()
    want = Counter(t for r in docs.collect() for t in set(terms(r.text)))
    assert Counter(words[r.terms].decode() for r in got) == Counter({t: n for t, n in want.items() if t.encode() in set(words)})
    most = {}
    for r in got:
        for j in range(r.tiers):
            most[j, r.terms] = max(most.get((j, r.terms), 0), r.impacts)
    assert all(index.residual[j, t] == most.get((j, t), 0) for j in range(3) for t in range(len(words)))
    deep = Counter((r.terms, r.tiers) for r in got)
    assert all(deep[t, 0] <= max(64, 50) for t in range(len(words))) and all(deep[t, 0] + deep[t, 1] <= 300 for t in range(len(words)))
