import hashlib
import pathlib
import re
import time

import pytest
from odd import documents, empty

from corvane.llm import queries
from corvane.llm.decontam import contamination, is_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=13):
    """(n_words, n_hit, sorted ids) of each text, by looking up every window."""
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = []
    for t in texts:
        w = words(t)
        hit, ids = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    ids |= found
        out.append((len(w), len(hit), sorted(map(str, ids - {None}))))
    return out


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = dict(zip((r.doc_id for r in docs), brute([r.text for r in docs], items), strict=True))
    rows = queries.op6_decontaminate(spark, sf).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows) and not all(r.contaminated for r in rows)
    for r in rows:
        n, hit, ids = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(ids))
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


ITEMS = [
    (1, " ".join(f"W{i}" for i in range(20))),
    (2, "alpha, BETA gamma"),
    (2, "solo"),
    (3, "zwei Wörter"),
    (4, ""),
    (5, None),
    (None, "nobody owns this"),
    (6, " ".join(["same"] * 15)),
    (7, " ".join(f"w{i}" for i in range(5, 25))),
    (8, "alpha beta gamma"),
]
TEXTS = [
    " ".join(f"w{i}" for i in range(3, 18)),
    " ".join(f"w{i}" for i in range(0, 12)),
    "x alpha... beta--gamma y solo",
    "Zwei wörter zwei WÖRTER",
    "nobody owns this",
    " ".join(["same"] * 40),
    " ".join(["same"] * 12),
    "gamma beta alpha",
    " ".join(f"w{i}" for i in range(0, 30)) * 3,
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_odd_items_and_texts_in_one_block_and_in_many(spark, block_bytes):
    docs = documents(spark, [(100 + i, t) for i, t in enumerate(TEXTS)])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = contamination(docs, items, block_bytes=block_bytes, prefix="found_").collect()
    for r, (n, hit, ids) in zip(rows, brute([r.text for r in rows], ITEMS), strict=True):
        assert (r.found_n_words, r.found_n_hit, r.found_items, r.found_n_items) == (n, hit, ids, len(ids))
        assert r.n_hit == 2 and sum(b - a for a, b in zip(r.found_hit_from, r.found_hit_to, strict=True)) == hit


@pytest.mark.parametrize("block_bytes", [1 << 20, 20_000])
def test_texts_of_one_repeated_word(spark, block_bytes):
    """20,000 times a word in an item and in a text: work in proportion to the words."""
    items = [(1, "ha " * 20_000), (2, "ho " * 500), (3, "ha ho " * 300)]
    texts = ["ha " * 20_000, "ho ha " * 5_000 + "he " + "ho " * 5_000, "ha " * 12 + "he"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    rows = contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).orderBy("doc_id").collect()
    assert time.time() - began < 60
    assert [(r.n_words, r.n_hit, r.items) for r in rows] == [(20_000, 20_000, ["1"]), (15_001, 15_000, ["2", "3"]), (13, 0, [])]


def test_blocks_write_no_texts(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "alpha beta gamma delta " * 2_000) for i in range(20)], "doc_id long, text string")
    folder = spark.sparkContext.getCheckpointDir()
    before = sum(f.stat().st_size for f in pathlib.Path(folder.removeprefix("file:")).rglob("*") if f.is_file()) if folder else 0
    assert contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=60).where("n_items = 2").count() == 20
    folder = spark.sparkContext.getCheckpointDir()
    after = sum(f.stat().st_size for f in pathlib.Path(folder.removeprefix("file:")).rglob("*") if f.is_file()) if folder else 0
    assert after - before < 100_000


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(empty(spark), items).count() == 0
    rows = contamination(documents(spark).drop("n_hit"), items.where("false")).where(is_contaminated()).count()
    assert rows == 0
