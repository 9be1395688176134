"""Trees, proofs and folded roots against plain Python, and against what a proof has to show."""

import hashlib
import zlib

import pytest
from odd import documents, empty
from pyspark.sql import functions as F

from corvane.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    """The last node, and each leaf's siblings as (before, after), level by level."""
    paths, nodes = [[] for _ in hashes], [(h, [i]) for i, h in enumerate(hashes)]
    while len(nodes) > 1:
        up = []
        for a in range(0, len(nodes), 16):
            run = [h for h, _ in nodes[a : a + 16]]
            for k, (_, members) in enumerate(nodes[a : a + 16]):
                for i in members:
                    paths[i].append((run[:k], run[k + 1 :]))
            up.append((sha("".join(run)), [i for _, m in nodes[a : a + 16] for i in m]))
        nodes = up
    return nodes[0][0], paths


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    each = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in order}
    below = {s: tree([leaf(r) for r in each[s]]) for s in order}
    root, above = tree([below[s][0] for s in order]) if order else (None, [])
    out = []
    for k, s in enumerate(order):
        for r, path in zip(each[s], below[s][1], strict=True):
            path, tampered = path + above[k], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = leaf((*r[:4], lowered(r[4]))) if tampered else leaf(r)
            for a, b in path:
                h = sha("".join([*a, h, *b]))
            out.append((r[0], leaf(r), below[s][0], root, sha("".join(x for a, b in path for x in a + b)), h, h == root))
    return sorted(out, key=str)


def check(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    found = queries.op13_merkle(spark, str(path)).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    return found


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, and columns named as the operator's own."""
    docs = documents(spark, [(20 + i, f"Text {i}") for i in range(40)])
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") == 4, "").otherwise(F.col("source")))
    docs = docs.withColumn("n_chars", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars"))).withColumns({c: F.lit("old") for c in ("leaf", "hash", "group", "key", "at", "i", "n", "path", "root", "changed")})
    found = check(spark, docs, tmp_path)
    assert {r.verified for r in found} == {True, False}


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {"a": 16}, {"a": 17, "b": 256, "c": 257, "d": 1}, {"hot": 4200, **{f"s{i:03}": 1 + i % 3 for i in range(300)}}])
def test_shapes(spark, tmp_path, sizes):
    """No row, lone leaves, full runs, one above, a group of several levels, and more groups than one run."""
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i * 7919 % 100_003, source, "en", i, f"Row {i}"))
            i += 1
    check(spark, spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), tmp_path)


def test_given_tables(spark, tmp_path, sf="/root/testdata/sf0.01"):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"), tmp_path)


def test_the_order_of_rows_has_no_effect_and_one_byte_has(spark):
    docs = documents(spark, [(20 + i, f"text {i}") for i in range(100)])
    roots = [merkle.manifest(d).proofs().select("root").distinct().collect() for d in (docs, docs.orderBy(F.desc("text")).repartition(3), docs.withColumn("text", F.when(F.col("doc_id") == 99, "text!").otherwise(F.col("text"))))]
    assert [len(r) for r in roots] == [1, 1, 1] and roots[0] == roots[1] != roots[2]


def test_stored_parents(spark):
    built = merkle.manifest(documents(spark, [(20 + i, f"text {i}") for i in range(300)]))
    for r in built.parents().collect():
        assert r.hash == sha(r.preimage) and 64 <= len(r.preimage) <= 1024
    proof = built.proofs().select(F.length(merkle.siblings(F.col("path"))).alias("n"), (merkle.folded(F.col("path"), F.col("hash")) == F.col("root")).alias("same")).collect()
    assert all(r.same and r.n % 64 == 0 for r in proof)


def test_empty_table(spark):
    assert merkle.manifest(empty(spark)).proofs().count() == 0
