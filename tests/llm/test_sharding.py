import hashlib
from collections import defaultdict

from odd import documents, empty

from corvane.llm import queries
from corvane.llm.sharding import BITS, shard


def bits(i, text):
    key = ([] if i is None else [str(i)]) + [hashlib.md5((text or "").encode()).hexdigest()]
    return format(int(hashlib.md5("\x1f".join(key).encode()).hexdigest()[: BITS // 4], 16), f"0{BITS}b")


def brute(rows, limit):
    """Split oversized buckets bit by bit; the shard of each row."""
    out = {}

    def split(prefix, members):
        if len(prefix) < BITS and sum(n for *_, n in members) > limit:
            for b in "01":
                if part := [m for m in members if m[1][len(prefix)] == b]:
                    split(prefix + b, part)
        else:
            out.update({m[0]: prefix for m in members})

    split("", [(x, bits(i, t), len((t or "").encode())) for x, (i, t) in enumerate(rows)])
    return out


def check(df, docs, limit):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    shards = brute(rows, limit)
    want = sorted((str(i), len((t or "").encode()), shards[x]) for x, (i, t) in enumerate(rows))
    got = df.collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.shard) for r in got) == want
    sums = defaultdict(int)
    for r in got:
        sums[r.shard] += r.n_bytes
    for r in got:
        assert r.shard_bytes == sums[r.shard] and r.depth == len(r.shard) and r.oversized == (r.shard_bytes > limit)


def test_against_splitting_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for limit in (1 << 40, 60_000, 5_000, 100):
        check(shard(docs, limit), docs, limit)


def test_odd_rows(spark):
    docs = documents(spark, [(None, "a row without an id")] * 3)
    check(shard(docs, 200), docs, 200)
    assert shard(empty(spark), 10).count() == 0


def test_query(spark, sf="/root/testdata/sf0.1"):
    rows = queries.op2_sharding(spark, sf).collect()
    assert not any(r.oversized for r in rows)
