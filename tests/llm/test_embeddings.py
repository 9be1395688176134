import numpy as np
import pytest

from corvane.llm import queries
from corvane.llm.embeddings import near_duplicates, quantise


def brute(rows, least):
    """n_links and component of each row by all pairs in double precision."""
    n = len(rows)
    good = []
    for i, v, label in rows:
        ok = i is not None and label is not None and v is not None and len(v) and None not in v
        x = np.array(v if ok else [0.0], float)
        good.append(x if ok and np.isfinite(x).all() and x.any() else None)
    links, parent = [0] * n, {i: i for i, *_ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(n):
        for b in range(a):
            if good[a] is not None and good[b] is not None and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]):
                if good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= least:
                    links[a] += 1
                    links[b] += 1
                    i, j = sorted((root(rows[a][0]), root(rows[b][0])))
                    parent[j] = i
    return sorted((str(r[0]), k, None if r[0] is None else root(r[0])) for r, k in zip(rows, links, strict=True))


def got(df):
    return sorted((str(r.vec_id), r.n_links, r.component_id) for r in df.collect())


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = queries.op3_embedding_dedup(spark, sf)
    want = brute(rows, 0.93)
    assert got(out) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.collect())


@pytest.mark.parametrize("block", [1024, 7])
def test_copies_chains_and_unusable_vectors(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    vectors = [base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.4]) for _ in range(150)]
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3)) for i, v in enumerate(vectors)]
    rows += [(200 + i, rows[3][1], rows[3][2]) for i in range(9)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-30] * 16, [1e30] * 16]
    rows += [(300 + i, v, 1) for i, v in enumerate(odd)] + [(400, rows[1][1], None), (None, rows[1][1], 1), (401, rows[1][1], 9)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    assert got(near_duplicates(df, 0.93, block=block)) == brute(rows, 0.93)
    assert near_duplicates(df.where("false")).count() == 0


def test_error_bounds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, scale, lost = quantise(x)
    near = q.astype(float) @ q.astype(float).T * scale[:, None] * scale
    assert (np.abs(near - x @ x.T) <= lost[:, None] + lost * (1 + lost[:, None])).all()
