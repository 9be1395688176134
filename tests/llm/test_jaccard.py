import random

import pytest
from odd import documents, empty

from corvane.llm import jaccard, queries
from corvane.llm.common import id_bits
from corvane.llm.graph import components
from corvane.llm.jaccard import jaccard_components


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    """Sizes, and the least id reachable, by all pairs that share a shingle."""
    sets = [shingle_set(t, k) for _, t in rows]
    by, parent = {}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(x)
    seen = set()
    for at in by.values():
        for a in at:
            for b in at:
                if a < b and (a, b) not in seen and None not in (rows[a][0], rows[b][0]):
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                        i, j = sorted((root(rows[a][0]), root(rows[b][0])))
                        parent[j] = i
    return sorted((str(i), len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets, strict=True))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, 4, 85, 100)
    assert got(queries.op9_jaccard(spark, sf)) == want
    assert len({c for *_, c in want}) < len(rows)


def varied(seed, n=240):
    """Copies of a few texts with more and more words changed, and a line that many share."""
    r = random.Random(seed)
    bases = [[f"v{r.randrange(60 if b % 2 else 5000)}" for _ in range(r.choice([3, 7, 12, 40, 150]))] for b in range(6)]
    line = [f"line{i}" for i in range(12)]
    out = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = f"new{r.randrange(4)}"
        if r.random() < 0.4:
            w = line + w
        out.append((1000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(1, 4, 85, 100), (2, 5, 4, 5), (3, 3, 3, 5), (4, 1, 1, 2)])
def test_against_all_pairs(spark, seed, k, num, den):
    docs = documents(spark, varied(seed))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(jaccard_components(docs, k, num, den, bits=12)) == brute(rows, k, num, den)


@pytest.mark.parametrize("many", [0, 2])
def test_lists_just_below_the_threshold(spark, monkeypatch, many):
    """Families whose members are mostly a little too different: pairs that no forest holds are verified too."""
    monkeypatch.setattr(jaccard, "MANY", many)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in r.sample(range(60), 2):
            w[at] = f"x{r.randrange(12)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4, 70, 100)
    assert 1 < len({c for *_, c in want}) < len(rows)
    assert got(jaccard_components(docs, 4, 70, 100, bits=12)) == want


def test_empty_table(spark):
    assert jaccard_components(empty(spark), bits=12).count() == 0


def test_components_of_chains_loops_and_repeats(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 7), (7, 9), (5, 5), (None, 4)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 141)}, 3: 3, 7: 3, 9: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_id_bits(spark):
    ids = spark.createDataFrame([(i * 37,) for i in range(500)], "id long")
    bits = id_bits(ids, "id", 18)
    h = [r.h for r in ids.selectExpr(f"pmod(xxhash64(id), {1 << 18}) h").collect()]
    assert all(bits[x >> 3] >> (x & 7) & 1 for x in h)
    assert sum(map(int.bit_count, bits.tolist())) == len(set(h))
