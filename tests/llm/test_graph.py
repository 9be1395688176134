"""Connected components: as plain union-find, in no more rounds than it takes."""

from __future__ import annotations

import random

from corvane.llm import graph, jaccard


def plain(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {x: top(x) for x in root}


def found(df):
    rows = df.collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def test_components_of_odd_graphs(spark):
    r = random.Random(5)
    sparse = [(r.randrange(300), r.randrange(300)) for _ in range(170)]
    path = [(i, i + 1) for i in range(1000, 1060)]
    turned = [(2000 - i * 7 % 61, 2000 - (i + 1) * 7 % 61) for i in range(60)]
    edges = [*sparse, *path, *turned, (5000, 5000), (None, 7), (8, None), (-3, 9000), (9000, -3)] + [(a, b) for a in range(6000, 6012) for b in range(6000, 6012)]
    r.shuffle(edges)
    assert found(graph.components(spark.createDataFrame(edges, "a long, b long"))) == plain(edges)
    assert found(graph.components(spark.createDataFrame([], "a long, b long"))) == {}


def test_what_is_settled_takes_no_round(spark, monkeypatch):
    rounds, step = [], graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda e: rounds.append(1) or step(e))
    stars = [(10 * i, 10 * i + j) for i in range(9) for j in range(1, 5)]
    own = graph.components(spark.createDataFrame(stars, "a long, b long"))
    assert found(own) == plain(stars) and not rounds
    none = spark.createDataFrame([], "a long, b long")
    assert jaccard._joined(own, none) is own and not rounds
    assert found(jaccard._joined(own, spark.createDataFrame([(14, 52)], "a long, b long"))) == plain([*stars, (14, 52)]) and len(rounds) <= 3
