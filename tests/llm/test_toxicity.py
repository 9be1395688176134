import re

import numpy as np
from odd import documents, empty
from pyspark.sql import functions as F

from corvane.llm import queries, toxicity


def test_held_out_accuracy(spark, sf="/root/testdata/sf0.1"):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where("pmod(xxhash64(doc_id), 2) = 0"))
    rows = toxicity.severity(docs.join(labels.where("pmod(xxhash64(doc_id), 2) = 1"), "doc_id"), model).withColumn("said", toxicity.is_toxic(model)).collect()
    found = np.mean([r.said for r in rows if r.toxic])
    alarms = np.mean([r.said for r in rows if not r.toxic])
    assert found > 0.7 and alarms < 0.01
    assert np.mean([r.severity for r in rows if r.toxic]) > 1 > 5 * np.mean([r.severity for r in rows if not r.toxic])


def test_thresholds_are_ordered_and_shared():
    rng = np.random.default_rng(0)
    n = 3000
    x = rng.random((n, 3))
    margin = x @ np.array([4.0, 2.0, 0.0])
    grades = np.searchsorted([2.0, 3.0, 4.5], margin + rng.logistic(size=n))
    weights, t = toxicity.fit_ordinal(np.repeat(np.arange(n), 3), np.tile(np.arange(3), n), x.ravel(), grades, 3)
    assert (np.diff(t) > 0).all()
    assert np.allclose(weights, [4, 2, 0], atol=0.5) and np.allclose(t, [2, 3, 4.5], atol=0.5)
    p = toxicity.Ordinal({}, weights, t).above(margin)
    assert (np.diff(p, axis=1) < 0).all()


def test_odd_rows_and_labels(spark):
    docs = documents(spark, [(100 + i, "good words here" if i % 2 else "bad badword here") for i in range(60)])
    labels = spark.createDataFrame([(None, 1), (100, None), *((100 + i, 1 - i % 2) for i in range(60)), (101, 0)], "doc_id long, toxic int")
    for some, n in ((labels, 30), (labels.where("false"), 0), (labels.where("toxic = 0"), 0)):
        model = toxicity.train(docs, some)
        rows = toxicity.severity(docs, model, prefix="own_").collect()
        assert len(rows) == 73 and all(0 <= r.own_severity <= 3 for r in rows)
        kept = toxicity.without_toxic(docs, some)
        assert kept.columns == docs.columns and kept.count() in (73 - n, 73)
    assert toxicity.without_toxic(empty(spark), labels).count() == 0


def test_one_labelled_id_in_very_many_rows(spark, sf, monkeypatch):
    """No more rows come to the driver than there are labels, and repeats change nothing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one = labels.join(docs, "doc_id").orderBy("doc_id").first()
    more = docs.union(spark.range(50_000).select(F.lit(one.doc_id), F.lit(one.text)))
    want, sizes, kind = toxicity.train(docs, labels), [], type(docs)
    monkeypatch.setattr(kind, "collect", lambda self, f=kind.collect: (sizes.append(len(rows := f(self))), rows)[1])
    found = toxicity.train(more, labels)
    assert sizes and max(sizes) <= max(2_000, labels.count())
    assert found.features == want.features and np.allclose(found.weights, want.weights) and found.cut == want.cut


def test_query(spark, sf):
    rows = queries.op7_toxicity(spark, sf).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_query_against_the_model_in_plain_python(spark, sf="/root/testdata/sf0.01"):
    """Chances of each grade from the shared weights and the ordered thresholds, text by text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = queries.op7_toxicity(spark, sf).collect()
    assert model.features and any(r.toxic for r in rows)
    for r in rows:
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))
        words = [w.encode() for w in words]
        margin = 0.0
        for f, i in model.features.items():
            n = sum(w == f[:-1] if f.endswith(b"$") else w.startswith(f) for w in words)
            if n:
                margin += model.weights[i] * (1 + np.log1p(1000 * n / len(words)))
        above = [1 / (1 + np.exp(np.clip(t - margin, -40, 40))) for t in model.thresholds]
        assert np.isclose(r.severity, sum(above), rtol=1e-9) and np.isclose(r.p_toxic, above[0], rtol=1e-9)
        assert r.toxic == (above[0] >= model.cut) or np.isclose(above[0], model.cut)
