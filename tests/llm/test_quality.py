import math
import re

import numpy as np
from odd import documents, empty
from pyspark.sql import functions as F

from corvane.llm import quality, queries


def test_held_out_accuracy(spark, sf="/root/testdata/sf0.01"):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op1_quality(spark, sf).join(labels, "doc_id", "left").collect()
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    stats, names = quality.with_statistics(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.held_out("doc_id", 5)
    other = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(stats, labels.where(~out), names) == quality.train(stats, other.where(~out), names)


def test_rules_find_a_conjunction_and_compile(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3)).astype(float)
    rules = quality.fit_rules(x, y, ["a", "b", "c"])
    assert 0 < len(rules.rules) <= 40
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    rows = df.withColumn("s", rules.score({n: F.col(n) for n in "abc"})).collect()
    assert np.mean([(r.s >= 0.5) == r.y for r in rows]) > 0.98


def test_odd_rows_and_labels(spark):
    stats, names = quality.with_statistics(documents(spark))
    for rows in ([], [(4, None), (None, 1)], [(4, 1), (5, 1)], [(4, 1), (4, 0), (9, 1), (5, 0)]):
        rules = quality.train(stats, spark.createDataFrame(rows, "doc_id long, quality int"), names)
        scores = [r.s for r in stats.select(rules.score({n: F.col(n) for n in names}).alias("s")).collect()]
        assert len(scores) == 13 and all(0 <= s <= 1 for s in scores)
    assert quality.with_statistics(empty(spark))[0].count() == 0


def statistics(t):
    """The same statistics of one text in plain Python."""
    n = max(1, len(t))
    words = [w for w in re.split(r"[ \n\t\r]+", t) if w]
    lines = t.split("\n")
    n_words = max(1, len(words))
    share = lambda p: len(re.findall(p, t)) / n
    return {
        "log_chars": math.log1p(len(t)), "word_length": len(t) / n_words, "distinct_words": math.log1p(len(set(words))) / math.log1p(n_words), "distinct_lines": len(set(lines)) / len(lines),
        "line_words": math.log1p(n_words / len(lines)), "symbols": share(r"[#$%&*|!]"), "capitals": share("[A-Z]"), "digits": share("[0-9]"), "stops": share("[.?]"), "other": share("[^A-Za-z0-9 \t\n\x0b\f\r\u00c0-\u024f.,?#$%&*|!]"),
    }


def test_query_against_the_rules_in_plain_python(spark, sf="/root/testdata/sf0.01"):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stats, names = quality.with_statistics(docs)
    rules = quality.train(stats, spark.read.parquet(f"{sf}/labels.parquet").where(~queries.held_out("doc_id", 5)), names)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = queries.op1_quality(spark, sf).collect()
    assert rules.rules and {r.doc_id for r in rows} == set(texts)
    for r in rows:
        of = statistics(texts[r.doc_id])
        margin = rules.intercept + sum(w for w, rule in rules.rules if all(of[s] > b if over else of[s] <= b for s, over, b in rule))
        assert math.isclose(r.score, 1 / (1 + math.exp(-margin)), rel_tol=1e-9)
