import numpy as np
from odd import documents
from pyspark.sql import functions as F

from corvane.llm import classlm


def test_words_that_are_not_clustered_get_the_class_of_their_neighbours(spark):
    """Three kinds of words follow each other in turn; only some of each kind are clustered, some are rare."""
    rng = np.random.default_rng(0)
    texts = []
    for _ in range(600):
        kinds = (rng.integers(0, 3) + np.arange(30)) % 3
        which = np.where(rng.random(30) < 0.5, rng.integers(0, 3, 30), rng.integers(0, 200, 30))
        texts.append(" ".join(f"{'abc'[k]}{i}" for k, i in zip(kinds, which, strict=True)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, rest = classlm.train(docs, frequent=100, clustered=9, classes=3, weight=1.0)
    kinds = {w[:1]: set() for w in model.index}
    for w, i in model.index.items():
        kinds[w[:1]].add(int(model.class_of[i]))
    assert len(model.index) > 50 and sorted(map(len, kinds.values())) == [1, 1, 1] and len(set.union(*kinds.values())) == 3
    words = classlm.word_counts(docs).select("word", F.xxhash64("word").alias("h")).join(rest, "h").collect()
    assert len(words) == 600 - len(model.index)
    assert np.mean([r["class"] in kinds[bytes(r.word)[:1]] for r in words]) > 0.99


def test_scores_agree_with_chances_that_sum_to_one(spark):
    docs = documents(spark)
    model, rest = classlm.train(docs, frequent=20, clustered=5, classes=3)
    of = {r.h: (r["class"], r.c) for r in rest.collect()}
    hashes = {bytes(r.word): r.h for r in classlm.word_counts(docs).select("word", F.xxhash64("word").alias("h")).collect()}

    def chance(before, word):
        """log10 of the word's chance and the class it is known by to the next."""
        if word in model.index:
            i = model.index[word]
            return model.transition[before, model.class_of[i]] + model.emission[i], model.class_of[i]
        d, c = of.get(hashes.get(word), (model.class_of[-2], 0))
        if c == 0:
            return model.rest_transition[before, -1], d
        n, v = model.rest_emission[:, d]
        return model.rest_transition[before, d] + np.log10((c + 0.1) / (n + 0.1 * v)), d

    for before in range(len(model.transition)):
        total = 10 ** model.transition[before, model.class_of[-1]] + sum(10 ** chance(before, w)[0] for w in [*hashes, b"never seen"])
        assert np.isclose(total, 1, rtol=1e-9)
    new = spark.createDataFrame([(1, "one w3 Never w996 two w5 w6 w7 unseen unseen w1"), (2, ""), (3, "new")], "doc_id long, text string")
    for table in (docs.where("doc_id <> 9 and doc_id <> 10"), new):
        have = {r.doc_id: r.score for r in classlm.score(table, model, rest, [F.col("doc_id")]).collect()}
        for r in table.collect():
            want, before = 0.0, model.class_of[-1]
            for w in (r.text or "").encode().lower().split():
                p, before = chance(before, w)
                want += p
            assert np.isclose(have[r.doc_id], want + model.transition[before, model.class_of[-1]], rtol=1e-9)
