"""Tables that have columns named as an operator's results: replaced, or refused, as each docstring says."""

import pytest
from odd import documents
from pyspark.sql import functions as F

from corvane.llm import bpe, classlm, decontam, licences, secrets, toxicity
from corvane.llm.common import table

NAMES = ("licences", "ids", "decoded", "base", "n_tokens", "severity", "p_toxic", "grade", "n_words", "n_items", "items", "key", "label", "row")


def test_results_replace_columns_of_their_names(spark, sf):
    docs = documents(spark).withColumns({c: F.lit("old") for c in NAMES})
    found = {
        "licences": licences.licence_findings(docs, licences.model(table(spark, sf, "documents"))),
        "spans": secrets.secret_spans(docs, secrets.model(spark, docs)),
        "severity": toxicity.severity(docs, toxicity.Ordinal({}, toxicity.np.zeros(0), toxicity.np.array([30.0]))),
        "n_items": decontam.contamination(docs, table(spark, sf, "benchmark")),
        "items": decontam.contamination(docs, table(spark, sf, "benchmark"), block_bytes=2_000),
    }
    for c, df in found.items():
        assert len({x.lower() for x in df.columns}) == len(df.columns), c
        assert set(docs.columns) <= set(df.columns)
        rows = df.collect()
        assert len(rows) == docs.count() and all(r[c] != "old" for r in rows)
        assert all(r["row"] == "old" and r["label"] == "old" for r in rows)


def test_names_that_are_refused(spark):
    import public_tokenizers

    docs = documents(spark).withColumns({c: F.lit("old") for c in NAMES})
    codec = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for call in (lambda: codec.encode(docs), lambda: codec.round_trip(docs, ids="own"), lambda: codec.decode(docs.withColumn("own", F.array(F.lit(1))), "own")):
        with pytest.raises(ValueError, match="already"):
            call()
    model, rest = classlm.train(documents(spark), frequent=20, clustered=5, classes=3)
    with pytest.raises(ValueError, match="n_tokens"):
        classlm.score(docs, model, rest, [F.col("doc_id"), F.col("n_tokens")])
