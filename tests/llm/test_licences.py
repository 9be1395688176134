import re

from odd import documents, empty

from corvane.llm import licences, queries

LINES = {"gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.", "proprietary": "All rights reserved."}


def test_query_finds_the_lines_of_the_documents_and_no_others(spark, sf="/root/testdata/sf0.1"):
    rows = {r.doc_id: r.families for r in queries.op5_licences(spark, sf).collect()}
    wrong = 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for r in docs:
        plain = re.sub(r"[#$%&*!|]", "", r.text).lower()
        wrong += rows[r.doc_id] != ",".join(sorted(f for f, t in LINES.items() if t.lower() in plain))
    assert len(rows) == len(docs) and wrong <= 2
    assert sum(map(bool, rows.values())) > 200


def test_held_out_variants_and_unknown_texts(spark, sf):
    model = licences.model(spark.read.parquet(f"{sf}/documents.parquet"))
    filler = [b"quite", b"another", b"sentence", b"stands", b"here"]
    samples = licences.varied(77, 20, filler)
    right = [said is not None and said[0] == licences.CLASSES[c] for w, c in samples for said in [model.judge(w)]]
    assert sum(right) / len(right) > 0.95
    for text in ("", "the license plate of the car", "public transport in general", "version two of the novel", "an apache helicopter", "permission slip"):
        said = model.judge(licences.alnum_words(text.encode()))
        assert said is None or said[2] < 0.6, (text, said)


def test_odd_rows(spark):
    docs = documents(spark, [(100, "x\n" * 3 + LINES["mit"] + "\n" + LINES["gpl"]), (101, "word " * 20_000 + LINES["apache"])])
    model = licences.model(docs)
    rows = {r.doc_id: r for r in licences.licence_findings(docs, model).withColumn("said", licences.families()).collect()}
    assert [(x.line, x.family) for x in rows[100].licences] == [(3, "mit"), (4, "gpl")]
    assert rows[101].said == "apache" and rows[1].licences == [] and rows[2].licences == []
    assert licences.licence_findings(empty(spark), licences.model(empty(spark))).count() == 0
