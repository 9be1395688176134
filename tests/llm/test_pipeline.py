"""Each stage of corpus_pipeline on odd rows and on the small tables against plain Python, and run() against its stages."""

import pytest
import test_decontam
import test_jaccard
from odd import documents, empty

import corpus_pipeline as cp
from corvane.llm import secrets, toxicity
from corvane.llm.common import table

MORE = [
    (200, "one two three four five six seven eight nine ten " * 3), (201, "one two three four five six seven eight nine ten " * 3), (202, "a key q7Zt0vXk29LmWp4RbN8sYdEu1 and password=longenough99 here"),
    (None, "equal texts without an id"), (None, "equal texts without an id"), (None, None), (None, None),
]


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def tables(spark, sf):
    yield documents(spark, MORE)
    yield table(spark, sf, "documents")


def test_stages_keep_columns_and_take_empty_tables(spark, sf):
    for name, stage in cp.STAGES:
        out = stage(spark, empty(spark), sf)
        assert out.count() == 0, name
        if name != "byte_bpe":
            assert out.schema.names == empty(spark).schema.names, name


def test_toxic_documents_go(spark, sf="/root/testdata/sf0.01"):
    model = toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert rows(cp.without_toxic(spark, empty(spark), sf)) == []
    docs = table(spark, sf, "documents")
    said = {r.doc_id: r.p for r in toxicity.severity(docs.select("doc_id", "text"), model).withColumnRenamed("p_toxic", "p").collect()}
    kept = {r.doc_id for r in cp.without_toxic(spark, docs, sf).collect()}
    assert kept == {i for i, p in said.items() if p < model.cut} and len(kept) < len(said)
    odd = documents(spark, MORE)
    assert rows(cp.without_toxic(spark, odd, sf)) == rows(odd)


def test_one_of_near_copies_stays(spark, sf):
    for docs in tables(spark, sf):
        data = [(r.doc_id, r.text) for r in docs.collect()]
        least = {i: c for (i, _, c) in test_jaccard.brute([x for x in data if x[0] is not None], 5, 4, 5)}
        want = [(i, t) for i, t in data if i is None or least[str(i)] == i]
        got = [(r.doc_id, r.text) for r in cp.without_near_copies(spark, docs, sf).collect()]
        # of rows alike in id and text one stays; null and blank ones without an id all do
        once = sorted(map(str, set(want)))
        assert sorted(map(str, set(got))) == once
        assert len(got) == len(set(want)) + sum(1 for x in want if x == (None, None)) - (1 if (None, None) in want else 0)


def test_benchmark_passages_go(spark, sf):
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    for docs in tables(spark, sf):
        data = docs.collect()
        hits = test_decontam.brute([r.text for r in data], items)
        want = [r for r, (n, hit, _) in zip(data, hits, strict=True) if not (hit and 20 * hit >= n)]
        assert rows(cp.without_benchmark(spark, docs, sf)) == sorted(map(str, (tuple(r) for r in want)))


def test_secrets_are_replaced(spark, sf):
    for docs in tables(spark, sf):
        found = secrets.secret_spans(docs.select("doc_id", "text", "lang", "source", "n_chars"), secrets.model(spark, docs), base="b", spans="s").collect()
        want = []
        for r in found:
            t, at, out = r.text, 0, []
            for x in sorted((x["from"], x["to"]) for x in r.s):
                if x[0] >= at:
                    out += [t[at : x[0]], "[secret]"]
                at = max(at, x[1])
            new = "".join([*out, t[at:]]) if r.s else t
            want.append((r.doc_id, new, r.lang, r.source, len(new) if r.s else r.n_chars))
        out = cp.without_secrets(spark, docs, sf)
        assert out.schema.names == docs.schema.names
        assert rows(out.select("doc_id", "text", "lang", "source", "n_chars")) == sorted(map(str, want))
    assert not any("longenough99" in (r.text or "") for r in cp.without_secrets(spark, documents(spark, MORE), sf).collect())


def test_tokens(spark, sf):
    import public_tokenizers
    import tiktoken

    from corvane.llm.bpe import read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in tables(spark, sf):
        data = [(r.doc_id, r.text or "") for r in docs.collect() if len(r.text or "") < 40_000]
        out = cp.tokens(spark, docs, sf).collect()
        assert len(out) == docs.count() and all(r.same and r.n_tokens == len(r.ids) for r in out)
        assert {str((i, known.encode_ordinary(t))) for i, t in data} <= {str((r.doc_id, r.ids)) for r in out}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_run_is_its_stages(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    assert rows(cp.run(spark, sf)) == rows(docs)
