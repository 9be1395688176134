from odd import documents

from corvane.llm import licences


def test_sampled_lines_spread_over_the_sorted_corpus_and_counts_cover_all_lines(spark):
    lines = [f"{a}{b} line number {a}{b}{i}" for i in range(20) for a in "abcdefghij" for b in "klmnopqrst"]
    lines += ["the apache helicopter"] * 3 + ["Licensed under the Apache License, Version 2.0."] * 5
    docs = documents(spark, [(100 + i, "\n".join([line, line])) for i, line in enumerate(lines)])
    found = licences.corpus(docs, most=200)
    first = [p[0][:1].decode() for p in found.paragraphs if p[1:3] == [b"line", b"number"]]
    assert len(found.paragraphs) <= 200 and len(first) > 150
    assert all(8 <= first.count(a) <= 35 for a in "abcdefghij")
    plain = [set(licences.alnum_words(x.encode())) for r in docs.collect() for x in set((r.text or "").split("\n"))]
    plain = [p for p in plain if p and not {b"apache", b"license"} <= p]
    assert found.plain == len(plain)
    assert {w: n for w, n in found.df.items() if n} == {w: n for w in licences.TOLD if (n := sum(w in p for p in plain))}
    assert found.df[b"apache"] == 3
