import hashlib

import public_tokenizers
import tiktoken
from odd import documents, empty

from corvane.llm import queries
from corvane.llm.bpe import ByteBpe, read_ranks, serialise


def bpe(spark):
    return ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def library():
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_library_on_odd_texts(spark):
    more = [(20 + i, t) for i, t in enumerate(["'s 'S don't  x\n\n y", "a\x1c\x1db\x85c", "࢏\U00011f00̀ q", " " * 999 + "a", "ab" * 9999, "<|endoftext|>"])]
    rows = bpe(spark).decode(bpe(spark).encode(documents(spark, more))).collect()
    assert len(rows) == 13 + len(more)
    encoding = library()
    for r in rows:
        assert r.ids == encoding.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.spans == "x"


def test_empty_table(spark):
    assert bpe(spark).decode(bpe(spark).encode(empty(spark))).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    encoding = library()
    rows = queries.op8_byte_bpe(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_ranks_must_be_whole():
    for ranks in ({bytes([i]): i for i in range(255)}, {bytes([i]): i + 1 for i in range(256)}):
        try:
            serialise(ranks)
        except ValueError:
            continue
        raise AssertionError("accepted")
