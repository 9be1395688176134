"""Ids and texts as the tokenizers library makes them."""

import hashlib
import json

import public_tokenizers
import pytest
from odd import documents, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import queries, wordbpe
from corvane.llm.wordbpe import Splitter, WordBpe, _patterns

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Don't we'll I'm THEY'RE it'S 've 'd", "a<|endoftext|>b <|STARTOFTEXT|><|startoftext|>", "<|endoftext|><|endoftext|>", "İstanbul ΣΑΣ ς K Å é ẹ́ ﬁ 가", "१२٣4⅓ x²",
    "a\x1cb\x85c\xa0d​e　f g", "''''s !!!---???", "日本語テキスト\U0001f600\U0001f468‍\U0001f469", "́alone", "x" * 3000 + " " + "ab1" * 700, "ǅ ǈ ẞ ꙍ Ꚁ \U00010400 \U0001e900",
]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def test_like_the_library_on_odd_texts(spark, library):
    docs = documents(spark, [(100 + i, t) for i, t in enumerate(TEXTS)])
    for stretch in (1, 60_000, wordbpe.STRETCH):
        codec = WordBpe(spark, PATH, stretch)
        rows = codec.decode(codec.encode(docs.withColumn("again", F.col("text")))).collect()
        assert len(rows) == docs.count()
        for r in rows:
            ids = library.encode(r.again or "", add_special_tokens=False).ids
            assert r.ids == ids and r.spans == "x"
            assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_every_character_lowers_as_in_the_library(library):
    with open(PATH, encoding="utf-8") as f:
        definition = f.read()
    split = Splitter(definition, _patterns(definition)).words
    for a in range(0, 0x110000, 997):
        text = "x ".join(chr(c) for c in range(a, min(a + 997, 0x110000)) if not 0xD800 <= c < 0xE000)
        found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        alone = [library.pre_tokenizer.pre_tokenize_str(w)[0][0] for w in split(text)]
        assert alone == [w for w, _ in found], hex(a)


def test_query(spark, library, sf="/root/testdata/sf0.01"):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_word_bpe(spark, sf).collect()
    assert len(rows) == len(texts) and {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_each_distinct_word_is_one_row_a_stretch(spark):
    docs = spark.createDataFrame([(i, "one two one " * 50 + f"w{i}") for i in range(40)], "doc_id long, text string").coalesce(2)
    rows = WordBpe(spark, PATH).words(docs).collect()
    assert len({r.stretch for r in rows}) == 2
    assert sorted(r.word for r in rows if r.word in ("one", "two")) == ["one", "one", "two", "two"]


def test_documents_behind_an_exchange(spark, library):
    docs = documents(spark).repartition(5, "doc_id").orderBy("text")
    rows = WordBpe(spark, PATH).encode(docs.withColumn("again", F.col("text"))).collect()
    assert len(rows) == docs.count()
    assert all(r.ids == library.encode(r.again or "", add_special_tokens=False).ids for r in rows)


def test_decode_skips_unknown_ids(spark, library):
    lists = [None, [], [320], [0, 49407, 256], [320, 49408, -1, 256], [49999]]
    rows = WordBpe(spark, PATH).decode(spark.createDataFrame([(x,) for x in [*lists, [320, None, 256]]], "ids array<int>")).collect()
    for r, x in zip(rows, lists, strict=False):
        assert r.decoded == library.decode([i for i in x or [] if i >= 0], skip_special_tokens=False)
    assert rows[-1].decoded == library.decode([320, 256], skip_special_tokens=False)


def test_empty_table_names_and_other_tokenizers(spark, tmp_path):
    codec = WordBpe(spark, PATH)
    assert codec.decode(codec.encode(empty(spark))).count() == 0
    for call in (lambda: codec.encode(documents(spark), ids="spans"), lambda: codec.decode(codec.encode(documents(spark)), decoded="lang")):
        with pytest.raises(ValueError, match="already"):
            call()
    with open(PATH, encoding="utf-8") as f:
        other = json.load(f)
    other["normalizer"]["normalizers"].pop()
    (tmp_path / "other.json").write_text(json.dumps(other))
    with pytest.raises(ValueError, match="lowers case"):
        WordBpe(spark, str(tmp_path / "other.json"))
