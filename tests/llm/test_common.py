"""Hashes of words and shingles over whole batches equal those of one text at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm.common import _BLOCK, ALNUM, SPACE, all_shingles, alnum_words, distinct_in, hashed_words, pieces, shingles, space_words

R = random.Random(4)
TEXTS = [
    b"", b" \t\n\x0b", b"One", b"one TWO three", "naïve Wörtchen   日本語".encode(), b"x" * (3 * _BLOCK + 5) + b" y", b"y " * 40, b"a" * (_BLOCK - 1) + b" b", b"tail\x00zero",
    b" ".join(b"w%d" % R.randrange(500) for _ in range(60_000)),
]


@pytest.mark.parametrize(("table", "split"), [(SPACE, space_words), (ALNUM, alnum_words)])
def test_words(table, split):
    h, ends = hashed_words(TEXTS, table)
    of: dict[bytes, int] = {}
    for t, a, b in zip(TEXTS, ends[:-1], ends[1:], strict=True):
        words = split(t)
        assert len(words) == b - a
        assert (hashed_words([t], table)[0] == h[a:b]).all()
        for w, v in zip(words, h[a:b].tolist(), strict=True):
            assert of.setdefault(w, v) == v
    assert len(set(of.values())) == len(of)
    assert len(hashed_words([], table)[0]) == 0


@pytest.mark.parametrize("k", [1, 3, 5, 11])
def test_shingles_and_sets(k):
    h, ends = hashed_words(TEXTS, SPACE)
    s, at = all_shingles(h, ends, k)
    for i in range(len(TEXTS)):
        assert (s[at[i] : at[i + 1]] == shingles(h[ends[i] : ends[i + 1]], k)).all()
    want = [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    u, new = distinct_in(s.copy(), at)
    assert all((u[new[i] : new[i + 1]] == want[i]).all() and new[i + 1] - new[i] == len(want[i]) for i in range(len(TEXTS)))


def test_pieces_cover_the_batch():
    batch = pa.RecordBatch.from_pydict({"i": list(range(9)), "text": ["a" * 10, None, "b" * 5, "", "c" * 30, "d", "e", None, "f" * 9]})
    parts = list(pieces(batch, "text", 12))
    assert [i for p, _ in parts for i in p["i"].to_pylist()] == list(range(9)) and len(parts) > 2
    assert [t for _, some in parts for t in some] == [(x or "").encode() for x in batch["text"].to_pylist()]
