"""Byte-level BPE by a sentencepiece model that is serialised from the ranks.

Every byte becomes one character, every token a piece scored by its negative
rank; the model normalises nothing, so the best-scored merge is the lowest rank.
Texts are split by the pre-token pattern first and each pre-token is encoded
alone. Decoding maps ids to pieces and characters back to bytes.

Null texts count as empty, empty texts have no ids; texts are taken whole,
whatever their length. Each input row gives one output row, repeated rows too; an empty
table gives an empty one. Further columns stay as they are; one that has the name of a
new column is an error.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import lists, map_arrow, pieces, slices, tidy, with_columns

#: Byte b is written as the character 256 + b, which is never white space.
FIRST = 0x100
#: Characters of texts that are encoded together.
TOGETHER = 500_000
#: Distinct pre-tokens, and their characters, that a Python worker remembers.
REMEMBERED, REMEMBERED_CHARS = 300_000, 8_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def as_piece(token: bytes) -> str:
    return "".join(chr(FIRST + b) for b in token)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, a number or a 32-bit float."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model: id = rank, score = -rank; one unknown piece at the end."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must count from 0 without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for bytes {missing[:5]}")
    pieces = [_field(1, _field(1, as_piece(t).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, t in enumerate(order)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(order)) + b"".join(_field(i, (1 << 64) - 1) for i in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


def _ranges(points: list[int]) -> str:
    """A regular expression's class of the given code points."""
    p = np.array(points)
    breaks = np.flatnonzero(np.diff(p) != 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(p[np.r_[0, breaks + 1]], p[np.r_[breaks, len(p) - 1]], strict=True))


def character_classes() -> dict[str, str]:
    """Letters, numbers and white space as the tokenizer library's Unicode tables have them."""
    import tiktoken

    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        one = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out[name] = _ranges(list(map(ord, bytes(one.encode_ordinary(everything)).decode())))
    return out


def spelled_out(pattern: str, classes: dict[str, str]) -> str:
    r"""``pattern`` for the re module: \p{L}, \p{N} and \s as explicit ranges."""
    out, inside = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\[sS]|\\.|.", pattern, re.S):
        if part in classes:
            out.append(classes[part] if inside else f"[{classes[part]}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{classes[chr(92) + 's']}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


def patterns(pattern: str) -> tuple[str, str, str]:
    """``pattern`` for texts of ASCII characters, of characters below U+10000, and of any."""
    full = character_classes()
    low = {k: "".join(r for r in re.findall(r"\\U.{8}-\\U.{8}", v) if r < r"\U00010000") for k, v in full.items()}
    return spelled_out(pattern, {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r "}), spelled_out(pattern, low), spelled_out(pattern, full)


class Encoder:
    """What one Python worker needs: the model, the patterns and remembered pre-tokens."""

    def __init__(self, model: bytes, split: tuple[str, str, str]):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = [re.compile(p) for p in split]
        self.high = re.compile("[\U00010000-\U0010ffff]")
        self.piece = {self.sp.id_to_piece(i): i for i in range(self.sp.get_piece_size() - 1)}
        self.token = [bytes(ord(c) - FIRST for c in p) for p in self.piece]
        self.table = {b: FIRST + b for b in range(256)}
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def forget(self) -> None:
        self.known.clear()
        self.chars = 0

    def encode(self, some: list[str]) -> list[np.ndarray]:
        """Ids of a few texts; new pre-tokens of all of them go to the model at once."""
        found = [self.split[0 if t.isascii() else 2 if self.high.search(t) else 1].findall(t) for t in some]
        known, piece = self.known, self.piece
        if new := [p for p in set().union(*found) if p not in known]:
            rest, mapped = [], []
            for p in new:
                m = p.encode().decode("latin-1").translate(self.table)
                if (i := piece.get(m)) is None:
                    rest.append(p)
                    mapped.append(m)
                else:  # as the library does: a whole pre-token that is a token needs no merges
                    known[p] = i.to_bytes(4, "little")
            known.update((p, np.array(ids, "<i4").tobytes()) for p, ids in zip(rest, self.sp.encode(mapped, out_type=int, num_threads=1), strict=True))
            self.chars += sum(map(len, new))
        out = [np.frombuffer(b"".join(map(known.__getitem__, f)), "<i4") for f in found]
        if len(known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_workers: dict[int, Encoder] = {}


class ByteBpe:
    """Encode and decode text columns; the vocabulary (a fixed file) is broadcast."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        model = serialise(read_ranks(ranks_path))
        self.spec = spark.sparkContext.broadcast((model, patterns(pattern)))

    def _worker(self):
        spec = self.spec

        def get() -> Encoder:
            key = hash(spec.value[0])
            if key not in _workers:
                _workers.clear()
                _workers[key] = Encoder(*spec.value)
            return _workers[key]

        return get

    def encode(self, df: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """Add ``ids`` array<int>; a column of that name is an error."""
        return self._mapped(df, text, ids, None)

    def round_trip(self, df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """``encode``, then ``decode`` of its ids, in one Python worker for each task in place of two."""
        return self._mapped(df, text, ids, decoded)

    def _mapped(self, df: DataFrame, text: str, ids: str, decoded: str | None) -> DataFrame:
        worker = self._worker()
        for c in (ids, decoded):
            if c and c.lower() in map(str.lower, df.columns):
                raise ValueError(f"there is a column {c} already; give another name")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = worker()
            try:
                for batch in batches:
                    for part, some in pieces(batch, text, TOGETHER):
                        found = encoder.encode([t.decode("utf-8", "replace") for t in some])
                        new = {ids: lists(found, pa.int32())}
                        if decoded:
                            new[decoded] = pa.array([encoder.decode(x) for x in found], pa.binary())
                        yield with_columns(part, **new)
            finally:  # a reused Python worker keeps the model only
                encoder.forget()

        more = f"`{ids}` array<int>" + (f", `{decoded}` binary" if decoded else "")
        return df.select(*(F.col(f"`{c}`") for c in df.columns)).mapInArrow(tidy(run), _schema(df, more))

    def decode(self, df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """Add ``decoded`` binary, the bytes that the ids stand for; null ids give no bytes. A column of that name is an error."""
        if decoded.lower() in map(str.lower, df.columns):
            raise ValueError(f"there is a column {decoded} already; give another name")
        worker = self._worker()

        def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            decode = worker().decode
            flat, ends = slices(batch[ids])
            return with_columns(batch, **{decoded: pa.array([decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})

        return map_arrow(df, per_batch, _schema(df, f"`{decoded}` binary"))


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [more])
