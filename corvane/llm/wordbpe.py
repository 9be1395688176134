"""BPE over a table of the distinct words.

Texts are split into words; each distinct word is encoded once, by the tokenizers
library, and its ids go back to the word's places. To that end a task numbers the words
of a stretch of its texts (about ``STRETCH`` bytes) as they appear: a text becomes a
sequence of numbers, and the stretch one row (stretch, number, word) for each of its
distinct words. The words of all stretches meet in one exchange by word, sorted, where
equal ones follow each other and are encoded once; their ids meet the sequences in one
exchange by stretch. A very frequent word is one row a stretch, however often it occurs,
and a stretch has a bounded size, so no task has more than its share. Decoding joins ids
with the table of ids and pieces, which has the vocabulary's size and goes to every task.

The words are what the library's own normaliser and pattern make of a text; strings of
added tokens are words of their own, as they are for the library.

Defined results: null texts count as empty, empty texts and texts of blanks have no ids;
texts and words are taken whole, whatever their length. Each input row gives one output
row, repeated rows too; an empty table gives an empty one. ``encode`` returns the further
columns as they are, but not the text; one that has the name of a new column is an error.
Ids that the vocabulary does not have, and null ones, give no piece, as in the library.

The documents are read twice, and both readings must put the same rows into the same
partitions; a plan that has exchanges is therefore written to the checkpoint folder
first. Should the readings differ all the same, the job fails; it never mixes them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.bpe import spelled_out
from corvane.llm.common import OWN, cut, lists, map_arrow, pieces, slices, tidy, with_columns

#: Bytes of text whose words are numbered together.
STRETCH = 16 << 20
#: Texts with no character from here on are in composed form.
_COMPOSED = re.compile("[̀-\U0010ffff]")
_HIGH = re.compile("[\U00010000-\U0010ffff]")
#: Words whose ids a task holds back, to send those of a stretch together.
HELD = 1_000_000


def _library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    return tokenizers


def _tokenizer(definition: str):
    found = _library().Tokenizer.from_str(definition)
    found.no_truncation()
    found.no_padding()
    return found


def _character_classes() -> dict[str, str]:
    """Letters, numbers and white space as the library's patterns have them."""
    lib, out = _library(), {}
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        runs = lib.pre_tokenizers.Split(lib.Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str(everything)
        out[name] = "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r, _ in runs)
    return out


def _patterns(definition: str) -> tuple[str, str, str]:
    """The pattern of words for texts of ASCII characters, of characters below U+10000, and of any; refuses other kinds of tokenizers."""
    known = json.loads(definition)
    steps = (known["pre_tokenizer"] or {}).get("pretokenizers", [])
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or known["post_processor"] or known["decoder"]:
        raise ValueError("a tokenizer that keeps the matches of one pattern, bytes as characters, is needed")
    normalisers = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) for n in (known["normalizer"] or {}).get("normalizers", [])]
    if normalisers != [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]:
        raise ValueError("a tokenizer that composes, joins blanks and lowers case is needed")
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in known["added_tokens"]):
        raise ValueError("added tokens must stand for their very strings")
    pattern = steps[0]["pattern"]["Regex"]
    full = _character_classes()
    low = {k: "".join(r for r in re.findall(r"\\U.{8}-\\U.{8}", v) if r < r"\U00010000") for k, v in full.items()}
    return spelled_out(pattern, {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r "}), spelled_out(pattern, low), spelled_out(pattern, full)


class Splitter:
    """Splits texts into the words that the library would encode one by one."""

    def __init__(self, definition: str, patterns: tuple[str, str, str]):
        self.ascii, self.low, self.any = (re.compile(p).findall for p in patterns)
        self.normalise = _tokenizer(definition).normalizer.normalize_str
        self.added = [t["content"] for t in json.loads(definition)["added_tokens"]]
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def words(self, text: str) -> list[str]:
        if any(a in text for a in self.added):
            out = []
            for i, part in enumerate(self.apart.split(text)):
                out += [part] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        # blanks are part of no word, so there is no need to join them
        if text.isascii():
            return self.ascii(text.lower())
        if not _COMPOSED.search(text):
            return self.low(text.lower())
        text = self.normalise(text)  # which may go beyond the characters that it is given
        return (self.any if _HIGH.search(text) else self.low)(text)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as planes of bytes, the low ones first, compressed."""
    planes = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return sum(p.astype(np.int32) << 8 * k for k, p in enumerate(planes))


def _gathered(which: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of lists that lie one after the other in ``flat``, the chosen ones, again one after the other."""
    start, many = ends[which], ends[which + 1] - ends[which]
    return flat[np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())]


def _differ() -> RuntimeError:
    return RuntimeError("the documents' two readings differ")


def _table(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words of a stretch by their numbers, one after the other, and where each word's begin and end."""
    number = np.concatenate([np.cumsum(gaps) for gaps, _, _ in held])
    size, flat = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
    order = np.argsort(number)
    if not np.array_equal(number[order], np.arange(len(number))):
        raise _differ()
    flat = _gathered(order, flat, np.concatenate([[0], np.cumsum(size)]))
    return flat, np.concatenate([[0], np.cumsum(size[order])])


class WordBpe:
    """Encode and decode columns by a tokenizer's file; the file, of fixed size, is broadcast."""

    def __init__(self, spark: SparkSession, path: str, stretch: int = STRETCH):
        with open(path, encoding="utf-8") as f:
            definition = f.read()
        self.stretch = stretch
        self.spec = spark.sparkContext.broadcast((definition, _patterns(definition)))
        known = _tokenizer(definition)
        self.pieces = spark.sparkContext.broadcast([known.id_to_token(i) for i in range(known.get_vocab_size(with_added_tokens=True))])

    def _stretches(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch], list[np.ndarray], list[str]]]:
        """Each stretch's key, rows, word numbers by row, and words, from rows (text, part, ...).

        A row's stretch depends on the bytes before it in the partition alone, not on batches.
        The key is a digest of the partition, the stretch's number and the words.
        """
        split = Splitter(*self.spec.value).words
        part, before, at = 0, 0, 0
        rows, found, number = [], [], defaultdict()

        def whole() -> tuple[int, list[pa.RecordBatch], list[np.ndarray], list[str]]:
            words = list(number)
            seen = hashlib.blake2b(f"{part} {at} ".encode(), digest_size=8)
            for i in range(0, len(words), 10_000):
                seen.update("\n".join(words[i : i + 10_000]).encode())
            return int.from_bytes(seen.digest(), "little", signed=True), rows, found, words

        number.default_factory = number.__len__
        for batch in batches:
            for piece, some in pieces(batch, "text"):
                part, first = piece["part"][0].as_py(), 0
                for i, t in enumerate(some):
                    if (rows or first < i) and before // self.stretch != at:
                        if first < i:
                            rows.append(piece.slice(first, i - first).drop_columns(["text"]))
                        yield whole()
                        rows, found, first = [], [], i
                        number.clear()
                    at = before // self.stretch
                    words = split(t.decode("utf-8", "replace"))
                    found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                    before += len(t)
                rows.append(piece.slice(first).drop_columns(["text"]))
        if rows:
            yield whole()

    def words(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(stretch, number, word) of each stretch's distinct words."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, _, _, words in self._stretches(batches):
                for a in range(0, len(words), 50_000):
                    some = words[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), key)), pa.array(np.arange(a, a + len(some), dtype=np.int32)), pa.array(some, pa.string())], ["stretch", "number", "word"])

        return docs.select(F.col(f"`{text}`").alias("text"), F.spark_partition_id().alias("part")).mapInArrow(tidy(run), "stretch long, number int, word string")

    def encoded_words(self, words: DataFrame) -> DataFrame:
        """(stretch, numbers, sizes, word_ids): equal words meet, and the library encodes each distinct one once.

        A row has some words of a stretch, their numbers in the stretch, how many ids each has, and these.
        """
        spec = self.spec

        def together(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            stretch, number, size, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((number, stretch))
            flat = _gathered(order, flat, np.concatenate([[0], np.cumsum(size)]))
            stretch, number, size = stretch[order], number[order], size[order]
            edges = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), len(stretch)]
            ends = np.concatenate([[0], np.cumsum(size)])
            pairs = list(zip(edges[:-1], edges[1:], strict=True))
            parts = [[_packed(np.diff(number[a:b], prepend=0)) for a, b in pairs], [_packed(size[a:b]) for a, b in pairs], [_packed(flat[ends[a] : ends[b]]) for a, b in pairs]]
            yield pa.RecordBatch.from_arrays([pa.array(stretch[edges[:-1]]), *(pa.array(x, pa.binary()) for x in parts)], ["stretch", "numbers", "sizes", "word_ids"])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode, last, held, many = _tokenizer(spec.value[0]).encode_batch, (None, []), [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                coded = batch["word"].dictionary_encode()
                some = coded.dictionary.to_pylist()
                new = some[1:] if some[0] == last[0] else some  # a word that goes on from the batch before
                ids = [e.ids for e in encode(new, add_special_tokens=False)]
                ids = [last[1], *ids] if len(new) < len(some) else ids
                last = some[-1], ids[-1]
                size, which = np.array([len(x) for x in ids]), coded.indices.to_numpy()
                flat = _gathered(which, np.array([i for x in ids for i in x], np.int32), np.concatenate([[0], np.cumsum(size)]))
                held.append((batch["stretch"].to_numpy(), batch["number"].to_numpy(), size[which], flat))
                many += batch.num_rows
                if many >= HELD:
                    yield from together(held)
                    held, many = [], 0
            if held:
                yield from together(held)

        return words.repartition("word").sortWithinPartitions("word").mapInArrow(tidy(run), "stretch long, numbers binary, sizes binary, word_ids binary")

    def _sequences(self, docs: DataFrame, text: str, kept: list[str]) -> DataFrame:
        """(stretch, sequence, row) of each document, ``row`` with its further columns."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, rows, found, _ in self._stretches(batches):
                at = 0
                for piece in rows:
                    n = piece.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array([_packed(x) for x in found[at : at + n]], pa.binary()), piece["row"]], ["stretch", "sequence", "row"])
                    at += n

        row = F.struct(F.lit(True).alias(f"{OWN}there"), *(F.col(f"`{c}`") for c in kept)).alias("row")
        df = docs.select(F.col(f"`{text}`").alias("text"), F.spark_partition_id().alias("part"), row)
        return df.mapInArrow(tidy(run), f"stretch long, sequence binary, row {df.schema['row'].dataType.simpleString()}")

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """The columns of ``docs`` but the text, with ``ids`` array<int>."""
        kept = [c for c in docs.columns if c.lower() != text.lower()]
        if ids.lower() in map(str.lower, kept):
            raise ValueError(f"there is a column {ids} already; give another name")
        if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
            docs = cut(docs)
        sequences = self._sequences(docs, text, kept)
        table = self.encoded_words(self.words(docs, text))
        none = [F.lit(None).cast("binary").alias(c) for c in ("numbers", "sizes", "word_ids")]
        both = table.select("*", none[0].alias("sequence"), F.lit(None).cast(sequences.schema["row"].dataType).alias("row"))
        both = both.union(sequences.select("stretch", *none, "sequence", "row"))
        both = both.repartition("stretch").sortWithinPartitions("stretch", F.col("numbers").isNull())

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []
            flat, ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
            for batch in batches:
                stretch = batch["stretch"].to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), len(stretch)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a == b:
                        continue
                    part = batch.slice(a, b - a)
                    if stretch[a] != key:
                        if held:
                            raise _differ()
                        key, flat, ends = stretch[a], flat[:0], ends[:1]
                    n = part.num_rows - part["numbers"].null_count  # rows of words come first
                    held += [tuple(map(_unpacked, x)) for x in zip(*(part[c].slice(0, n).to_pylist() for c in ("numbers", "sizes", "word_ids")), strict=True)]
                    if n == part.num_rows:
                        continue
                    if held:
                        flat, ends = _table(held)
                        held = []
                    rest = part.slice(n)
                    found = [_unpacked(x) for x in rest["sequence"].to_pylist()]
                    if max((int(x.max(initial=-1)) for x in found), default=-1) >= len(ends) - 1:
                        raise _differ()
                    yield pa.RecordBatch.from_arrays([*rest["row"].flatten()[1:], lists([_gathered(x, flat, ends) for x in found], pa.int32())], [*kept, ids])
            if held:
                raise _differ()

        schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"`{ids}` array<int>"])
        return both.mapInArrow(tidy(run), schema)

    def decode(self, df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """Add ``decoded`` string, the ids' pieces with blanks between them; a column of that name is an error."""
        if decoded.lower() in map(str.lower, df.columns):
            raise ValueError(f"there is a column {decoded} already; give another name")
        table = self.pieces

        def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, ends = slices(batch[ids])
            flat = np.where(np.isnan(flat), -1, flat).astype(np.int64) if flat.dtype.kind == "f" else flat.astype(np.int64)
            known = pa.array(table.value, pa.string())
            there = (flat >= 0) & (flat < len(known))
            joined = known.take(pa.array(np.where(there, flat, 0), mask=~there))
            rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), joined)
            return with_columns(batch, **{decoded: pc.binary_join(_without_nulls(rows) if joined.null_count else rows, " ")})

        kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{decoded}` string"])
        return map_arrow(df, per_batch, kinds)


def _without_nulls(rows: pa.ListArray) -> pa.ListArray:
    """Lists without their null elements."""
    keep = rows.values.is_valid().to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(keep)])
    return pa.ListArray.from_arrays(pa.array(before[rows.offsets.to_numpy()], pa.int32()), rows.values.drop_null())
