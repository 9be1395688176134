"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import math
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of columns that operators add for their own use.
OWN = "__corvane_"

#: Bytes of words in lower case, all others as blanks: words of letters and digits, and words between blanks.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
SPACE = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is empty and the master is local (tests, a laptop) a folder
    is made here; a cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corvane-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def space_words(text: bytes) -> list[bytes]:
    """Words between blanks (x20, x09 to x0D), A-Z in lower case."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters, A-Z in lower case."""
    return text.translate(ALNUM).split()


#: Fixed odd multipliers, one for each place in a shingle.
_PLACE = np.array(
    [
        0x9E3779B97F4A7C15,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0xD6E8FEB86659FD93,
        0xA0761D6478BD642F,
        0xE7037ED1A0B428DB,
        0x8EBC6AF09C88C6E3,
        0x589965CC75374CC3,
    ],
    np.uint64,
)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes that are hashed at once.
_BLOCK = 1 << 16
_BASE = 0x5851F42D4C957F2D


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    base, back = (np.full(_BLOCK, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    base[0] = back[0] = 1
    return np.cumprod(base), np.cumprod(back)


def hashed_words(some: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and where each text begins and ends.

    ``table`` gives each byte its lower case, or a blank where it is part of no word. A
    word's hash is a polynomial in its bytes' random values, from sums that run over all
    bytes, so no word becomes a Python object.
    """
    low = np.frombuffer(table, np.uint8)
    inside = low != 32
    value = np.where(inside, mix(low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), np.uint64(0))
    powers, back = _powers()
    data = np.frombuffer(b" ".join([*some, b""]), np.uint8)
    found, was, carried = [], np.zeros(1, np.int8), np.zeros(1, np.uint64)
    for at in range(0, len(data), _BLOCK):
        b = data[at : at + _BLOCK]
        scale, unscale = (np.uint64(pow(x, at, 1 << 64)) for x in (_BASE, int(back[1])))
        w = inside[b].view(np.int8)
        edge = np.flatnonzero(np.diff(w, prepend=was))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value[b] * powers[: len(b)])])
        found.append((edge + at, carried + scale * sums[edge], unscale * back[edge]))
        was, carried = w[-1:], carried + scale * sums[-1:]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(some) + 1, np.int64)
    edge, sums, back = (np.concatenate(x) for x in zip(*found, strict=True))
    start = edge[::2]  # a blank follows the last text, so each word has an end
    h = mix((sums[1::2] - sums[::2]) * back[::2] + (edge[1::2] - start).astype(np.uint64) * _PLACE[0])
    return h, np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in some)]))


def _joined(words: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out += words[i : len(words) - k + 1 + i] * (_PLACE[i % 8] + np.uint64(2 * (i // 8)))
    return mix(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of ``k`` words; of the whole sequence if it is shorter."""
    return _joined(words, min(k, len(words))) if len(words) else words


def all_shingles(words: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of each text of ``hashed_words``, and where each text's ones begin and end."""
    n = np.diff(ends)
    count = np.where(n >= k, n - k + 1, n > 0)
    new = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(new[-1]) - np.repeat(new[:-1] - ends[:-1], count)
    if len(words) < k:
        out = np.zeros(len(at), np.uint64)
    else:
        out = _joined(words, k)
        out = out[np.minimum(at, len(out) - 1)]
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        out[new[i]] = shingles(words[ends[i] : ends[i + 1]], k)[0]
    return out, new


def distinct_in(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values once, sorted, and the new ends."""
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[ends[:-1][ends[:-1] < len(values)]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[ends]


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, size: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of about ``size`` bytes of text, so that arrays over their bytes stay small."""
    lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            yield (some := batch.slice(a, b - a)), texts(some[column])


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy arrays."""
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and the bounds of an Arrow list column without null elements."""
    column = column.fill_null([]) if column.null_count else column
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with the memory that it freed given back to the system at the end of the task.

    Python workers are used again by later tasks of any stage; what their allocators keep would stay theirs.
    """

    @functools.wraps(run)
    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def map_arrow(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch, narrow: nothing is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield per_batch(b)

    return df.mapInArrow(tidy(run), schema)


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def block_sums(df: DataFrame, size: int, count: Callable[[Iterable[pa.RecordBatch]], np.ndarray], block: int = 1 << 16) -> np.ndarray:
    """Add up one array of ``size`` counters over all rows.

    ``count`` returns the counters of one task. They are exchanged in blocks, each
    added up by one task as they stream in, so memory is bounded by ``size``.
    """
    import zlib

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = count(batches)
        at = [i for i in range(0, size, block) if own[i : i + block].any()]
        for i in at:
            yield pa.RecordBatch.from_arrays([pa.array([i // block], pa.int32()), pa.array([zlib.compress(own[i : i + block].astype(np.int64).tobytes(), 1)], pa.binary())], ["block", "counts"])

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b["block"].to_pylist(), b["counts"].to_pylist(), strict=True):
                more = np.frombuffer(zlib.decompress(c), np.int64)
                sums[i] = sums[i] + more if i in sums else more
        for i, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1)], pa.binary())], ["block", "counts"])

    kind = "block int, counts binary"
    n = max(1, min(64, -(-size // block)))
    rows = df.mapInArrow(tidy(partial), kind).repartition(n, "block").mapInArrow(tidy(total), kind).collect()
    out = np.zeros(size, np.int64)
    for i, c in rows:
        part = np.frombuffer(zlib.decompress(bytes(c)), np.int64)
        out[i * block : i * block + len(part)] = part
    return out


def bits_for(count: int, most: int = 26) -> int:
    """Bits of a bitmap for so many keys: 256 places for each, 8 MB at most."""
    return min(most, max(16, math.ceil(math.log2(256 * max(1, count)))))


def id_bits(df: DataFrame, key: str, bits: int = 26) -> np.ndarray:
    """A bitmap of 2**bits bits with the bit of each key's hash set.

    Rows whose bit is not set are surely not in ``df``; with very many keys all bits are
    set, and the join behind the bitmap does the work alone.
    """
    h = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    rows = df.select(h.alias("h")).groupBy(F.bitmap_bucket_number(F.col("h") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("h") + 1)).alias("m")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for b, m in rows:
        at = (b - 1) * 4096  # bucket b has the bits of 32768 * (b - 1) + 1 and up
        out[at : at + len(m)] |= np.frombuffer(bytes(m), np.uint8)
    return out
