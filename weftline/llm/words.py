"""Whole texts as UTF-8 bytes in numpy: word spans and hashes for a batch at a time.

Words are runs of bytes other than 0x20 and 0x09-0x0D. All of these are ASCII, so byte positions are exact in UTF-8.
Batches are cut into chunks of about ``CHUNK`` bytes, so memory follows the chunk and the longest single text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20
NULL_ID = -(1 << 63)

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """``_id`` (doc_id; the least long for null), ``_th`` (hash of the text) and ``_text`` (null: empty), then ``more``.

    Rows equal in ``_id`` and ``_th`` are the same document listed more than once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"), *more
    )


def null_id(column: str | Column) -> Column:
    """The doc_id behind ``_id``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != NULL_ID, column)


def free_memory() -> None:
    """Gives the worker's unused memory back: the next step may run in a worker of another kind beside it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        return


def each(batch: pa.RecordBatch, step: int = 32) -> Iterator[tuple]:
    """The rows of a batch as tuples, some at a time: rows of compressed columns are large."""
    for a in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(a, step).columns))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and where each row starts (one more for the end). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[starts[0] : starts[-1]], starts - starts[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row behind the last, bytes and row starts of pieces of at most ``limit`` bytes, or of one longer row."""
    data, starts = utf8(column)
    a, n = 0, len(starts) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        a = b


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the number of words before each row (one more for the end)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(starts), np.int64)
    word = _IS_WORD[data]
    cut = starts[(starts > 0) & (starts < n)]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.logical_not(word[:-1], out=fresh[1:])
    fresh[cut] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(word[1:], out=last[:-1])
    last[cut - 1] = True
    begin, end = np.flatnonzero(word & fresh), np.flatnonzero(word & last) + 1
    return begin, end, np.searchsorted(begin, starts)


def _powers(name: str, n: int) -> np.ndarray:
    if name not in _POWERS or len(_POWERS[name]) < n:
        step = _BASE if name == "up" else _INVERSE
        table = np.full(max(n, CHUNK + 1), step, np.uint64)
        table[0] = 1
        _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS[name][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Of byte times power, modulo 2**64; ``span_hash`` takes differences of them."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", len(data)), out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, the same wherever they stand. For spans of a few hundred bytes: sums modulo
    ``2**64`` cannot tell some pairs of periodic strings of 1,024 bytes and more apart, whatever the base."""
    return mixed((sums[end] - sums[begin]) * _powers("down", len(sums))[begin])


#: Words of more bytes are hashed by XXH64.
SHORT = 256


def word_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each word, of any length."""
    out = span_hash(prefix_sums(data) if sums is None else sums, begin, end)
    for k in np.flatnonzero(end - begin > SHORT):
        out[k] = xxhash.xxh64_intdigest(data[begin[k] : end[k]].tobytes(), 0x9E3779B97F4A7C15)
    return out


def windows(hashes: np.ndarray, before: np.ndarray, size: int, seed: int = 0x2545F4914F6CDD1D) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every window of ``size`` words within one row, and the window's hash."""
    count = np.maximum(np.diff(before) - size + 1, 0)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    index = np.arange(total) + np.repeat(before[:-1] - (np.cumsum(count) - count), count)
    factor, out = np.uint64(seed | 1), np.zeros(len(hashes) - size + 1, np.uint64)
    for j in range(size):
        out *= factor
        out += hashes[j : j + len(out)]
    return index, mixed(out[index])


def joined(data: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each row joined by one space, and where each word starts in that (one more for the end).

    ``doc`` is the row of each word; rows follow each other without a space between.
    """
    inner = np.r_[doc[1:] == doc[:-1], False] if len(doc) else np.zeros(0, bool)
    length = end - begin + inner
    at = np.cumsum(np.r_[0, length])
    out = data[np.arange(at[-1]) + np.repeat(begin - at[:-1], length)] if len(begin) else np.zeros(0, np.uint8)
    out[at[1:][inner] - 1] = 0x20
    return out, at
