"""A count-min sketch over the hashes of a whole corpus, of which "seen at least twice" and "seen very often" are kept.

Each task sketches its own part and sends the cells it touched, by block of cells, as sorted differences. Each block is
merged by itself: counters are added and saturate. What comes back is one bit per cell and question, so its size is fixed by
``log2_cells`` and ``depth`` and not by the data; it is then broadcast. A hash that occurs twice or more has all its cells at
two, so it is never missed. A lone hash may be taken for a repeated one; the callers group exactly what passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import each, mixed

BLOCK_LOG2 = 22


def cells(hashes: np.ndarray, row: int, log2_cells: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & (1 << 64) - 1)) >> np.uint64(64 - log2_cells)).astype(np.int64)


def packed(sorted_values: np.ndarray) -> bytes:
    return pa.compress(np.diff(sorted_values, prepend=0).astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(blob, n * 4, codec="zstd", asbytes=True), np.uint32), dtype=np.int64)


class Repeated:
    """Answers which hashes may occur twice or more, and which may be hot."""

    def __init__(self, rows: list[np.ndarray], hot: list[np.ndarray], log2_cells: int):
        self.rows, self.hot_rows, self.log2_cells = rows, hot, log2_cells

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self._all(self.rows, hashes)

    def hot(self, hashes: np.ndarray) -> np.ndarray:
        return self._all(self.hot_rows, hashes)

    def _all(self, rows: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for k, bits in enumerate(rows):
            c = cells(hashes, k, self.log2_cells)
            found &= (bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
        return found


class Shared:
    """A broadcast ``Repeated``. Only its arrays are broadcast: a class of this package could not be read where it is not installed."""

    def __init__(self, spark, *parts):
        self.parts = spark.sparkContext.broadcast(parts)

    @property
    def value(self) -> Repeated:
        return Repeated(*self.parts.value)

    def destroy(self) -> None:
        self.parts.destroy()


#: A task counts a hash this often at most, so a hot one is one that many tasks hold.
TASK_MOST = 16
HOT = 240
SKETCH_SCHEMA = "block int, n int, cells binary, more binary, total long"


def _sketched(parts: Iterator[np.ndarray], log2_cells: int, depth: int, most: int) -> Iterator[pa.RecordBatch]:
    """``parts``: hashes with repeats. A task sends what it has gathered whenever that reaches ``most`` hashes."""

    def sent(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        everything = np.concatenate(gathered)
        rows = []
        for k in range(depth):
            c = np.sort(cells(everything, k, log2_cells))
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            more = np.minimum(np.diff(np.r_[first, len(c)]), TASK_MOST) - 1
            mine = c[first]
            edges = np.searchsorted(mine, np.arange(0, (1 << max(0, log2_cells - BLOCK_LOG2)) + 1) << BLOCK_LOG2)
            for b in np.flatnonzero(np.diff(edges)):
                part = slice(edges[b], edges[b + 1])
                rows.append((
                    k << 16 | int(b), int(edges[b + 1] - edges[b]), packed(mine[part] - (int(b) << BLOCK_LOG2)),
                    pa.compress(more[part].astype(np.uint8).tobytes(), codec="zstd", asbytes=True), len(everything) if not rows else 0,
                ))
        cols = list(zip(*rows))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["block", "n", "cells", "more", "total"])

    gathered, n = [], 0
    for part in parts:
        gathered.append(part)
        n += len(part)
        if n >= most:
            yield from sent(gathered)
            gathered, n = [], 0
    if n:
        yield from sent(gathered)


def _merged(log2_cells: int):
    size = 1 << min(log2_cells, BLOCK_LOG2)

    def merge(batches):
        block, counts, total = None, None, 0

        def done():
            bits = b"".join(np.packbits(counts >= least, bitorder="little").tobytes() for least in (2, HOT))
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([pa.compress(bits, codec="zstd", asbytes=True)], pa.binary()), pa.array([total], pa.int64())], names=["block", "bits", "total"]
            )

        for batch in batches:
            for b, n, blob, more, t in each(batch):
                if b != block:
                    if block is not None:
                        yield done()
                    block, counts, total = b, np.zeros(size, np.uint8), 0
                at = unpacked(blob, n)
                more = np.frombuffer(pa.decompress(more, n, codec="zstd", asbytes=True), np.uint8)
                counts[at] = np.minimum(counts[at], 255 - TASK_MOST) + more + 1
                total += t
        if block is not None:
            yield done()

    return merge


def repeated(docs: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], log2_cells: int, depth: int = 2, most: int = 1 << 21, keep_hot: bool = False):
    """Sketch ``hashes`` of the batches of ``docs``. Returns a broadcast ``Repeated`` and the number of hashes."""

    def sketch(batches):
        return _sketched(hashes(batches), log2_cells, depth, most)

    merge = _merged(log2_cells)
    merged = docs.mapInArrow(sketch, SKETCH_SCHEMA).repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary, total long")
    rows, hot = ([np.zeros((1 << log2_cells) // 8, np.uint8) for _ in range(k)] for k in (depth, depth * keep_hot))
    total, step = 0, (1 << min(log2_cells, BLOCK_LOG2)) // 8
    for r in merged.collect():  # 2 * depth * 2**log2_cells bits at most, whatever the input
        bits = np.frombuffer(pa.decompress(bytes(r.bits), 2 * step, codec="zstd", asbytes=True), np.uint8)
        at = slice((r.block & 0xFFFF) * step, (r.block & 0xFFFF) * step + step)
        rows[r.block >> 16][at] = bits[:step]
        if keep_hot:
            hot[r.block >> 16][at] = bits[step:]
        total += r.total
    return Shared(docs.sparkSession, rows, hot, log2_cells), total
