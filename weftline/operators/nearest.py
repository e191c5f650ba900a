"""Nearest-neighbour join of two tables of vectors, block by block.

Both sides are packed: a row holds up to ``BLOCK`` vectors of one length as a matrix. Packing happens where the rows are and
shuffles nothing. Blocks of queries meet blocks of vectors in an equality join on cells of a grid: a query block goes to every
column of the grid, a vector block to every row, so no task needs all of either side. A query side of proven small size is
broadcast instead, and the vectors then stay in place. Where two blocks meet their cosines are one matrix product; a task keeps
the ``k`` best of each query it has seen, so at most tasks * queries * k rows are shuffled to be merged.

Vectors of different length, and those without length, have similarity 0; null vectors are left out. Ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.sizing import stored_and_counted

BLOCK = 2048
#: Query blocks that are broadcast: 32 MB at 64 dimensions of eight bytes.
BROADCAST_BLOCKS = 32

_PACKED = "dim int, n int, ids binary, matrix binary"


def packed(df: DataFrame, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """``(dim, n, ids, matrix)`` rows of up to ``block`` vectors that stand in one batch."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = np.asarray(batch.column(0)), np.asarray(batch.column(1).value_lengths())
            starts = np.cumsum(sizes) - sizes
            values = batch.column(1).flatten().cast(pa.float64()).fill_null(0.0).to_numpy()
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                for a in range(0, len(rows), block):
                    part = rows[a : a + block]
                    matrix = values[starts[part][:, None] + np.arange(dim)]
                    row = [[int(dim)], [len(part)], [ids[part].astype("<i8").tobytes()], [matrix.astype("<f8").tobytes()]]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["dim", "n", "ids", "matrix"])

    rows = df.select(F.col(key).cast("bigint").alias("_key"), F.col(vector).alias("_vector")).filter("_key IS NOT NULL AND _vector IS NOT NULL")
    return rows.mapInArrow(pack, _PACKED)


class _Best:
    """The ``k`` best rows of each query of a block."""

    def __init__(self, queries: int, k: int):
        self.ids, self.scores, self.k = np.empty((queries, 0), np.int64), np.empty((queries, 0)), k

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if scores.shape[1] > 4 * self.k:  # all that can be among the best, ties at the edge included
            floor = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            some = (scores >= floor[:, None]).any(axis=0)
            ids, scores = ids[some], scores[:, some]
        ids = np.concatenate([self.ids, np.broadcast_to(ids, scores.shape)], axis=1)
        scores = np.concatenate([self.scores, scores], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.ids, self.scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] != b.shape[1]:
        return np.zeros((len(a), len(b)))
    size = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
    return np.divide(a @ b.T, size, out=np.zeros(size.shape), where=size > 0)


def _met(k: int, threshold: float | None):
    schema = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("similarity", pa.float64())])

    def result(ids: np.ndarray, best: _Best) -> pa.RecordBatch:
        keep = best.scores.ravel() >= (-np.inf if threshold is None else threshold)
        columns = [np.repeat(ids, best.ids.shape[1])[keep], best.ids.ravel()[keep], best.scores.ravel()[keep]]
        return pa.record_batch([pa.array(c) for c in columns], schema=schema)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray, _Best]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                q_dim, q_n, q_ids, q_matrix, dim, n, ids, matrix = (c[at].as_py() for c in batch.columns)
                if q_ids not in held:
                    if len(held) == BROADCAST_BLOCKS:  # a task's own memory has a bound too
                        first = next(iter(held))
                        yield result(held[first][0], held.pop(first)[2])
                    held[q_ids] = np.frombuffer(q_ids, "<i8"), np.frombuffer(q_matrix, "<f8").reshape(q_n, q_dim), _Best(q_n, k)
                held[q_ids][2].add(np.frombuffer(ids, "<i8"), _cosines(held[q_ids][1], np.frombuffer(matrix, "<f8").reshape(n, dim)))
        for ids, _, best in held.values():
            yield result(ids, best)

    return met


def nearest(queries: DataFrame, query_key: str, query_vector: str, base: DataFrame, key: str, vector: str, k: int, threshold: float | None = None, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """``(query_id, <key>, similarity, rank)``: the ``k`` most similar rows of ``base`` for every row of ``queries``.

    ``query_key`` is unique; ``base`` may repeat keys. With ``threshold`` only rows at least so similar are taken.
    """
    asked, blocks = stored_and_counted(packed(queries, query_key, query_vector).select(*(F.col(c).alias(f"q_{c}") for c in ("dim", "n", "ids", "matrix"))), "query-blocks")
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64("q_ids"), F.lit(max(blocks, 1))).cast("int"))
    rows = packed(base, key, vector)
    if blocks <= broadcast_blocks:
        met = rows.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1)))).join(F.broadcast(asked), "q_block")
    else:
        columns = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        asked = asked.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
        rows = rows.withColumn("column", F.pmod(F.xxhash64("ids"), F.lit(columns)).cast("int")).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = rows.join(asked, ["q_block", "column"])
    found = met.select("q_dim", "q_n", "q_ids", "q_matrix", "dim", "n", "ids", "matrix").mapInArrow(_met(k, threshold), "query_id bigint, key bigint, similarity double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("key", key)
