"""Near duplicates by the Jaccard similarity of word shingles, exact: every pair at or over the limit is linked, none below it.

Two sets with similarity ``s`` or more share one of the first ``n - ceil(s * n) + 1`` of their shingles in any order that all texts
keep to. The order here puts shingles that no other text holds first and very common ones last, both by a sketch whose errors
change the work and not the result. Texts send only what others may hold, so most send nothing.

Equal sets are collapsed first. Texts that share a key are paired, by all pairs of fitting sizes in a bucket of ``PAIRWISE`` or
fewer, else each with the smallest text of its range of sizes. Pairs are compared by their whole sets. What a large bucket has
left in several components is then paired across these, so nothing is missed and a group of near copies costs a row a copy.

Shingles and sets of them are held equal by 64-bit hashes. Defined cases: texts with fewer words than a shingle are one shingle;
those without a word are equal to each other; every input row gets one result row; ``component_id`` ignores null doc_ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import words as W
from weftline.llm.simhash import components
from weftline.llm.sketch import repeated
from weftline.session import cut_lineage

PAIRWISE = 48
LOG2_CELLS = 20, 27
BYTES_PER_CELL = 4
PAIRS_AT_ONCE = 1 << 18
ROWS_AT_ONCE = 1 << 15
#: Rows that carry texts or whole sets go to Python so many at a time.
BATCH_ROWS = 1000


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """For the jobs run within it; the session's own setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS if int(own) <= 0 else min(BATCH_ROWS, int(own))))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def _least(similarity: float, n: np.ndarray) -> np.ndarray:
    """The fewest of ``n`` that are ``similarity`` of them."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def _sets(column: pa.Array, size: int):
    """Number of rows, row and hash of every distinct shingle of each row (rows in order, hashes ascending), piece by piece."""
    for a, b, data, starts in W.chunks(column):
        data = W.lowered(data)
        begin, end, before = W.spans(data, starts)
        hashes, n = W.word_hash(data, begin, end), np.diff(before)
        rows, shingles = [], []
        for k in sorted({size, *np.unique(n[(n > 0) & (n < size)]).tolist()}):
            index, h = W.windows(hashes, before, k) if len(hashes) >= k else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            row = np.searchsorted(before, index, "right") - 1
            own = n[row] >= size if k == size else n[row] == k
            rows.append(row[own])
            shingles.append(h[own])
        row, h = np.concatenate(rows), np.concatenate(shingles)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        fresh = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])][: len(row)]
        yield b - a, row[fresh], h[fresh]


_TEXT = {"doc_id": pa.int64(), "row": pa.int64(), "node": pa.int64(), "n": pa.int64(), "keys": pa.list_(pa.int64()), "shingles": pa.binary()}
_TEXT_SQL = "doc_id long, row long, node long, n long, keys array<bigint>, shingles binary"


def _keyed(size: int, similarity: float, seen):
    def keyed(batches):
        for batch in batches:
            at = 0
            for rows, row, h in _sets(batch.column(0), size):
                n = np.bincount(row, minlength=rows)
                first = np.cumsum(n) - n
                node = np.zeros(rows, np.uint64)
                np.add.at(node, row, W.mixed(h ^ np.uint64(0x2545F4914F6CDD1D)))
                rank = seen.value(h).astype(np.int8)
                rank += rank & seen.value.hot(h)
                order = np.lexsort((h, rank, row))
                place = np.arange(len(h)) - first[row]
                keys = order[(place < (n - _least(similarity, n) + 1)[row]) & (rank[order] > 0)]
                sent = np.bincount(row[keys], minlength=rows)
                offsets = np.r_[0, np.cumsum(sent)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(at, rows), batch.column(2).slice(at, rows), pa.array(node.view(np.int64)), pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[keys].view(np.int64))),
                    pa.array([h[first[k] : first[k] + n[k]].tobytes() if sent[k] else None for k in range(rows)], pa.binary()),
                ], names=list(_TEXT))
                at += rows
        W.free_memory()

    return keyed


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    run = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return run, np.diff(np.r_[run, len(key)])


def _by_key(pairs_of):
    """``pairs_of(columns)`` of whole buckets, from rows sorted by their first column."""

    def paired(batches):
        def found(rows):
            for a, b in pairs_of(rows):
                a, b = np.minimum(a, b), np.maximum(a, b)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a[fresh]), pa.array(b[fresh])], names=["a", "b"])

        held, n, left = [], 0, 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            n += batch.num_rows
            if n >= max(ROWS_AT_ONCE, 2 * left):
                rows = np.concatenate(held, axis=1)
                stop = int(np.flatnonzero(rows[0] != rows[0, -1]).max(initial=-1)) + 1  # the last bucket may go on
                left = rows.shape[1] - stop
                held, n = [rows[:, stop:].copy()], left
                if stop:
                    yield from found(rows[:, :stop])
        if n:
            yield from found(np.concatenate(held, axis=1))
        W.free_memory()

    return paired


def _first_pairs(similarity: float):
    """Of rows ``key, n, node`` in that order."""

    def pairs(rows):
        key, n, node = rows
        run, size = _runs(key)
        of = np.repeat(np.where(size > PAIRWISE, -1, np.arange(len(size))), size)
        a, b = [], []
        for shift in range(1, int(size[size <= PAIRWISE].max(initial=1))):
            at = np.flatnonzero((of[shift:] == of[:-shift]) & (of[shift:] >= 0))
            at = at[n[at] >= _least(similarity, n[at + shift])]
            a.append(node[at])
            b.append(node[at + shift])
        for k in np.flatnonzero(size > PAIRWISE):
            start, stop = run[k], run[k] + size[k]
            most = _least(similarity, n[start:stop])
            while start < stop:
                last = stop - len(most) + int(np.searchsorted(most, n[start], "right"))
                a.append(np.full(last - start - 1, node[start]))
                b.append(node[start + 1 : last])
                most, start = most[last - start :], last
        if a:
            yield np.concatenate(a), np.concatenate(b)

    return pairs


def _further_pairs(similarity: float):
    """Of rows ``key, root, n, node`` in that order: what fits in size and lies in different components."""

    def pairs(rows):
        key, root, n, node = rows
        for start, size in zip(*_runs(key)):
            parts = [slice(start + x, start + x + y) for x, y in zip(*_runs(root[start : start + size]))]
            parts.sort(key=lambda p: p.start - p.stop)
            for i in range(1, len(parts)):
                for one in range(parts[i].start, parts[i].stop):
                    fits = [np.flatnonzero((np.minimum(n[p], n[one]) >= _least(similarity, np.maximum(n[p], n[one])))) + p.start for p in parts[:i]]
                    other = node[np.concatenate(fits)]
                    for x in range(0, len(other), PAIRS_AT_ONCE):
                        yield np.full(len(other[x : x + PAIRS_AT_ONCE]), node[one]), other[x : x + PAIRS_AT_ONCE]

    return pairs


def _compared(similarity: float):
    def compare(batches):
        for batch in batches:
            own = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                own.append(same >= _least(similarity, np.int64(len(x) + len(y) - same)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(own, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])
        W.free_memory()

    return compare


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar."""
    one, other = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"_{x}")) for x in "ab")
    both = pairs.distinct().join(one, "a").join(other, "b").select("a", "b", "_a", "_b")
    with _small_batches(sets.sparkSession):
        return cut_lineage(both.mapInArrow(_compared(similarity), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, log2_cells: int | None = None) -> DataFrame:
    """``doc_id`` and ``component_id`` (least doc_id reachable over links) of every row of ``docs``, then ``row`` (the column of that
    name, if there is one) and ``root`` (the component's own number, also where two have the same least doc_id).

    The sketch has ``2**log2_cells`` cells; by itself it grows with the input, up to a fixed size.
    """
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), (F.col("row").cast("long") if "row" in docs.columns else F.lit(0).cast("long")).alias("row"))

    if log2_cells is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        log2_cells = min(max(LOG2_CELLS[0], (size // BYTES_PER_CELL).bit_length()), LOG2_CELLS[1])

    def shingles(batches):
        for batch in batches:
            for _, _, h in _sets(batch.column(0), shingle):
                yield h

    with _small_batches(docs.sparkSession):
        seen, _ = repeated(rows, shingles, log2_cells, depth=1, most=1 << 20, keep_hot=True)
        texts = cut_lineage(rows.mapInArrow(_keyed(shingle, similarity, seen), _TEXT_SQL), "shingles")
    seen.destroy()
    sets = cut_lineage(texts.filter("size(keys) > 0").dropDuplicates(["node"]).select("node", "n", "keys", "shingles"), "sets")
    keys = sets.select(F.explode("keys").alias("key"), "n", "node")
    found = keys.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_by_key(_first_pairs(similarity)), "a long, b long")
    links = _links(found, sets, similarity)
    roots = components(links)
    large = keys.groupBy("key").count().filter(F.col("count") > PAIRWISE).select("key")
    left = keys.join(large, "key").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"), "n", "node")
    open_ = left.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    left = left.join(open_, "key").select("key", "root", "n", "node").repartition("key").sortWithinPartitions("key", "root", "n", "node")
    more = _links(left.mapInArrow(_by_key(_further_pairs(similarity)), "a long, b long"), sets, similarity)
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    of = texts.select("doc_id", "row", "node").join(roots, "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("root"))
    of = cut_lineage(of, "roots")
    return of.join(of.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id", "row", "root")
