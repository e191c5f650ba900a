"""Mixture-controlled packing of token ids into sequences.

Every source is a queue of token ids, served by deficit round-robin: each queue's share of a sequence is added to its deficit,
whole tokens are taken, and the fraction is carried on. ``Mixture`` has the closed form of carrying deficits from the very
first token: of the first ``n`` tokens of all, the queues after ``j`` have left to the first ``j`` the rounded-down share of what
the first ``j + 1`` got. Each share only ever grows, so any partition works out its own windows exactly without knowing the
others', and a queue stays within a few tokens of its target at every point. Where a queue runs dry a new phase starts with the
weights of those that remain; there are at most as many phases as queues.

Steps: texts are tokenized once and stored with each row's place in its task's queues; the totals of (task, source) give each
row's place in the whole queue; rows are then cut where sequences end. Nothing is grouped by source or document, so a source
with a third of all tokens is spread like any other. The driver holds one total per source.

Defined cases: a null text is empty and gives the end id alone; a null source is a queue of its own; repeated rows are packed
each; only the last sequence may be short. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.registry import llm_query
from weftline.llm.tokens import TOKENIZER, encoder, id_blobs
from weftline.session import scratch_path, small_batches
from weftline.sources.tables import table

LENGTH = 2048
END_ID = 1
BROADCAST_ROWS = 200_000


def _tokenized(path: str, end_id: int):
    def tokenize(batches):
        from pyspark import TaskContext

        part, filled, own = TaskContext.get().partitionId(), {}, encoder(path)
        for batch in batches:
            for a, b, ids, at in own.encode_column(batch.column(2), end_id):
                n, before = np.diff(at), np.empty(b - a, np.int64)
                named = batch.column(1).slice(a, b - a).dictionary_encode()
                code = named.indices.fill_null(-1).to_numpy()
                for k in np.unique(code).tolist():
                    rows, source = np.flatnonzero(code == k), named.dictionary[k].as_py() if k >= 0 else None
                    sums = np.cumsum(n[rows]) + filled.get(source, 0)
                    before[rows], filled[source] = sums - n[rows], int(sums[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(before), pa.array(n), id_blobs(ids, at)],
                    names=["doc_id", "source", "part", "before", "n", "ids"],
                )

    return tokenize


class Mixture:
    """How many of the first ``n`` tokens come from each queue, for queues of ``totals`` tokens and target ``weights``."""

    def __init__(self, totals: list[int], weights: list[int], length: int):
        self.totals, self.length, self.total = totals, length, sum(totals)
        self.phases: list[tuple[int, list[int], list[int]]] = []
        given, n = [0] * len(totals), 0
        while n < self.total:
            left = [t - g for t, g in zip(totals, given)]
            share = [w if x else 0 for w, x in zip(weights, left)]
            if not any(share):  # queues without a weight come last, by what they hold
                share = left
            self.phases.append((n, given, share))
            low, high = 1, sum(left)
            while low < high:
                mid = (low + high + 1) // 2
                if all(a <= b for a, b in zip(self._split(share, mid), left)):
                    low = mid
                else:
                    high = mid - 1
            given, n = [g + s for g, s in zip(given, self._split(share, low))], n + low
        self.starts = [p[0] for p in self.phases]
        self._edges: dict[int, tuple[list[int], list[int]]] = {}

    @staticmethod
    def _split(share: list[int], n: int) -> list[int]:
        sums, out = list(accumulate(share)), [0] * len(share)
        for j in range(len(share) - 1, 0, -1):
            less = n * sums[j - 1] // sums[j] if sums[j] else n
            out[j], n = n - less, less
        if share:
            out[0] = n
        return out

    def edges(self, window: int) -> tuple[list[int], list[int]]:
        """Tokens of each queue ahead of that window, and of all queues before each."""
        found = self._edges.get(window)
        if found is None:
            if len(self._edges) > 4096:
                self._edges.clear()
            n = min(window * self.length, self.total)
            start, given, share = self.phases[max(0, bisect_right(self.starts, n) - 1)]
            own = [g + s for g, s in zip(given, self._split(share, n - start))]
            found = self._edges[window] = own, list(accumulate(own, initial=0))
        return found

    def given(self, window: int) -> list[int]:
        return self.edges(window)[0]

    def window_of(self, queue: int, token: int) -> int:
        low, high = 0, self.total // self.length
        while low < high:
            mid = (low + high + 1) // 2
            if self.given(mid)[queue] <= token:
                low = mid
            else:
                high = mid - 1
        return low


def _cut(mixture: Mixture, queues: dict, with_ids: bool):
    kinds = [pa.int64()] * 4 + [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"]

    def cut(batches):
        at: dict[int, int] = {}
        for batch in batches:
            rows, size = [], 0
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for (doc, source, begin, n), blob in zip(zip(*columns), batch.column(4)):
                ids, queue, start = blob.as_py(), queues[source], 0
                w = at.get(queue, -1)
                if w < 0 or not mixture.given(w)[queue] <= begin < mixture.given(w + 1)[queue]:
                    w = mixture.window_of(queue, begin)
                low, before = mixture.edges(w)
                while start < n:
                    high, behind = mixture.edges(w + 1)
                    length = min(n - start, high[queue] - begin - start)
                    if length > 0:
                        piece = ids[4 * start : 4 * (start + length)]
                        offset = behind[queue] - before[queue] + begin + start - low[queue]
                        rows.append((doc, start, length, zlib.crc32(piece), n, w, offset, source, piece if with_ids else None))
                        start, size = start + length, size + len(piece)
                    if start < n:
                        w, low, before = w + 1, high, behind
                at[queue] = w
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return cut


def packed(docs: DataFrame, weights: dict | None = None, length: int = LENGTH, end_id: int = END_ID, tokenizer: str = TOKENIZER, with_ids: bool = True) -> DataFrame:
    """Pieces of the rows of ``docs``: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids``.

    ``weights``: whole-number target weight of each source; none: by the tokens each source has, so all end together. ``ids``
    are little-endian unsigned 32-bit integers (null without ``with_ids``). Pieces of a sequence follow each other from offset 0 without a gap.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    path = scratch_path(spark, "tokens")
    stored = rows.mapInArrow(_tokenized(tokenizer, end_id), "doc_id long, source string, part int, before long, n long, ids binary")
    with small_batches(spark):
        stored.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(stored.schema).parquet(path)
    held = stored.groupBy("part", "source").agg(F.sum("n").alias("held"))
    places = held.withColumn("ahead", F.sum("held").over(Window.partitionBy("source").orderBy("part")) - F.col("held")).select("part", "source", "ahead", "held")
    path = scratch_path(spark, "places")
    places.write.parquet(path)
    places = spark.read.schema(places.schema).parquet(path)
    totals = {r.source: r.n for r in places.groupBy("source").agg(F.sum("held").alias("n")).collect()}
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    mixture = Mixture([totals[s] for s in names], [totals[s] if weights is None else int(weights.get(s, 0)) for s in names], length)
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    at = stored.alias("t").join(places.alias("p"), F.col("t.part").eqNullSafe(F.col("p.part")) & F.col("t.source").eqNullSafe(F.col("p.source")))
    at = at.select("doc_id", "t.source", (F.col("before") + F.col("ahead")).alias("begin"), "n", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary"
    return at.mapInArrow(_cut(mixture, {s: k for k, s in enumerate(names)}, with_ids), schema)


@llm_query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")
