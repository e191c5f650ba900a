"""Removing repeated word windows: a count-min prefilter, then exact grouping of what it lets through.

1. Every task sketches the hashes of its windows; the merged sketch overestimates counts (``sketch.py``).
2. Windows estimated as repeated are grouped exactly by a 96-bit hash. A task first settles what it can see alone: of the
   windows it holds with one hash, only those of its smallest document travel, so a window shared by a third of all documents
   costs one row per task and not one per document.
3. The positions found are joined to the documents, and the covered words are left out.

Defined cases: a null text is empty; a null doc_id counts as smaller than any other; rows equal in doc_id and text are one
document listed twice and get the same result; documents of one doc_id and different texts never remove each other's
windows; texts shorter than a window keep all their words. Other columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import words as W
from weftline.llm.registry import llm_query
from weftline.llm.sketch import repeated
from weftline.sources.tables import table

WINDOW = 13
LOG2_CELLS = 28
BUCKET_ROWS = 1 << 21
TASK_ROWS = 1 << 21

_MOVED = "bucket int, settled boolean, n int, hash binary, check binary, doc binary, at binary, ids binary, ths binary"


def _squeezed(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(blob: bytes, n: int, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.frombuffer(pa.decompress(blob, n * dtype.itemsize, codec="zstd", asbytes=True), dtype)


def _chunk_windows(data, starts, window):
    begin, end, before = W.spans(data, starts)
    hashes = W.word_hash(data, begin, end)
    return hashes, before, *W.windows(hashes, before, window)


def window_hashes(window: int):
    def hashes(batches):
        for batch in batches:
            for _, _, data, starts in W.chunks(batch.column(0)):
                yield _chunk_windows(data, starts, window)[3]

    return hashes


def _candidates(window: int, maybe, buckets: int):
    """Windows that may be repeated, settled within the task where it can tell, by bucket of the hash."""
    names = [x.split()[0] for x in _MOVED.split(", ")]
    kinds = [pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 6]

    def settle(parts):
        h, g, doc, at = (np.concatenate(x) for x in zip(*(p[:4] for p in parts)))
        sizes = [len(p[4]) for p in parts]
        doc = doc + np.repeat(np.cumsum([0, *sizes[:-1]]), [len(p[0]) for p in parts])
        ids, ths = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
        order = np.lexsort((ids[doc], h))
        h, g, doc, at = h[order], g[order], doc[order], at[order]
        first = np.r_[True, h[1:] != h[:-1]]
        least = ids[doc][np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
        # Equal 64 bits with other check bits are left to the next step.
        same = g == g[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
        gone = (ids[doc] > least) & same
        rows = []
        for settled in (False, True):
            pick = np.flatnonzero(gone == settled)
            if not len(pick):
                continue
            if settled:
                rows += [(x[0], True, x[1], b"", b"", *x[2:]) for x in _by_bin(ids, ths, doc[pick], at[pick], buckets)]
                continue
            edges = np.searchsorted(h[pick] >> np.uint64(33), (np.arange(buckets + 1) * (1 << 31)) // buckets)
            for b in range(buckets):
                part = pick[edges[b] : edges[b + 1]]
                if len(part):
                    used, where = np.unique(doc[part], return_inverse=True)
                    rows.append((
                        b, False, len(part), _squeezed(np.diff(h[part], prepend=np.uint64(0))), _squeezed(g[part]),
                        _squeezed(where.astype(np.uint32)), _squeezed(at[part].astype(np.uint32)), ids[used].tobytes(), ths[used].tobytes(),
                    ))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def found(batches):
        parts, n = [], 0
        for batch in batches:
            ids, ths = (batch.column(k).to_numpy() for k in (1, 2))
            for a, b, data, starts in W.chunks(batch.column(0)):
                hashes, before, index, h = _chunk_windows(data, starts, window)
                pick = np.flatnonzero(maybe.value(h))
                if len(pick):
                    index, h = index[pick], h[pick]
                    doc = np.searchsorted(before, index, "right") - 1
                    check = W.windows(hashes, before, window, 0x9FB21C651E98DF25)[1][pick].astype(np.uint32)
                    used, doc_at = np.unique(doc, return_inverse=True)
                    parts.append((h, check, doc_at, index - before[doc], ids[a:b][used], ths[a:b][used]))
                    n += len(h)
                if n >= TASK_ROWS:
                    yield settle(parts)
                    parts, n = [], 0
        if n:
            yield settle(parts)

    return found


def _by_bin(ids, ths, doc, at, bins):
    """Positions by bin of their document, ordered by document: (bin, n, doc, at, ids, ths)."""
    bin_of = (W.mixed((ids ^ ths).view(np.uint64)) % np.uint64(bins)).astype(np.int64)[doc]
    order = np.lexsort((at, doc, bin_of))
    doc, at, bin_of = doc[order], at[order], bin_of[order]
    edges = np.searchsorted(bin_of, np.arange(bins + 1))
    for b in np.flatnonzero(np.diff(edges)):
        part = slice(edges[b], edges[b + 1])
        used, where = np.unique(doc[part], return_inverse=True)
        yield int(b), len(where), _squeezed(where.astype(np.uint32)), _squeezed(at[part].astype(np.uint32)), ids[used].tobytes(), ths[used].tobytes()


_BINNED = "bin int, n int, doc binary, at binary, ids binary, ths binary"
_BINNED_SCHEMA = pa.schema([("bin", pa.int32()), ("n", pa.int32()), *((x, pa.binary()) for x in ("doc", "at", "ids", "ths"))])


def _by_document(batches):
    """The positions found in each document, from whatever buckets they come."""

    def merged(rows):
        ids, ths = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in (4, 5))
        shift = np.cumsum([0] + [len(r[4]) // 8 for r in rows[:-1]])
        doc = np.concatenate([_unsqueezed(r[2], r[1], np.uint32).astype(np.int64) + x for r, x in zip(rows, shift)])
        at = np.concatenate([_unsqueezed(r[3], r[1], np.uint32) for r in rows]).astype(np.int32)
        order = np.lexsort((at, ths[doc], ids[doc]))
        doc, at = doc[order], at[order]
        first = np.flatnonzero(np.r_[True, (ids[doc][1:] != ids[doc][:-1]) | (ths[doc][1:] != ths[doc][:-1])])
        blobs = [at[a:b].tobytes() for a, b in zip(first, np.r_[first[1:], len(doc)])]
        which = doc[first]
        return pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(ths[which]), pa.array(blobs, pa.binary())], names=["_id", "_th", "found"])

    rows, current = [], None
    for batch in batches:
        for r in W.each(batch):
            if r[0] != current and rows:
                yield merged(rows)
                rows = []
            current = r[0]
            rows.append(r)
    if rows:
        yield merged(rows)


def _grouped(buckets: int):
    """Exact groups of one bucket after another: a window goes if its hash also starts in a smaller document."""

    def judged(rows):
        n = [r[2] for r in rows]
        h = np.concatenate([np.cumsum(_unsqueezed(r[3], r[2], np.uint64), dtype=np.uint64) for r in rows])
        g = np.concatenate([_unsqueezed(r[4], r[2], np.uint32) for r in rows])
        ids, ths = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in (7, 8))
        shift = np.cumsum([0] + [len(r[7]) // 8 for r in rows[:-1]])
        doc = np.concatenate([_unsqueezed(r[5], r[2], np.uint32).astype(np.int64) for r in rows]) + np.repeat(shift, n)
        at = np.concatenate([_unsqueezed(r[6], r[2], np.uint32) for r in rows])
        order = np.lexsort((ids[doc], g, h))
        h, g = h[order], g[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
        doc, at = doc[order], at[order]
        gone = ids[doc] > ids[doc][np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
        return binned(_by_bin(ids, ths, doc[gone], at[gone], buckets))

    def binned(rows):
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(columns) or [[]] * 6, _BINNED_SCHEMA.types)], schema=_BINNED_SCHEMA)

    def group(batches):
        rows, bucket = [], None
        for batch in batches:
            for r in W.each(batch):
                if r[1]:
                    yield binned([(r[0], r[2], *r[5:])])
                    continue
                if r[0] != bucket and rows:
                    yield judged(rows)
                    rows = []
                bucket = r[0]
                rows.append(r)
        if rows:
            yield judged(rows)

    return group


def _kept(window: int):
    schema = pa.schema([("_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

    def kept(batches):
        for batch in batches:
            ids, found = batch.column(1), batch.column(2)
            for a, b, data, starts in W.chunks(batch.column(0)):
                begin, end, before = W.spans(data, starts)
                step = np.zeros(len(begin) + 1, np.int64)
                blobs = found.slice(a, b - a).to_pylist()
                for k, blob in enumerate(blobs):
                    if blob:
                        at = np.unique(np.frombuffer(blob, np.int32)) + before[k]
                        step[at] += 1
                        step[at + window] -= 1
                keep = np.cumsum(step[:-1]) == 0
                doc = np.repeat(np.arange(b - a), np.diff(before))
                kb, ke, kd = begin[keep], end[keep], doc[keep]
                n_kept = np.bincount(kd, minlength=b - a)
                out, out_at = W.joined(data, kb, ke, kd)
                edges = out_at[np.r_[0, np.cumsum(n_kept)]]
                text = pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())
                n_words = np.diff(before)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), text, pa.array(n_words), pa.array(n_words - n_kept)], schema=schema)

    return kept


def without_repeated_windows(docs: DataFrame, window: int = WINDOW, log2_cells: int = LOG2_CELLS) -> DataFrame:
    """``doc_id``, ``text`` (the kept words joined by one space), ``n_words`` and ``n_removed`` of every row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. ``log2_cells`` fixes the size of the sketch: two bit maps of ``2**log2_cells`` bits are broadcast
    whatever the input. With more windows than cells more of them are grouped exactly; the result stays the same.
    """
    rows = W.keyed(docs)
    maybe, total = repeated(rows.select("_text"), window_hashes(window), log2_cells)
    buckets = max(1, math.ceil(total / BUCKET_ROWS))
    moved = rows.select("_text", "_id", "_th").mapInArrow(_candidates(window, maybe, buckets), _MOVED)
    found = moved.repartition(buckets, "bucket").sortWithinPartitions("settled", "bucket").mapInArrow(_grouped(buckets), _BINNED)
    found = found.repartition(buckets, "bin").sortWithinPartitions("bin").mapInArrow(_by_document, "_id long, _th long, found binary")
    joined = rows.join(found, ["_id", "_th"], "left").select("_text", "_id", "found")
    return joined.mapInArrow(_kept(window), "_id long, text string, n_words long, n_removed long").select(W.null_id("_id").alias("doc_id"), "text", "n_words", "n_removed")


def _sql(window: int = WINDOW) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {W.NULL_ID}) AS id, [x for x in string_split_regex(coalesce(text, ''), '[ \\t-\\r]+') if x <> ''] AS w FROM documents),
win AS (SELECT rid, id, k, array_to_string(w[k : k + {window - 1}], ' ') AS s FROM (SELECT rid, id, w, unnest(range(1, len(w) - {window - 2})) AS k FROM d)),
least AS (SELECT s, min(id) AS least_id FROM win GROUP BY s),
gone AS (SELECT DISTINCT rid, unnest(range(k, k + {window})) AS p FROM win JOIN least USING (s) WHERE least_id < id),
one AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM one ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""


@llm_query("op9_substring_dedup", _sql())
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_windows(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
