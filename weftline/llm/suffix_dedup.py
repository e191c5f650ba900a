"""Repeated byte strings of ``min_length`` or more: where a longest previous factor reaches it, by equal windows and suffix order.

The array of these factors is not built; windows are grouped by hash, and those of differing contexts then sorted as suffixes.

A position's longest previous factor is the longest string that starts there and also at an earlier position. In suffix order
the best earlier matches of a position are its nearest neighbours, before and behind, that start earlier in the text. Where it
reaches ``min_length``, a later copy is removed and the first is kept; with ``keep_first=False`` every copy is removed, the
first too. Only "at least ``min_length``" matters, so suffixes are ordered by their first ``min_length`` bytes and ties by
position: the previous smaller position of a suffix is then the one before it in its tie, and the next smaller one lies outside.

No task can hold the suffixes of all texts, so they are split where equal ones must meet:

1. Every window of ``min_length`` bytes has an anchor, the ``GRAM`` bytes of least hash within it. Equal windows have equal
   anchors at the same place. Neighbouring windows share anchors; the bytes of all windows of one anchor are its context.
2. A sketch of all anchors' hashes tells which may be repeated (``sketch.py``); the others' windows occur once.
3. Contexts of repeated anchors are grouped by the anchor's hash. Equal contexts are settled without looking further, first
   within a task, so that a passage in a third of all documents costs a row per task. Different contexts of one anchor are
   ordered by suffix. Anchors that very many tasks hold are split into their single windows, for which equality is all.
4. The spans found are joined to the documents and taken out.

Positions are ordered by doc_id (null first), text hash and offset. Defined cases: a null text is empty; rows equal in doc_id
and text are one document listed twice and get the same result; texts under ``min_length`` bytes lose nothing; matches never
cross documents. Columns other than doc_id and text are not read.
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
from weftline.llm.tokens import forget
from weftline.session import cut_lineage, small_batches
from weftline.sources.tables import table

MIN_LENGTH = 200
GRAM = 48
LOG2_CELLS = 27
DEPTH = 3
BUCKET_ANCHORS = 1 << 15
TASK_ROWS = 100_000
CHUNK = 1 << 18
WINDOWS = 300_000
SLICE = 50_000


def _anchors(data: np.ndarray, starts: np.ndarray, min_length: int):
    """Per anchor: its hash, row, place, first window and the window behind its last; and the bytes' prefix sums."""
    n, reach = len(data), min_length - GRAM + 1
    sums = W.prefix_sums(data)
    size = np.diff(starts)
    some = np.flatnonzero(size >= min_length)
    if not len(some):
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e, e, sums
    gram = np.arange(n - GRAM + 1)
    hashes = W.span_hash(sums, gram, gram + GRAM)
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | gram.astype(np.uint64)
    step, width = low, 1
    while width * 2 <= reach:
        step = np.minimum(step[: len(step) - width], step[width:])
        width *= 2
    if width < reach:
        step = np.minimum(step[: len(step) - (reach - width)], step[reach - width :])
    count = size[some] - min_length + 1
    window = np.arange(int(count.sum())) + np.repeat(starts[some] - (np.cumsum(count) - count), count)
    place = (step[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(some, count)
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    begin, place, row = window[first], place[first], row[first]
    return hashes[place], row, place, begin, begin + np.diff(np.r_[first, len(window)]), sums


def _anchor_hashes(min_length: int):
    def hashes(batches):
        forget()
        for batch in batches:
            for _, _, data, starts in W.chunks(batch.column(0), CHUNK):
                yield _anchors(data, starts, min_length)[0]
        W.free_memory()

    return hashes


_FIELDS = {"h": np.uint64, "x": np.uint64, "y": np.uint64, "id": np.int64, "th": np.int64, "at": np.int64, "back": np.uint32, "windows": np.uint32, "often": np.uint8}


def _squeezed(a) -> bytes:
    return pa.compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(blob: bytes, n: int, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.frombuffer(pa.decompress(blob, n * dtype.itemsize, codec="zstd", asbytes=True), dtype)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination starts in sorted columns."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def _ordered(f: dict) -> dict:
    order = np.lexsort((f["at"], f["th"], f["id"], f["windows"], f["back"], f["y"], f["x"], f["h"]))
    f = {k: v[order] for k, v in f.items()}
    distinct = _runs(*(f[k] for k in ("h", "x", "y", "back", "windows", "id", "th", "at")))
    often = np.maximum.reduceat(f["often"], distinct) if len(distinct) else f["often"]
    return {k: v[distinct] for k, v in f.items()} | {"often": often}


def _settled(f: dict, keep_first: bool):
    """Of equal contexts: mask of the first one (which goes on), and of those whose every window is removed."""
    run = _runs(*(f[k] for k in ("h", "x", "y", "back", "windows")))
    size = np.diff(np.r_[run, len(f["h"])])
    first = np.zeros(len(f["h"]), bool)
    first[run] = True
    gone = np.repeat(size > 1, size) & ~first
    often = np.repeat(np.maximum.reduceat(f["often"], run) > 0, size) if len(run) else gone
    if not keep_first:
        gone |= (np.repeat(size > 1, size) | often) & first
    f["often"][run] = (size > 1) | (np.maximum.reduceat(f["often"], run) > 0) if len(run) else 0
    return first, gone


_MOVED = "bucket int, n int, settled boolean, fields array<binary>, bytes binary, size int"
_MOVED_SCHEMA = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("settled", pa.bool_()), ("fields", pa.list_(pa.binary())), ("bytes", pa.binary()), ("size", pa.int32())])


def _spans_by_bin(ids, ths, begin, end, bins):
    """Spans by bin of their document."""
    bin_of = (W.mixed((ids ^ ths).view(np.uint64)) % np.uint64(bins)).astype(np.int64)
    order = np.lexsort((begin, ths, ids, bin_of))
    ids, ths, begin, end, bin_of = (x[order] for x in (ids, ths, begin, end, bin_of))
    edges = np.searchsorted(bin_of, np.arange(bins + 1))
    rows = []
    for b in np.flatnonzero(np.diff(edges)):
        part = slice(edges[b], edges[b + 1])
        rows.append((int(b), int(edges[b + 1] - edges[b]), True, [_squeezed(x[part]) for x in (ids, ths, begin, end)], b"", 0))
    return rows


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, _MOVED_SCHEMA.types)], schema=_MOVED_SCHEMA)


def _contexts(min_length: int, maybe, buckets: int, keep_first: bool):
    def send(parts):
        f = {k: np.concatenate([p[0][k] for p in parts]) for k in _FIELDS if k != "often"} | {"often": np.zeros(sum(len(p[0]["h"]) for p in parts), np.uint8)}
        shift = np.cumsum([0] + [len(p[1]) for p in parts[:-1]])
        f["source"] = np.concatenate([p[2] + s for p, s in zip(parts, shift)])
        raw = np.concatenate([p[1] for p in parts])
        f = _ordered(f)
        first, gone = _settled(f, keep_first)
        begin = f["at"] - f["back"]
        rows = _spans_by_bin(f["id"][gone], f["th"][gone], begin[gone], begin[gone] + f["windows"][gone] + (min_length - 1), buckets)
        f = {k: v[first] for k, v in f.items()}
        edges = np.searchsorted(f["h"] >> np.uint64(33), (np.arange(buckets + 1) * (1 << 31)) // buckets)
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            own = {k: f[k][part].astype(t) for k, t in _FIELDS.items()}
            length = np.where(f["source"][part] >= 0, own["windows"].astype(np.int64) + (min_length - 1), 0)
            total = int(length.sum())
            text = raw[np.arange(total) + np.repeat(f["source"][part] - (np.cumsum(length) - length), length)].tobytes()
            rows.append((int(b), len(own["h"]), False, [_squeezed(v) for v in own.values()], _squeezed(text), total))
        return _batch(rows)

    def contexts(batches):
        forget()
        parts, n = [], 0
        for batch in batches:
            ids, ths = (batch.column(k).to_numpy() for k in (1, 2))
            for a, b, data, starts in W.chunks(batch.column(0), CHUNK):
                h, row, place, begin, stop, sums = _anchors(data, starts, min_length)
                pick = maybe.value(h)
                hot = pick & maybe.value.hot(h) if pick.any() else pick
                own = np.flatnonzero(pick & ~hot)
                x = W.span_hash(sums, begin[own], stop[own] + (min_length - 1))
                y = W.mixed(W.span_hash(sums, begin[own], place[own] + GRAM) * np.uint64(0x9FB21C651E98DF25) + W.span_hash(sums, place[own], stop[own] + (min_length - 1)))
                got = {"h": h[own], "x": x, "y": y, "row": row[own], "at": place[own], "back": place[own] - begin[own], "windows": stop[own] - begin[own], "source": begin[own]}
                if hot.any():  # each window for itself: a context of one window, known by its hash
                    count = (stop - begin)[hot]
                    at = np.arange(int(count.sum())) + np.repeat(begin[hot] - (np.cumsum(count) - count), count)
                    x = W.span_hash(sums, at, at + min_length)
                    y = W.mixed(W.span_hash(sums, at, at + GRAM) * np.uint64(0x9FB21C651E98DF25) + W.span_hash(sums, at + GRAM, at + min_length))
                    zero = np.zeros(len(at), np.int64)
                    more = {"h": W.mixed(x), "x": x, "y": y, "row": np.repeat(row[hot], count), "at": at, "back": zero, "windows": zero + 1, "source": zero - (1 << 40)}
                    got = {k: np.concatenate([v, more[k]]) for k, v in got.items()}
                if len(got["h"]):
                    r = got.pop("row")
                    source = got.pop("source")
                    got |= {"id": ids[a:b][r], "th": ths[a:b][r], "at": got["at"] - starts[r]}
                    parts.append((got, data.copy(), source))
                    n += len(r)
                if n >= TASK_ROWS or len(parts) >= 64:
                    yield send(parts)
                    parts, n = [], 0
        if n:
            yield send(parts)
        del parts
        W.free_memory()

    return contexts


def _in_suffix_order(buffer: np.ndarray, at: np.ndarray, min_length: int, keep_first: bool) -> np.ndarray:
    """Which of the suffixes at ``at`` (given by position, earliest first) share ``min_length`` bytes with an earlier one, or,
    without ``keep_first``, with any other one."""
    suffix = np.lib.stride_tricks.sliding_window_view(buffer, min_length)[at]
    suffix = np.ascontiguousarray(suffix).view(f"S{min_length}").ravel()
    order = np.argsort(suffix, kind="stable")
    tied = np.r_[False, suffix[order][1:] == suffix[order][:-1]]
    out = np.zeros(len(at), bool)
    out[order] = tied if keep_first else tied | np.r_[tied[1:], False]
    return out


def _window_hashes(raw: np.ndarray, source: np.ndarray, count: np.ndarray, min_length: int) -> np.ndarray:
    """Hashes of the ``count`` windows of each context, in the order of the contexts, for a stretch of ``raw`` at a time."""
    out = np.empty(int(count.sum()), np.uint64)
    to = np.cumsum(count) - count
    order = np.argsort(source, kind="stable")
    a = 0
    while a < len(order):
        low = source[order[a]]
        b = max(a + 1, int(np.searchsorted(source[order], low + CHUNK)))
        own = order[a:b]
        n = count[own]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(source[own] - low, n) + step
        sums = W.prefix_sums(raw[low : int(source[own[-1]] + n[-1]) + min_length - 1])
        out[np.repeat(to[own], n) + step] = W.span_hash(sums, at, at + min_length)
        a = b
    return out


def _matched(min_length: int, keep_first: bool, bins: int):
    def in_suffix_order(f, raw, own):
        """Removed stretches of the contexts ``own`` of some anchors: context, and begin and end within it."""
        own = own[np.lexsort((f["at"][own] - f["back"][own], f["th"][own], f["id"][own]))]
        count = f["windows"][own].astype(np.int64)
        context = np.repeat(np.arange(len(own)), count)
        offset = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
        source = np.repeat(f["source"][own], count) + offset
        h = _window_hashes(raw, f["source"][own], count, min_length)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        edges = _runs(h[order])
        removed = np.zeros(len(source), bool)
        a = 0
        while a < len(edges):
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + SLICE)))
            part = order[edges[a] : edges[b] if b < len(edges) else len(order)]
            part = np.sort(part)  # by position
            removed[part] = _in_suffix_order(raw, source[part], min_length, keep_first)
            a = b
        hit = np.flatnonzero(removed)
        stretch = np.flatnonzero(np.r_[True, (context[hit][1:] != context[hit][:-1]) | (offset[hit][1:] != offset[hit][:-1] + 1)]) if len(hit) else hit
        last = np.r_[stretch[1:], len(hit)] - 1 if len(hit) else hit
        return own[context[hit[stretch]]], offset[hit[stretch]], offset[hit[last]] + min_length

    def judged(rows):
        fields = [[_unsqueezed(x, r[1], t) for x, t in zip(r[3], _FIELDS.values())] for r in rows]
        f = {k: np.concatenate([x[j] for x in fields]) for j, k in enumerate(_FIELDS)}
        raw = np.concatenate([np.frombuffer(pa.decompress(r[4], r[5], codec="zstd", asbytes=True), np.uint8) if r[5] else np.zeros(0, np.uint8) for r in rows])
        single = (f["back"] == 0) & (f["windows"] == 1) & (f["h"] == W.mixed(f["x"]))
        length = np.where(single, 0, f["windows"].astype(np.int64) + (min_length - 1))
        f["source"] = np.cumsum(length) - length
        f["often"], f["single"] = f["often"].copy(), single
        f = _ordered(f)
        first, gone = _settled(f, keep_first)
        begin = f["at"] - f["back"]
        found = [(f["id"][gone], f["th"][gone], begin[gone], begin[gone] + f["windows"][gone] + (min_length - 1))]
        # Different contexts of one anchor: their windows in suffix order, if their hash comes more than once.
        run = _runs(f["h"])
        several = np.repeat(np.add.reduceat(first & ~f["single"], run, dtype=np.int64) > 1, np.diff(np.r_[run, len(f["h"])])) if len(run) else first
        own = np.flatnonzero(first & several & ~f["single"])
        edges = np.r_[_runs(f["h"][own]), len(own)]
        before = np.r_[0, np.cumsum(f["windows"][own], dtype=np.int64)][edges]
        a = 0
        while a < len(edges) - 1:  # whole anchors, some at a time
            b = max(a + 1, int(np.searchsorted(before, before[a] + WINDOWS, "right")) - 1)
            c, start, stop = in_suffix_order(f, raw, own[edges[a] : edges[b]])
            found.append((f["id"][c], f["th"][c], begin[c] + start, begin[c] + stop))
            a = b
        return _batch(_spans_by_bin(*(np.concatenate(x) for x in zip(*found)), bins))

    def match(batches):
        forget()
        rows, bucket = [], None
        for batch in batches:
            for r in W.each(batch):
                if r[2]:
                    yield _batch([r])
                    continue
                if r[0] != bucket and rows:
                    yield judged(rows)
                    rows = []
                bucket = r[0]
                rows.append(r)
        if rows:
            yield judged(rows)
        del rows
        W.free_memory()

    return match


def _united(batches):
    """The removed runs of each document: begins and ends, apart from each other."""

    def merged(rows):
        ids, ths, begin, end = (np.concatenate([_unsqueezed(r[3][j], r[1], np.int64) for r in rows]) for j in range(4))
        order = np.lexsort((begin, ths, ids))
        ids, ths, begin, end = (x[order] for x in (ids, ths, begin, end))
        doc = _runs(ids, ths)
        which = np.repeat(np.arange(len(doc)), np.diff(np.r_[doc, len(ids)]))
        reach = np.maximum.accumulate(end + which * (1 << 40)) - which * (1 << 40)
        fresh = np.r_[True, (which[1:] != which[:-1]) | (begin[1:] > reach[:-1])]
        at = np.flatnonzero(fresh)
        b, e, d = begin[at], reach[np.r_[at[1:], len(ids)] - 1], which[at]
        edges = np.searchsorted(d, np.arange(len(doc) + 1))
        blobs = [np.r_[b[x:y], e[x:y]].tobytes() for x, y in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(ths[doc]), pa.array(blobs, pa.binary())], names=["_id", "_th", "runs"])

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


_CUT = ["_id", "kept", "text", "n_bytes", "n_removed", "n_spans", "rest"]


def _cut_rows(batch: pa.RecordBatch, data: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    kept, texts, removed, spans = [], [], [], []
    for k, runs in enumerate(batch.column(2).to_pylist()):
        own = data[starts[k] : starts[k + 1]]
        if not runs:
            raw = own.tobytes()
            kept.append(raw)
            texts.append(raw.decode())
            removed.append(0)
            spans.append(0)
            continue
        begin, end = np.frombuffer(runs, np.int64).reshape(2, -1)
        keep = np.ones(len(own), bool)
        whole = np.ones(len(own), bool)
        for b, e in zip(begin.tolist(), end.tolist()):
            keep[b:e] = False
            while b < e and own[b] & 0xC0 == 0x80:  # a character that is cut stays whole
                b += 1
            while e > b and e < len(own) and own[e] & 0xC0 == 0x80:
                e -= 1
            whole[b:e] = False
        kept.append(own[keep].tobytes())
        texts.append(own[whole].tobytes().decode())
        removed.append(int((end - begin).sum()))
        spans.append(len(begin))
    return pa.RecordBatch.from_arrays(
        [batch.column(1), pa.array(kept, pa.binary()), pa.array(texts, pa.string()), pa.array(np.diff(starts)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), batch.column(3)], names=_CUT
    )


def _cut(batches):
    forget()
    for batch in batches:
        for a, b, data, starts in W.chunks(batch.column(0)):
            yield _cut_rows(batch.slice(a, b - a), data, starts)


def without_repeats(docs: DataFrame, min_length: int = MIN_LENGTH, keep_first: bool = True, log2_cells: int = LOG2_CELLS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, kept`` (bytes), ``text`` (cut at whole characters only), ``n_bytes, n_removed, n_spans`` of every row of ``docs``.

    ``carry``: columns of ``docs`` that come along in the struct ``rest``.
    """
    if min_length < 2 * GRAM:
        raise ValueError(f"min_length must be {2 * GRAM} or more")
    rows = W.keyed(docs)
    with small_batches(docs.sparkSession):
        maybe, total = repeated(rows.select("_text"), _anchor_hashes(min_length), log2_cells, DEPTH, keep_hot=True)
    buckets = max(1, math.ceil(total / BUCKET_ANCHORS))
    moved = rows.select("_text", "_id", "_th").mapInArrow(_contexts(min_length, maybe, buckets, keep_first), _MOVED)
    spans = moved.repartition(buckets, "bucket").sortWithinPartitions("settled", "bucket").mapInArrow(_matched(min_length, keep_first, buckets), _MOVED)
    runs = spans.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_united, "_id long, _th long, runs binary")
    with small_batches(docs.sparkSession):
        runs = cut_lineage(runs, "runs")
    maybe.destroy()
    rest = F.struct(*carry) if carry else F.lit(None).cast("string")
    whole = W.keyed(docs, rest.alias("rest"))
    joined = whole.join(runs, ["_id", "_th"], "left").select("_text", "_id", "runs", "rest")
    kind = joined.schema["rest"].dataType.simpleString()
    cut = joined.mapInArrow(_cut, f"_id long, kept binary, text string, n_bytes long, n_removed long, n_spans long, rest {kind}")
    return cut.select(W.null_id("_id").alias("doc_id"), "kept", "text", "n_bytes", "n_removed", "n_spans", *(["rest"] if carry else []))


@llm_query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents"), keep_first=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
