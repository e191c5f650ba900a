"""Document fingerprints by winnowing.

Characters are taken with A-Z lower-cased and ASCII white space left out. Every run of ``k`` of them has a rolling hash; of
``window`` hashes in a row the smallest is chosen, the rightmost of equal ones, and kept with its position. Two texts that
share ``k + window - 1`` such characters in a row therefore share a chosen hash, at the place where the passage stands in each.

Texts are winnowed some at a time as one array; a text longer than ``PIECE`` goes through in pieces that overlap by
``k + window - 2`` characters, which gives the same hashes.

``neighbours`` orders the whole table without a global sort of texts in one task: ranges of ids are found from the ids alone,
each text travels once to the task of its range, and the first text of each range also to the task of the range before.

Defined cases: a null text is empty; a text with nothing but white space has no hashes; one of fewer than ``k`` characters has
the hash of all of them, one of fewer than ``window`` hashes the smallest of them. A null doc_id counts as smaller than any
other; texts of one doc_id are ordered by their hash; rows equal in doc_id and text are one document listed more than once and
get the same result. A lone document is its own neighbour. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.registry import llm_query
from weftline.llm.words import keyed, mixed, null_id
from weftline.sources.tables import table

K = 25
WINDOW = 40
#: Characters winnowed at once; slots of one array are numbered by ``SLOT_BITS`` bits beside the 40 bits of a hash.
PIECE = 1 << 20
SLOT_BITS = 24
PARTS_PER_TASK = 4

_BASE = 0x9E3779B97F4A7C15
_SLOTS = np.uint64((1 << SLOT_BITS) - 1)
_NONE = np.uint64((1 << 64) - 1)
_WHITE = np.zeros(128, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int, n: int) -> np.ndarray:
    table = np.full(n, base, np.uint64)
    table[:1] = 1
    return np.multiply.accumulate(table)


def _plain(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters that count, as 32-bit numbers, and their positions."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((codes > 127) | ~_WHITE[np.minimum(codes, 127)])
    codes = codes[at]
    return np.where((codes >= 0x41) & (codes <= 0x5A), codes + np.uint32(0x20), codes), at


class Winnower:
    """``winnower(texts)``: for each text its chosen 40-bit hashes in the order of the text, and their positions."""

    def __init__(self, k: int = K, window: int = WINDOW):
        self.k, self.window = k, window
        self.up = self.down = np.zeros(0, np.uint64)

    def _chosen(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, gram and hash of what is chosen in each row of ``codes``."""
        k, window, n = self.k, self.window, len(codes)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        length = np.diff(starts)
        grams = np.where(length > 0, np.maximum(length - k + 1, 1), 0)
        slots = np.where(grams > 0, grams + window - 1, 0)
        before, gram_before = np.cumsum(slots) - slots, np.cumsum(grams) - grams
        gram = np.arange(int(grams.sum())) - np.repeat(gram_before, grams)
        begin = np.repeat(starts[:-1], grams) + gram
        end = np.minimum(begin + k, np.repeat(starts[1:], grams))
        slot = np.repeat(before, grams) + gram
        keys = np.full(int(slots.sum()), _NONE)
        hashes = mixed((sums[end] - sums[begin]) * self.down[begin]) >> np.uint64(SLOT_BITS)
        keys[slot] = hashes << np.uint64(SLOT_BITS) | (_SLOTS - slot.astype(np.uint64))
        span = 1
        while 2 * span <= window:  # keys[i] becomes the least of span keys from i on
            keys[:-span] = np.minimum(keys[:-span], keys[span:])
            span *= 2
        if span < window:
            keys[: span - window] = np.minimum(keys[: span - window], keys[window - span :])
        windows = np.where(grams > 0, np.maximum(grams - window, 0) + 1, 0)
        first = np.arange(int(windows.sum())) + np.repeat(before - (np.cumsum(windows) - windows), windows)
        least = keys[first]
        least = least[np.r_[True, least[1:] != least[:-1]]] if len(least) else least
        at = (_SLOTS - (least & _SLOTS)).astype(np.int64)
        row = np.searchsorted(np.cumsum(slots), at, "right")
        return row, at - before[row], least >> np.uint64(SLOT_BITS)

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        codes, at, found = np.zeros(0, np.uint32), np.zeros(0, np.int64), []
        need, started = self.k + self.window - 1, False
        for a in range(0, max(len(text), 1), PIECE):
            more, places = _plain(text[a : a + PIECE])
            codes, at = np.r_[codes, more], np.r_[at, places + a]
            if len(codes) < need and (started or a + PIECE < len(text)):
                continue
            _, gram, hashes = self._chosen(codes, np.array([0, len(codes)]))
            found.append((hashes, at[gram] if len(gram) else gram))
            codes, at, started = codes[max(len(codes) - need + 1, 0) :], at[max(len(at) - need + 1, 0) :], True
        hashes, places = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        fresh = np.r_[True, places[1:] != places[:-1]] if len(places) else np.zeros(0, bool)
        return hashes[fresh], places[fresh]

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        a = 0
        while a < len(texts):
            if len(texts[a]) > PIECE:
                out.append(self._long(texts[a]))
                a += 1
                continue
            b, size = a, 0
            while b < len(texts) and size + len(texts[b]) + self.window <= 2 * PIECE and len(texts[b]) <= PIECE:
                size += len(texts[b]) + self.window
                b += 1
            b = max(b, a + 1)
            ends = np.cumsum([0, *map(len, texts[a:b])])
            codes, at = _plain("".join(texts[a:b]))
            starts = np.searchsorted(at, ends)
            row, gram, hashes = self._chosen(codes, starts)
            edges = np.searchsorted(row, np.arange(b - a + 1))
            places = at[starts[row] + gram] - ends[row] if len(row) else gram
            out += [(hashes[x:y], places[x:y]) for x, y in zip(edges[:-1], edges[1:])]
            a = b
        return out


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_chars, hashes, positions`` of every row of ``docs``; positions count code points from 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])

    def found(batches):
        winnower = Winnower(k, window)
        for batch in batches:
            for a, b in _some(batch.column(1).to_pylist()):
                part = batch.column(1).slice(a, b - a).to_pylist()
                got = winnower(part)
                lists = [_lists([x[j].astype(np.int64) for x in got]) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(map(len, part)), pa.int64()), *lists], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(found, "doc_id long, n_chars long, hashes array<long>, positions array<long>")


def _some(texts: list[str]):
    """Ranges of rows of about ``PIECE`` characters."""
    a, size = 0, 0
    for b, text in enumerate(texts):
        size += len(text) + 64
        if size > PIECE:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays), pa.int64()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Resemblance of two sets of hashes: shared by all. Two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def shown(hashes: np.ndarray) -> str:
    """Ten hexadecimal digits a hash, in the order of the text."""
    return np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes().hex()


def _order_keys(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Sixteen bytes that sort by falling id, then by rising hash."""
    flip = np.int64(-1 << 63)
    return np.stack([~ids ^ flip, hashes ^ flip], axis=1).astype(">i8").view("S16").ravel()


def _dealt(firsts: np.ndarray):
    """Rows equal within a batch become one; the first row of a range also goes to the range before it."""
    schema = pa.schema([("part", pa.int32()), ("tail", pa.bool_()), ("_id", pa.int64()), ("_th", pa.int64()), ("copies", pa.int64()), ("_text", pa.string())])

    def dealt(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, hashes = (batch.column(k).to_numpy() for k in (0, 1))
            keys, at, copies = np.unique(_order_keys(ids, hashes), return_index=True, return_counts=True)
            part = np.searchsorted(firsts, keys, "right") - 1
            lead = np.flatnonzero(firsts[part] == keys)
            both = np.r_[at, at[lead]]
            tail = np.arange(len(both)) >= len(at)
            columns = [np.r_[part, (part[lead] - 1) % len(firsts)].astype(np.int32), tail, ids[both], hashes[both], np.r_[copies, copies[lead]]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(2).take(pa.array(both))], schema=schema)

    return dealt


def neighbours(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` by range of falling id: ``part, tail, _id, _th, copies, _text``, sorted within the task.

    Within a ``part`` each row is followed by its neighbour; the last one, marked ``tail``, is there as a neighbour only.
    """
    rows = keyed(docs)
    tasks = max(1, docs.rdd.getNumPartitions())
    ranged = rows.select("_id", "_th").repartitionByRange(PARTS_PER_TASK * tasks, F.desc("_id"), F.asc("_th"))
    least = ranged.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(F.bitwise_not("_id").alias("id"), F.col("_th").alias("th"))).alias("least"))
    bounds = least.select("least.*").toArrow()  # a row for each range, whatever the input
    firsts = np.sort(_order_keys(~bounds["id"].to_numpy(), bounds["th"].to_numpy())) if bounds.num_rows else np.zeros(0, "S16")
    dealt = rows.select("_id", "_th", "_text").mapInArrow(_dealt(firsts), "part int, tail boolean, _id long, _th long, copies long, _text string")
    return dealt.repartition(tasks, "part").sortWithinPartitions("part", "tail", F.desc("_id"), "_th")


_COMPARED = "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(k: int, window: int):
    def edited(text: str, following: str) -> str:
        third = len(text) // 3
        return text[: len(text) - third] + following[:third]

    def results(winnower: Winnower, rows: list[list]):
        own = winnower([r[4] for r in rows])
        pairs = [j for j in range(len(rows) - 1) if not rows[j][1]]
        texts = [edited(rows[j][4], rows[j + 1][4]) for j in pairs]
        other = winnower(texts)
        out = []
        for j, text, (hashes, _) in zip(pairs, texts, other):
            mine = own[j][0]
            row = (
                rows[j][2][0], len(rows[j][4]), hashlib.sha256(text.encode()).hexdigest(), shown(mine), shown(hashes), likeness(mine, hashes), likeness(mine, own[j + 1][0]),
            )
            out += [row] * rows[j][3]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in _COMPARED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

    def compared(batches):
        winnower, rows, size = Winnower(k, window), [], 0
        for batch in batches:
            columns = [batch.column(j).to_pylist() for j in range(5)]
            for j, (part, tail, i, th, copies) in enumerate(zip(*columns)):
                if rows and rows[-1][:3] == [part, tail, (i, th)]:
                    rows[-1][3] += copies
                    continue
                if size > PIECE and len(rows) > 1:
                    yield results(winnower, rows)
                    rows, size = rows[-1:], 0
                rows.append([part, tail, (i, th), copies, batch.column(5)[j].as_py()])
                size += len(rows[-1][4]) + 64
        if rows:
            yield results(winnower, rows)

    return compared


def compared_with_edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Every row's fingerprint beside that of an edited copy and of the next document by falling doc_id.

    The edited copy has its last third replaced by the beginning of the next document. The likeness of two fingerprints is
    the share of their hashes that both have.
    """
    found = neighbours(docs).mapInArrow(_compared(k, window), _COMPARED)
    return found.select(null_id("_id").alias("doc_id"), *[x.split()[0] for x in _COMPARED.split(", ")][1:])


@llm_query("op13_winnowing")
def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_edits(table(spark, sf_dir, "documents"))
