"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit ``i`` of a fingerprint gets a vector of ``radius + 1`` bits, and every non-zero vector ``v`` gives a table whose mask holds
the bits ``i`` with ``<vector(i), v>`` odd. Two fingerprints that differ in ``radius`` bits or fewer leave a ``v`` orthogonal to
all of these bits' vectors, so they agree on that table's mask and meet there: no pair within the radius is missed.

Equal fingerprints are collapsed first, so copies cost one row. A bucket is compared with itself in one task and sends a
spanning forest of its links, never its pairs. For larger radii the bits can be cut into ``parts``: of ``radius`` differing bits
some part has ``radius // parts`` or fewer, and each part is covered by itself, with far fewer tables. A fingerprint may also be
longer than the 64 bits that are covered; links are then judged on all of its bits. Buckets over ``BUCKET_LIMIT`` are dealt anew by covering masks over the bits
their table leaves free; a quarter of the covered bits stays free then, which bounds the fingerprints of a bucket.

Defined cases: a null text is empty; texts without a word have fingerprint zero and are linked like any other; every input row
gets one result row; ``component_id`` ignores null doc_ids and is null only where a component has no other. Other columns of
the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import words as W
from weftline.llm.registry import llm_query
from weftline.llm.tokens import forget
from weftline.session import cut_lineage, small_batches
from weftline.sources.tables import table

SHINGLE = 4
RADIUS = 4
BITS = 64
BUCKET_LIMIT = 50_000
PAIRWISE = 48


def _shingles(before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of every shingle, and the number of shingles of each row."""
    n = np.diff(before)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.arange(int(count.sum())) + np.repeat(before[:-1] - (np.cumsum(count) - count), count)
    return first, first + np.repeat(np.minimum(n, size), count) - 1, count


def _fingerprinted(size: int, n_words: int):
    names = ["doc_id", "fingerprint", *(f"more_{k}" for k in range(1, n_words))]

    def fingerprints(batches):
        forget()
        for batch in batches:
            out = [np.zeros((0, n_words), np.int64)]
            for a, b, data, starts in W.chunks(batch.column(0)):
                data = W.lowered(data)
                begin, end, before = W.spans(data, starts)
                doc = np.repeat(np.arange(b - a), np.diff(before))
                text, at = W.joined(data, begin, end, doc)
                first, last, count = _shingles(before, size)
                text, digest = text.tobytes(), xxhash.xxh64_digest
                length = (end - begin)[last]
                raw = b"".join([digest(text[x:y], 42) for x, y in zip(at[first].tolist(), (at[last] + length).tolist())])
                own = np.zeros((b - a, n_words), np.int64)
                some = np.flatnonzero(count)
                if len(some):
                    starts_at = (np.cumsum(count) - count)[some]
                    hashes = np.frombuffer(raw, ">u8")
                    for k in range(n_words):
                        if k:  # further bits of each shingle, drawn from its hash
                            hashes = W.mixed(hashes.astype(np.uint64) + np.uint64(k)).astype(">u8")
                        sums = np.add.reduceat(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1), starts_at, axis=0, dtype=np.int32)
                        ones = np.packbits(sums * 2 > count[some][:, None], axis=1)
                        own[some, k] = np.ascontiguousarray(ones).view(">u8").ravel().astype(np.uint64).view(np.int64)
                out.append(own)
            out = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(n_words))], names=names)

    return fingerprints


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, n_words: int = 1) -> DataFrame:
    """``doc_id`` and the SimHash of each whole text: lower-cased A-Z, shingles of words, repeats counted.

    The 64 bits are the long ``fingerprint``; with ``n_words`` above one, further 64 bits each are in ``more_1`` and so on.
    """
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    more = "".join(f", more_{k} long" for k in range(1, n_words))
    return rows.mapInArrow(_fingerprinted(shingle, n_words), "doc_id long, fingerprint long" + more)


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """``2**(radius + 1) - 1`` masks over the given bit positions, each of about half of them."""
    whole = (1 << (radius + 1)) - 1
    vector = {bit: k * 11 % whole + 1 for k, bit in enumerate(bits)}
    return [sum(1 << bit for bit in bits if (vector[bit] & v).bit_count() & 1) for v in range(1, whole + 1)]


def _tables(radius: int, parts: int) -> list[tuple[int, list[int]]]:
    """Mask of every table, and the bits of its part that it leaves free."""
    out = []
    for p in range(parts):
        bits = list(range(p * BITS // parts, (p + 1) * BITS // parts))
        out += [(m, [b for b in bits if not m >> b & 1]) for m in covering_masks(bits, radius // parts)]
    return out


def _repeated_rows(batch, count: int) -> list[pa.Array]:
    return [pa.array(np.tile(c.to_numpy(), count)) for c in batch.columns]


def _dealt(radius: int, parts: int):
    masks = np.array([m for m, _ in _tables(radius, parts)], np.uint64)

    def deal(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                own = batch.slice(a, 2000)
                fp = own.column("fp").to_numpy().view(np.uint64)
                key = (fp[None, :] & masks[:, None]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(masks)), len(fp))), pa.array(key.view(np.int64)), *_repeated_rows(own, len(masks))], names=["mask", "key", *own.schema.names])

    return deal


def _dealt_again(radius: int, parts: int):
    """Rows of crowded buckets by masks over the bits that their first mask leaves free."""
    finer = [np.array([m | x for x in covering_masks(free, radius // parts)], np.uint64) for m, free in _tables(radius, parts)]

    def deal(batches):
        for batch in batches:
            mask = batch.column("mask").to_numpy()
            for m in np.unique(mask):
                own = batch.filter(pa.array(mask == m)).drop_columns(["mask", "key"])
                fp = own.column("fp").to_numpy().view(np.uint64)
                key = (fp[None, :] & finer[m][:, None]).ravel()
                table_ = np.repeat((int(m) + 1) * 1000 + np.arange(len(finer[m])), len(fp))
                yield pa.RecordBatch.from_arrays([pa.array(table_), pa.array(key.view(np.int64)), *_repeated_rows(own, len(finer[m]))], names=["mask", "key", *own.schema.names])

    return deal


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest of the links: each node but the least of its component, with that least node."""
    nodes, where = np.unique(np.r_[a, b], return_inverse=True)
    a, b = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while len(new) and (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _near(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Whether fingerprints, one per last index of (words, ..), differ in ``limit`` bits or fewer."""
    bits = np.bitwise_count(a[0] ^ b[0]).astype(np.uint16)
    for x, y in zip(a[1:], b[1:]):
        bits += np.bitwise_count(x ^ y)
    return bits <= limit


def _grown(node: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect one large bucket: components grow from a front that is compared with the unreached only."""
    a, b, rest = [], [], np.arange(len(node))
    while len(rest):
        root, front, rest = node[rest[0]], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            step = max(1, (1 << 20) // len(rest))
            for k in range(0, len(front), step):
                near |= _near(fp[:, front[k : k + step], None], fp[:, None, rest], limit).any(axis=0)
            front, rest = rest[near], rest[~near]
            a.append(node[front])
            b.append(np.full(len(front), root))
    return (np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])


def _linked(limit: int):
    def links_of(mask, key, node, fp):
        run = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[run, len(node)])
        a, b = [node[:0]], [node[:0]]
        for k in np.flatnonzero(size > PAIRWISE):
            x, y = _grown(node[run[k] : run[k] + size[k]], fp[:, run[k] : run[k] + size[k]], limit)
            a.append(x)
            b.append(y)
        small = np.repeat(np.where(size > PAIRWISE, -1, np.arange(len(size))), size)
        for shift in range(1, int(size[size <= PAIRWISE].max(initial=1))):
            pair = np.flatnonzero((small[shift:] == small[:-shift]) & (small[shift:] >= 0))
            pair = pair[_near(fp[:, pair], fp[:, pair + shift], limit)]
            a.append(node[pair])
            b.append(node[pair + shift])
        return np.concatenate(a), np.concatenate(b)

    def link(batches):
        forget()
        held, n, found = [], 0, []

        def flush(last: bool):
            nonlocal held, n
            rows = np.concatenate(held, axis=1)
            stop = rows.shape[1]
            if not last:  # the last bucket may go on in the next batch
                stop = int(np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1])).max(initial=-1)) + 1
            held, n = [rows[:, stop:]], rows.shape[1] - stop
            if stop:
                found.append(links_of(rows[0, :stop], rows[1, :stop], rows[2, :stop], rows[3:, :stop].view(np.uint64)))

        def sent():
            a, b = _forest(*(np.concatenate(x) for x in zip(*found)))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            n += batch.num_rows
            if n >= 1 << 18:
                flush(False)
                if sum(len(x) for x, _ in found) >= 1 << 20:
                    yield sent()
        if held:
            flush(True)
        if found:
            yield sent()

    return link


def links(distinct: DataFrame, radius: int = RADIUS, parts: int = 1, limit: int | None = None, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly what links connect, from a stored table of distinct ``node, fp, more..``.

    Two nodes link if some part of ``fp`` differs in ``radius // parts`` bits or fewer, and all words together in ``limit``
    (``radius`` if none) or fewer.
    """
    longs = ", ".join(f"{c} long" for c in ["mask", "key", *distinct.columns])
    rows = distinct.mapInArrow(_dealt(radius, parts), longs)
    crowded = cut_lineage(rows.groupBy("mask", "key").count().filter(F.col("count") > bucket_limit).select("mask", "key"), "crowded")
    if not crowded.isEmpty():
        again = rows.join(crowded, ["mask", "key"], "left_semi").select(*rows.columns).mapInArrow(_dealt_again(radius, parts), longs)
        rows = rows.join(crowded, ["mask", "key"], "left_anti").select(*rows.columns).unionByName(again)
    linked = rows.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_linked(radius if limit is None else limit), "a long, b long")
    return linked.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges (a, b)`` that isn't its component's least, by alternating stars.

    Each round is written to the shared folder; rounds go with the logarithm of the number of nodes.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        edges = cut_lineage(small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, parts: int = 1, n_words: int = 1, limit: int | None = None, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long) and ``component_id`` (least doc_id reachable over links) of every row of ``docs``.

    Without further arguments two texts link if their 64-bit fingerprints differ in ``radius`` bits or fewer; see ``links``.
    """
    with small_batches(docs.sparkSession):
        prints = cut_lineage(fingerprints(docs, shingle, n_words), "fingerprints")
    words = ["fingerprint", *(f"more_{k}" for k in range(1, n_words))]
    node = F.col("fingerprint") if n_words == 1 else F.xxhash64(*words)
    distinct = cut_lineage(prints.groupBy(*words).agg(F.min("doc_id").alias("least")).withColumn("node", node), "distinct")
    roots = components(links(distinct.select("node", F.col("fingerprint").alias("fp"), *words[1:]), radius, parts, limit, bucket_limit))
    of = distinct.join(roots, "node", "left").select(*words, "least", F.coalesce("root", "node").alias("root"))
    first = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(first, "root").select(*words, "component_id"), words).select("doc_id", "fingerprint", "component_id")


@llm_query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
