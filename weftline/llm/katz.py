"""Katz back-off scores of whole texts under a bigram model of the corpus.

A token's probability after another is the Good-Turing discounted share of the pair among all pairs of that first token, if the
pair was seen in training; else the first token's back-off weight times the token's unigram probability, which is discounted in
the same way and leaves its freed mass to unknown words as one class. A back-off weight is the mass freed by a context's
discounts over the unigram mass of what never followed it, so every distribution sums to one. A context whose pairs are all too
frequent to be discounted gives one count to the unseen.

Nothing is kept by word on the driver or broadcast by word; texts become blocks of word numbers and counts are exchanged:

1. A block holds some documents as numbers into its own list of distinct words (by 64-bit hash).
2. Blocks send their words by bucket; a bucket adds up training counts, numbers its words, and answers each block.
3. Blocks send each distinct (context, token, document) by bucket of the context, with the token's count. A bucket then has all
   that ever followed its contexts: it counts pairs, stores them (kind ``pairs``), and answers by block with what each document
   needs: sums over seen pairs, and its unseen tokens with their contexts' totals.
4. Counts of counts are known then; discounts are put in and each document's parts summed by block.

Contexts seen ``HOT_CONTEXT`` times or more are split by token over buckets, and their totals put together afterwards: there are
at most ``2**18`` of them, whatever the input. All tables are written by bucket or block to the shared folder.

Defined cases: a null text is empty and has the end token alone; a null doc_id counts as training; repeated rows are scored
each and count each; without training texts every score is 0. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import words as W
from weftline.llm.registry import llm_query
from weftline.session import scratch_path
from weftline.sources.tables import table

BLOCK_TOKENS = 1 << 20
BUCKET_WORDS = 1 << 20
BUCKET_PAIRS = 3 << 19
HOT_CONTEXT = 1 << 20
K = 5
END = np.uint64(0x5BF03635DEADBEEF)


def _squeezed(a: np.ndarray, dtype) -> bytes:
    return pa.compress(np.ascontiguousarray(a, dtype).tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(blob: bytes, n: int, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.frombuffer(pa.decompress(blob, n * dtype.itemsize, codec="zstd", asbytes=True), dtype) if n else np.zeros(0, dtype)


def _rows(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds.values())], names=list(kinds))


def _by_bucket(batches, key: int):
    """Lists of the rows of one bucket, in a partition sorted by bucket."""
    held = []
    for batch in batches:
        for r in W.each(batch):
            if held and r[key] != held[0][key]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _turing(n) -> list[float]:
    """``d[1..K]`` of Good-Turing from counts of counts ``n[1..K + 1]``; 0 where there is none."""
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    return [0.0] + [((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] and tail < 1 else 0.0 for r in range(1, K + 1)]


def _smoothed(n: list[int]) -> list[float]:
    """Counts of counts on the line through their logarithms over log r, each averaged over the gap around it (Gale and Sampson)."""
    seen = [r for r in range(1, K + 2) if n[r]]
    if len(seen) < 2:
        return [0.0] * (K + 2)
    before, after = [0, *seen[:-1]], [*seen[1:], 2 * seen[-1] - seen[-2]]
    slope, level = np.polyfit(np.log(seen), [math.log(2 * n[r] / (z - q)) for r, q, z in zip(seen, before, after)], 1)
    return [0.0] + [math.exp(level + slope * math.log(r)) for r in range(1, K + 2)]


def discounts(counts_of_counts: list[int]) -> list[float]:
    """``d[1..K]`` by Good-Turing from how many things were seen 1, .., K + 1 times (``d[0]`` is unused).

    Copies lift single counts of counts, so that an estimate leaves (0, 1). From the first such r on, smoothed counts of counts
    give the discounts; only an r for which these give none either, or all if nothing was seen once, lose half a count.
    """
    n = [0, *counts_of_counts]
    out, fitted = _turing(n), _turing(_smoothed(n))
    first = next((r for r in range(1, K + 1) if not 0 < out[r] < 1), K + 1)
    for r in range(first, K + 1):
        out[r] = fitted[r] if n[1] and 0 < fitted[r] < 1 else (r - 0.5) / r
    return [1.0, *(float(d) for d in out[1:])]


_BLOCK = {"block": pa.int64(), "n_docs": pa.int32(), "n": pa.int64(), "n_words": pa.int64(), "ids": pa.binary(), "train": pa.binary(), "lengths": pa.binary(), "tokens": pa.binary(), "words": pa.binary(), "counts": pa.binary()}
_BLOCK_SQL = "block long, n_docs int, n long, n_words long, ids binary, train binary, lengths binary, tokens binary, words binary, counts binary"


def _blocks(batches):
    from pyspark import TaskContext

    block, parts, n = TaskContext.get().partitionId() << 24, [], 0

    def sent():
        hashes, lengths = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        ids, train = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        words, tokens = np.unique(hashes, return_inverse=True)
        counts = np.bincount(tokens, np.repeat(train, lengths), len(words))
        return _rows([(
            block, len(ids), len(tokens), len(words), _squeezed(ids, np.int64), _squeezed(train, np.uint8), _squeezed(lengths, np.uint32),
            _squeezed(tokens, np.uint32), _squeezed(np.diff(words, prepend=np.uint64(0)), np.uint64), _squeezed(counts, np.uint32),
        )], _BLOCK)

    for batch in batches:
        ids, train = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        for a, b, data, starts in W.chunks(batch.column(0)):
            data = W.lowered(data)
            begin, end, before = W.spans(data, starts)
            hashes = W.word_hash(data, begin, end)
            lengths = np.diff(before) + 1
            parts.append((np.insert(hashes, before[1:], END), lengths, ids[a:b], train[a:b]))
            n += len(hashes) + b - a
            if n >= BLOCK_TOKENS:
                yield sent()
                block, parts, n = block + 1, [], 0
    if parts:
        yield sent()


_ASKED = {"bucket": pa.int32(), "block": pa.int64(), "n": pa.int32(), "words": pa.binary(), "counts": pa.binary()}


def _ask_words(buckets: int):
    def ask(batches):
        for batch in batches:
            for block, n, words, counts in W.each(batch):
                words, counts = np.cumsum(_unsqueezed(words, n, np.uint64), dtype=np.uint64), _unsqueezed(counts, n, np.uint32)
                edges = np.searchsorted(words >> np.uint64(33), (np.arange(buckets + 1) * (1 << 31)) // buckets)
                yield _rows([
                    (b, block, int(edges[b + 1] - edges[b]), _squeezed(np.diff(words[edges[b] : edges[b + 1]], prepend=np.uint64(0)), np.uint64), _squeezed(counts[edges[b] : edges[b + 1]], np.uint32))
                    for b in range(buckets) if edges[b + 1] > edges[b]
                ], _ASKED)

    return ask


_ANSWER = {"block": pa.int64(), "bucket": pa.int32(), "n": pa.int32(), "numbers": pa.binary(), "counts": pa.binary(), "stats": pa.list_(pa.int64())}


def _answer_words(buckets: int):
    """Number and training count of each word asked for; frequent words get small numbers."""

    def answer(batches):
        for rows in _by_bucket(batches, 0):
            asked = [np.cumsum(_unsqueezed(r[3], r[2], np.uint64), dtype=np.uint64) for r in rows]
            words, where = np.unique(np.concatenate(asked), return_inverse=True)
            counts = np.bincount(where, np.concatenate([_unsqueezed(r[4], r[2], np.uint32) for r in rows]), len(words)).astype(np.int64)
            number = np.empty(len(words), np.int64)
            number[np.argsort(-counts, kind="stable")] = np.arange(len(words)) * buckets + rows[0][0]
            stats = [int(counts.sum()), int((counts > 0).sum()), *(int((counts == r).sum()) for r in range(1, K + 2)), int(counts[counts > K].sum())]
            out, at = [], 0
            for r in rows:
                own = where[at : at + r[2]]
                out.append((r[1], r[0], r[2], _squeezed(number[own], np.uint64), _squeezed(counts[own], np.uint64), stats if not at else None))
                at += r[2]
            yield _rows(out, _ANSWER)

    return answer


class Unigrams:
    """Discounted unigram probabilities by count; those of unknown words together are ``unknown``."""

    def __init__(self, total: int, distinct: int, counts_of_counts: list[int], above: int):
        self.total, self.distinct = total, distinct
        self.d = np.array(discounts(counts_of_counts))
        seen = (above + sum(self.d[r] * r * counts_of_counts[r - 1] for r in range(1, K + 1))) / total if total else 0.0
        self.unknown = 1 - seen if total and 1 - seen > 1e-12 else (1 / (total + 1) if total else 1.0)
        self.scale = (1 - self.unknown) / seen if seen else 0.0

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        d = np.where(counts <= K, self.d[np.minimum(counts, K)], 1.0)
        return np.where(counts > 0, self.scale * d * counts / max(self.total, 1), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


_PAIRS = {"bucket": pa.int32(), "block": pa.int64(), "kind": pa.int32(), "n": pa.int64(), "columns": pa.list_(pa.binary())}
_PAIRS_SQL = "bucket int, block long, kind int, n long, columns array<binary>"
BEGIN = 1 << 62
DOCS, PAIRS, SCORES, UNSEEN, HOT, STATS = range(6)


def _bucket_of(v: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    key = np.where(hot, v ^ (w + 1) * 0x2545F4914F6CDD1D, v).astype(np.uint64)
    return (W.mixed(key) % np.uint64(buckets)).astype(np.int64)


def _ask_pairs(buckets: int, unigrams: Unigrams, begins: int, hot_from: int):
    """Distinct (context, token, document) of each block, by bucket; and what a document's base score needs no pairs for."""

    def ask(batches):
        for batch in batches:
            for block, n_docs, n, n_words, ids, train, lengths, tokens, answers in W.each(batch):
                answers = sorted(answers, key=lambda a: a["bucket"])
                number = np.concatenate([_unsqueezed(a["numbers"], a["n"], np.uint64) for a in answers]).astype(np.int64)
                count = np.concatenate([_unsqueezed(a["counts"], a["n"], np.uint64) for a in answers]).astype(np.int64)
                tokens, lengths = _unsqueezed(tokens, n, np.uint32).astype(np.int64), _unsqueezed(lengths, n_docs, np.uint32).astype(np.int64)
                first = np.cumsum(lengths) - lengths
                base = np.add.reduceat(unigrams.base(count)[tokens], first)
                known = np.add.reduceat((count > 0)[tokens], first, dtype=np.int64)
                yield _rows([(block % buckets, block, DOCS, n_docs, [ids, train, _squeezed(lengths, np.int64), _squeezed(known, np.int64), _squeezed(base, np.float64)])], _PAIRS)
                doc = np.repeat(np.arange(n_docs), lengths)
                w, cw = number[tokens], count[tokens]
                v, cv = np.r_[BEGIN, w[:-1]], np.r_[begins, cw[:-1]]
                v[first], cv[first] = BEGIN, begins
                bucket = _bucket_of(v, w, cv >= hot_from, buckets)
                order = np.lexsort((doc, w, v, bucket))
                bucket, v, w, doc, cv, cw = (x[order] for x in (bucket, v, w, doc, cv, cw))
                fresh = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])])
                often = np.diff(np.r_[fresh, n]) * 2 + _unsqueezed(train, n_docs, np.uint8)[doc[fresh]]
                bucket, v, w, doc, cv, cw = (x[fresh] for x in (bucket, v, w, doc, cv, cw))
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)):
                    part = slice(edges[b], edges[b + 1])
                    at = np.flatnonzero(np.r_[True, v[part][1:] != v[part][:-1]])
                    contexts = np.diff(np.r_[at, edges[b + 1] - edges[b]])
                    yield _rows([(
                        int(b), block, PAIRS, int(edges[b + 1] - edges[b]),
                        [len(at).to_bytes(8, "little"), _squeezed(np.diff(v[part][at], prepend=0), np.int64), _squeezed(contexts, np.uint32), _squeezed(cv[part][at], np.int64),
                         _squeezed(w[part], np.int64), _squeezed(cw[part], np.int64), _squeezed(doc[part], np.uint32), _squeezed(often[part], np.uint32)],
                    )], _PAIRS)

    return ask


def _answer_pairs(unigrams: Unigrams, hot_from: int):
    """Counts of pairs and contexts of one bucket after another, and what each block's documents need of them."""

    def judged(rows):
        n = np.array([r[3] for r in rows])
        v, cv = [], []
        for r in rows:
            c = int.from_bytes(r[4][0], "little")
            contexts = _unsqueezed(r[4][2], c, np.uint32)
            v.append(np.repeat(np.cumsum(_unsqueezed(r[4][1], c, np.int64)), contexts))
            cv.append(np.repeat(_unsqueezed(r[4][3], c, np.int64), contexts))
        v, cv = np.concatenate(v), np.concatenate(cv)
        w, cw, doc, often = (np.concatenate([_unsqueezed(r[4][k], r[3], t) for r in rows]) for k, t in ((4, np.int64), (5, np.int64), (6, np.uint32), (7, np.uint32)))
        order = np.lexsort((w, v))
        v, w, cw, cv, doc, often = v[order], w[order], cw[order], cv[order], doc[order], often[order]
        which = np.repeat(np.arange(len(rows), dtype=np.int32), n)[order]
        del order
        train, often = (often & 1).astype(np.int32), (often >> 1).astype(np.int32)
        pair = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
        size = np.diff(np.r_[pair, len(v)])
        c = np.add.reduceat(often * train, pair, dtype=np.int64)
        del train
        start = np.flatnonzero(np.r_[True, v[pair][1:] != v[pair][:-1]])
        total = cv[pair][start]
        by_count = np.stack([np.add.reduceat((c == r).astype(np.int64), start) for r in range(1, K + 1)])
        above = np.add.reduceat(np.where(c > K, c, 0), start)
        mass = np.add.reduceat(np.where(c > 0, unigrams(cw[pair]), 0.0), start)
        hot = total >= hot_from
        total_of = total + (hot | (by_count.sum(axis=0) == 0))
        bucket = rows[0][0]
        stats = np.array([(c == r).sum() for r in range(1, K + 2)], np.int64)
        seen = c > 0
        yield _rows([(bucket, -1, STATS, int(seen.sum()), [
            stats.tobytes(), _squeezed(np.diff(v[pair][seen], prepend=0), np.int64), _squeezed(w[pair][seen], np.int64), _squeezed(c[seen], np.uint32),
        ])], _PAIRS)
        if hot.any():
            yield _rows([(bucket, -1, HOT, int(hot.sum()), [x.tobytes() for x in (v[pair][start][hot], total[hot], np.ascontiguousarray(by_count[:, hot]), above[hot], mass[hot])])], _PAIRS)
        context = np.repeat(np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.r_[start, len(pair)])), size)
        count = np.repeat(c, size)
        named = v[pair][start]
        del v, w, cv, pair, size, c, seen
        log = np.where(count > 0, np.log10(np.maximum(count, 1) / np.maximum(total_of[context], 1)), np.log10(unigrams(cw))) * often
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(len(rows) + 1))
        for k, r in enumerate(rows):
            own = order[edges[k] : edges[k + 1]]
            docs, at = np.unique(doc[own], return_inverse=True)
            parts = [np.bincount(at, log[own], len(docs))] + [np.bincount(at, often[own] * (count[own] == x), len(docs)) for x in range(1, K + 1)]
            yield _rows([(bucket, r[1], SCORES, len(docs), [_squeezed(docs, np.uint32), _squeezed(parts[0], np.float64), _squeezed(np.stack(parts[1:]), np.uint32)])], _PAIRS)
            own = own[(count[own] == 0) & (total[context[own]] > 0)]
            if len(own):
                used, at = np.unique(context[own], return_inverse=True)
                names = np.where(hot[used], named[used], -1)
                yield _rows([(bucket, r[1], UNSEEN, len(own), [
                    len(used).to_bytes(8, "little"), _squeezed(names, np.int64), _squeezed(total_of[used], np.int64), _squeezed(by_count[:, used], np.uint32),
                    _squeezed(above[used], np.int64), _squeezed(mass[used], np.float64), _squeezed(doc[own], np.uint32), _squeezed(at, np.uint32), _squeezed(often[own], np.uint32),
                ])], _PAIRS)

    def answer(batches):
        held: list = []
        for batch in batches:
            for r in W.each(batch):
                if r[2] == DOCS:
                    yield _rows([r], _PAIRS)
                    continue
                if held and r[0] != held[0][0]:
                    yield from judged(held)
                    held = []
                held.append(r)
        if held:
            yield from judged(held)

    return answer


def _backoff(total, by_count, above, mass, d):
    """Back-off weights of contexts: freed mass over the unigram mass of what never followed."""
    kept = above + (by_count * (d[1:, None] * np.arange(1, K + 1)[:, None])).sum(axis=0)
    return (1 - kept / total) / (1 - mass)


def _summed(d: np.ndarray, hot_names: np.ndarray, hot_weights: np.ndarray):
    kinds = {"_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def of(rows):
        (head,) = (r for r in rows if r[2] == DOCS)
        n = head[3]
        ids, train, lengths, known, base = (_unsqueezed(x, n, t) for x, t in zip(head[4], (np.int64, np.uint8, np.int64, np.int64, np.float64)))
        score = np.zeros(n)
        for r in rows:
            if r[2] == SCORES:
                docs = _unsqueezed(r[4][0], r[3], np.uint32)
                by_count = _unsqueezed(r[4][2], r[3] * K, np.uint32).reshape(K, -1)
                score[docs] += _unsqueezed(r[4][1], r[3], np.float64) + np.log10(d[1:]) @ by_count
            elif r[2] == UNSEEN:
                m = int.from_bytes(r[4][0], "little")
                named, total, by_count, above, mass = (_unsqueezed(x, m * k, t) for x, k, t in zip(r[4][1:6], (1, 1, K, 1, 1), (np.int64, np.int64, np.uint32, np.int64, np.float64)))
                weight = np.log10(_backoff(total, by_count.reshape(K, -1).astype(np.float64), above, mass, d), where=named < 0, out=np.zeros(m))
                if len(hot_names):
                    at = np.minimum(np.searchsorted(hot_names, named), len(hot_names) - 1)
                    weight = np.where(named >= 0, hot_weights[at], weight)
                doc, at, often = (_unsqueezed(x, r[3], np.uint32) for x in r[4][6:9])
                score += np.bincount(doc, weight[at] * often, n)
        return _rows(list(zip(ids, train == 0, lengths, known, base, score)), kinds)

    def total(batches):
        for rows in _by_bucket(batches, 1):
            yield of(rows)

    return total


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scored(docs: DataFrame, train: Column, hot_context: int = HOT_CONTEXT) -> tuple[DataFrame, int]:
    """``_id, held_out, n_tokens, n_known, base_score, score`` of every row of ``docs``, and the number of training tokens.

    The model learns from the rows where ``train`` holds. Scores are log10 probabilities of the whole text with its end.
    """
    spark = docs.sparkSession
    rows = W.keyed(docs, train.alias("train")).select("_text", "_id", "train")
    blocks = rows.mapInArrow(_blocks, _BLOCK_SQL)
    name, path = f"blocks_{uuid.uuid4().hex}", scratch_path(spark, "blocks")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bucketed by block, so that answers come to the blocks and not the other way round.
    blocks.write.bucketBy(partitions, "block").option("path", path).option("compression", "none").saveAsTable(name)
    blocks = spark.table(name)
    try:
        size = blocks.agg(F.sum("n_words").alias("words"), F.sum("n").alias("tokens"), F.sum("n_docs").alias("docs")).first()
        buckets = max(1, math.ceil((size.words or 0) / BUCKET_WORDS))
        asked = blocks.select("block", F.col("n_words").cast("int"), "words", "counts").mapInArrow(_ask_words(buckets), "bucket int, block long, n int, words binary, counts binary")
        answers = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket")
        answers = _stored(answers.mapInArrow(_answer_words(buckets), "block long, bucket int, n int, numbers binary, counts binary, stats array<bigint>"), "words")
        stats = [F.sum(F.get("stats", F.lit(k))) for k in range(K + 4)]
        total, distinct, *counts_of_counts, above = (int(x or 0) for x in answers.agg(*stats).first())
        unigrams = Unigrams(total, distinct, counts_of_counts, above)
        begins = rows.filter("train").select("train").count()
        hot_from = max(hot_context, total >> 18)
        buckets = max(1, math.ceil((size.tokens or 0) / BUCKET_PAIRS))
        own = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "numbers", "counts")).alias("answers"))
        ask = blocks.join(own, "block").select("block", "n_docs", "n", "n_words", "ids", "train", "lengths", "tokens", "answers")
        pairs = ask.mapInArrow(_ask_pairs(buckets, unigrams, begins, hot_from), _PAIRS_SQL).repartition(buckets, "bucket").sortWithinPartitions("bucket")
        events = _stored(pairs.mapInArrow(_answer_pairs(unigrams, hot_from), _PAIRS_SQL), "pairs")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    found = events.filter(F.col("kind") == STATS).select(F.get("columns", F.lit(0)).alias("counts")).collect()  # K + 1 numbers per bucket
    d = np.array(discounts([int(x) for x in np.sum([np.frombuffer(bytes(r.counts), np.int64) for r in found], axis=0)] if found else [0] * (K + 1)))
    names, weights = np.zeros(0, np.int64), np.zeros(0)
    parts = [[np.frombuffer(bytes(x), t) for x, t in zip(r.columns, (np.int64, np.int64, np.int64, np.int64, np.float64))] for r in events.filter(F.col("kind") == HOT).collect()]
    if parts:
        v = np.concatenate([p[0] for p in parts])
        names, at = np.unique(v, return_inverse=True)
        tot = np.zeros(len(names), np.int64)
        tot[at] = np.concatenate([p[1] for p in parts])
        by_count = np.stack([np.bincount(at, np.concatenate([p[2].reshape(K, -1)[r] for p in parts]), len(names)) for r in range(K)])
        above_, mass = (np.bincount(at, np.concatenate([p[k] for p in parts]), len(names)) for k in (3, 4))
        weights = np.log10(_backoff(tot + 1, by_count, above_, mass, d))
    by_block = events.filter(F.col("kind").isin(DOCS, SCORES, UNSEEN)).repartition("block").sortWithinPartitions("block")
    return by_block.mapInArrow(_summed(d, names, weights), "_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), total


@llm_query("op1_katz")
def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 10 != 0, F.lit(True))
    found, total = scored(table(spark, sf_dir, "documents"), train)
    return found.select(W.null_id("_id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
