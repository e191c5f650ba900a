"""Token ids in block files under one canonical, length-limited Huffman code.

A written set is a folder of two Parquet tables, so any store Spark reaches will do:

* ``codebook``: ``id, bits`` (length of the id's code). Codes follow canonically from the lengths.
* ``blocks``: one row per block of whole documents in ascending doc_id order: ``file_no, block_no`` (their order), ``n_ids``,
  ``doc_ids, doc_nulls, doc_lengths`` (of its documents), ``checkpoints`` (bits used by every ``CHECKPOINT`` ids, 16-bit) and
  ``payload`` (codes, highest bit first).

The code lengths come from the counts of all ids by package-merge, so they are optimal under the limit. A block is decoded by
itself: one table of ``2**limit`` entries answers id and length for the next bits, and all checkpoints of a block are read
forward side by side.

Defined cases: a null text is empty and holds the end id alone; null doc_ids come first; rows of one doc_id come in the order
of their texts' hash; an empty table gives an empty set. Other columns of the input are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.registry import llm_query
from weftline.llm.tokens import TOKENIZER, encoder, forget, id_blobs
from weftline.session import scratch_path, small_batches
from weftline.sources.tables import table

LIMIT = 16
BLOCK_IDS = 1 << 16
CHECKPOINT = 64
FILE_BYTES = 32 << 20
END_ID = 2


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive ``counts`` (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.uint8)
    limit = max(limit, math.ceil(math.log2(n)))
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64 if counts.sum() > 1 << 62 else np.int64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.r_[leaves, pairs]
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        used = int(flags[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.zeros(n, np.uint8)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: shorter first, then by id."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        ids, bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.limit = int(bits.max(initial=1))
        step = np.left_shift(1, self.limit - bits)
        first = np.cumsum(step) - step
        size = int(ids.max(initial=0)) + 1
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[ids], self.bits[ids] = (first >> (self.limit - bits)).astype(np.uint64), bits
        self.id_at, self.bits_at = np.repeat(ids, step).astype(np.uint32), np.repeat(bits, step).astype(np.int64)
        short = (1 << self.limit) - len(self.id_at)
        if short:  # a lone id uses half of the codes
            self.id_at, self.bits_at = np.r_[self.id_at, np.zeros(short, np.uint32)], np.r_[self.bits_at, np.ones(short, np.int64)]

    def encoded(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload and checkpoints of one block."""
        bits = self.bits[ids]
        end = np.cumsum(bits)
        at = end - bits
        word, room = at >> 6, 64 - (at & 63) - bits
        code = self.code[ids]
        own = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        out = np.zeros(int(end[-1] >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] = np.add.reduceat(own, first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
        marks = np.diff(np.r_[at[::CHECKPOINT], end[-1]]).astype("<u2" if self.limit * CHECKPOINT < 1 << 16 else "<u4")
        return out.astype(">u8").tobytes()[: int(end[-1] + 7) // 8], marks.tobytes()

    def decoded(self, payload: bytes, marks: bytes, n: int) -> np.ndarray:
        lanes = -(-n // CHECKPOINT)
        marks = np.frombuffer(marks, "<u2" if self.limit * CHECKPOINT < 1 << 16 else "<u4").astype(np.int64)
        at = np.cumsum(marks) - marks
        raw = np.zeros(len(payload) + 8 + self.limit * CHECKPOINT // 8, np.int64)
        raw[: len(payload)] = np.frombuffer(payload, np.uint8)
        four = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out, shift, mask = np.empty((CHECKPOINT, lanes), np.uint32), 32 - self.limit, (1 << self.limit) - 1
        last = len(four) - 1
        for k in range(CHECKPOINT):
            peek = four[np.minimum(at >> 3, last)] >> (shift - (at & 7)) & mask
            out[k] = self.id_at[peek]
            at += self.bits_at[peek]
        return out.T.ravel()[:n]


def _tokenized(path: str, end_id: int, splits: list[int]):
    edges = np.array(splits, np.int64)

    def tokenize(batches):
        own = encoder(path)
        for batch in batches:
            docs = batch.column(0)
            file_no = np.searchsorted(edges, docs.fill_null(0).to_numpy(), "right").astype(np.int32)
            file_no[docs.is_null().to_numpy(zero_copy_only=False)] = 0
            for a, b, ids, at in own.encode_column(batch.column(2), end_id):
                if ids.max(initial=0) < 1 << 16:
                    ids = ids.astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file_no[a:b]), docs.slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(at).astype(np.int32)), id_blobs(ids, at)],
                    names=["file_no", "doc_id", "th", "n", "ids"],
                )

    return tokenize


_BLOCK = {"file_no": pa.int32(), "block_no": pa.int32(), "n_ids": pa.int64(), "doc_ids": pa.binary(), "doc_nulls": pa.binary(), "doc_lengths": pa.binary(), "ids": pa.binary()}


def _blocked(block_ids: int):
    def block(batches):
        forget()
        held, n, file_no, block_no = [], 0, None, 0

        def sent():
            ids = np.concatenate([_ids(x[2], x[1]) for x in held])
            row = (
                file_no, block_no, len(ids), np.array([x[0] or 0 for x in held], "<i8").tobytes(), np.array([x[0] is None for x in held]).tobytes(),
                np.array([x[1] for x in held], "<u4").tobytes(), ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes(),
            )
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _BLOCK.values())], names=list(_BLOCK))

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 3)]
            for f, doc, size, blob in zip(*columns, batch.column(4)):
                if held and (f != file_no or n >= block_ids):
                    yield sent()
                    block_no, held, n = (block_no + 1 if f == file_no else 0), [], 0
                file_no = f
                held.append((doc, size, blob.as_py()))
                n += size
        if held:
            yield sent()

    return block


def _ids(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4")


def _counted(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.bincount(_ids(blob, n))
            if len(own) > len(total):
                own, total = total, own.astype(np.int64)
            total[: len(own)] += own
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def _encoded(codebook: Codebook):
    names = [*list(_BLOCK)[:6], "checkpoints", "payload"]

    def encode(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                payload, marks = codebook.encoded(_ids(row.column(6)[0].as_py(), row.column(2)[0].as_py()).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*row.columns[:6], pa.array([marks], pa.binary()), pa.array([payload], pa.binary())], names=names)

    return encode


def _decoded(codebook: Codebook):
    names = ["file_no", "block_no", "before", "doc_id", "n_tokens", "ids_crc32", "ids"]

    def decode(with_ids, batches):
        for batch in batches:
            for f, b, n, docs, nulls, lengths, marks, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ids = codebook.decoded(payload, marks, n)
                lengths = np.frombuffer(lengths, "<u4").astype(np.int64)
                end = np.cumsum(lengths)
                parts = [ids[y - x : y].astype("<u4").tobytes() for x, y in zip(lengths, end)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(end), f, np.int32)), pa.array(np.full(len(end), b, np.int32)), pa.array(end - lengths),
                        pa.array(np.frombuffer(docs, "<i8"), mask=np.frombuffer(nulls, bool)), pa.array(lengths), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                        pa.array(parts if with_ids else [None] * len(parts), pa.binary()),
                    ],
                    names=names,
                )

    return decode


def write_ids(docs: DataFrame, path: str, end_id: int = END_ID, tokenizer: str = TOKENIZER, limit: int = LIMIT, file_bytes: int = FILE_BYTES, block_ids: int = BLOCK_IDS) -> None:
    """Tokenize every text of ``docs`` and write the ids as a set of block files under ``path``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    files = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / file_bytes))
    # Few enough split points to travel with each task; they follow the size of the input over that of a file.
    splits = []
    if files > 1:
        splits = rows.select(F.percentile_approx("doc_id", [k / files for k in range(1, files)], max(10_000, 20 * files))).first()[0] or []
    tokenized = rows.mapInArrow(_tokenized(tokenizer, end_id, sorted(set(splits))), "file_no int, doc_id long, th long, n int, ids binary")
    ordered = tokenized.repartition(files, "file_no").sortWithinPartitions("file_no", F.col("doc_id").asc_nulls_first(), "th")
    held = scratch_path(spark, "id-blocks")
    with small_batches(spark):
        ordered.mapInArrow(_blocked(block_ids), "file_no int, block_no int, n_ids long, doc_ids binary, doc_nulls binary, doc_lengths binary, ids binary").write.option("compression", "zstd").parquet(held)
    blocks = spark.read.schema("file_no int, block_no int, n_ids long, doc_ids binary, doc_nulls binary, doc_lengths binary, ids binary").parquet(held)
    counts = blocks.select("n_ids", "ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    with small_batches(spark):
        counted = counts.orderBy("id").collect()  # no more rows than the vocabulary has
    ids, n = np.array([r.id for r in counted], np.int64), np.array([r.n for r in counted], np.int64)
    bits = code_lengths(n, limit)
    spark.createDataFrame([(int(i), int(b)) for i, b in zip(ids, bits)], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    schema = "file_no int, block_no int, n_ids long, doc_ids binary, doc_nulls binary, doc_lengths binary, checkpoints binary, payload binary"
    with small_batches(spark):
        blocks.mapInArrow(_encoded(Codebook(ids, bits)), schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32, ids`` of a written set."""
    book = spark.read.parquet(f"{path}/codebook").collect()
    codebook = Codebook(np.array([r.id for r in book], np.int64), np.array([r.bits for r in book], np.int64))
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("file_no", "block_no", "n_ids")
    per_file = sizes.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    # One row per file meets in this window, nothing per document or block.
    per_file = per_file.select("file_no", (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("files_before"))
    in_file = Window.partitionBy("file_no").orderBy("block_no")
    places = sizes.withColumn("blocks_before", F.sum("n_ids").over(in_file) - F.col("n_ids")).join(per_file, "file_no")
    places = places.select("file_no", "block_no", (F.col("files_before") + F.col("blocks_before")).alias("ahead"))
    decode = _decoded(codebook)
    found = blocks.mapInArrow(lambda batches: decode(with_ids, batches), "file_no int, block_no int, before long, doc_id long, n_tokens long, ids_crc32 long, ids binary")
    return found.join(places, ["file_no", "block_no"]).select("doc_id", (F.col("before") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32", "ids")


@llm_query("op10_huffman")
def op10_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "huffman")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path, with_ids=False).drop("ids")
