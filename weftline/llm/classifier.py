"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text are its words and word pairs, and the same one, two and three at a time with each word reduced to its shape
(kind of its first and last character, all capitals, length, whether it repeats the word before it). Each is hashed to one of
``2**BITS`` weights. A family's features are weighted by their share of the text, so the score of a text is a bias plus the
mean weight of its features in each family: a sparse dot product that needs no grouping, whatever the text's length.

Training learns from at most ``max_rows`` labelled rows, those with the smallest hash of doc_id; this bound is a parameter. One
task makes the updates, which depend on each other, over rows that stream by in a fixed order. Scoring covers all rows, each
where it is read; only the weights, of fixed size, travel.

Defined cases: a null text is empty, and an empty text is scored by the bias; labels that are null or other than 0 and 1 are
left out; several labels of one document each count; without labels every score is 0.5. Columns other than doc_id and text
are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import words as W
from weftline.llm.registry import llm_query
from weftline.llm.tokens import forget
from weftline.session import small_batches
from weftline.sources.tables import table

BITS = 18
MAX_ROWS = 20_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.001, 0.001
GAIN = 6.0

# Kinds of bytes: 0 other, 1 lower case, 2 capital, 3 digit, 4 sentence mark, 5 symbol, 6 part of a longer character.
_KIND = np.zeros(256, np.int64)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 3, 6
_KIND[np.frombuffer(b".,;:?'\"()-", np.uint8)] = 4
_KIND[np.frombuffer(b"!#$%&*+/<=>@[\\]^_`{|}~", np.uint8)] = 5


def features(data: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per family: index of the weight of each feature, and the number of features before each row (one more for the end)."""
    begin, end, before = W.spans(data, starts)
    sums = W.prefix_sums(data)
    word = W.word_hash(data, begin, end, sums)
    kind = _KIND[data]
    small = np.r_[0, np.cumsum(kind == 1)]
    big = np.r_[0, np.cumsum(kind == 2)]
    same = np.r_[False, word[1:] == word[:-1]] if len(word) else np.zeros(0, bool)
    same[before[:-1][before[:-1] < len(same)]] = False
    shouted = (big[end] - big[begin] > 1) & (small[end] == small[begin])
    length = np.minimum(end - begin, 24) // 6
    shape = (((kind[begin] * 8 + kind[end - 1]) * 2 + shouted) * 2 + same) * 8 + length if len(begin) else begin
    shape = W.mixed(shape.astype(np.uint64) + np.uint64(1))
    out = []
    for hashes, size, seed in ((word, 1, 11), (word, 2, 13), (shape, 1, 17), (shape, 2, 19), (shape, 3, 23)):
        index, h = W.windows(hashes, before, size, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        out.append(((W.mixed(h + np.uint64(seed)) >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(index, before)))
    return out


def _sparse(batches):
    """Index and value of the features of each row."""
    forget()
    for batch in batches:
        indexes, values = [], []
        for a, b, data, starts in W.chunks(batch.column(2)):
            families = features(data, starts)
            for k in range(b - a):
                parts, weights = [], []
                for index, before in families:
                    own = index[before[k] : before[k + 1]]
                    parts.append(own)
                    weights.append(np.full(len(own), GAIN / max(len(own), 1)))
                index, where = np.unique(np.concatenate(parts), return_inverse=True)
                indexes.append(index.astype("<i4").tobytes())
                values.append(np.bincount(where, np.concatenate(weights), len(index)).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(indexes, pa.binary()), pa.array(values, pa.binary())], names=["at", "quality", "indexes", "values"])


def _trained(batches):
    """One pass of updates over all rows in order; the last weight is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for batch in batches:
        for y, index, value in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            i = np.r_[np.frombuffer(index.as_buffer(), "<i4"), 1 << BITS]
            x = np.r_[np.frombuffer(value.as_buffer(), "<f4"), 1.0]
            w = weight(z[i], n[i])
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    yield pa.RecordBatch.from_arrays([pa.array([weight(z, n).astype("<f4").tobytes()], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learned from ``labels (doc_id, quality)`` and their texts in ``docs``."""
    own = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id", "quality").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(own), "doc_id").select("at", "quality", "text")  # at most max_rows small rows travel
    sparse = rows.mapInArrow(_sparse, "at long, quality int, indexes binary, values binary")
    again = sparse.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    ordered = again.repartition(1).sortWithinPartitions("epoch", "at", "quality").select("quality", "indexes", "values")
    with small_batches(docs.sparkSession):
        found = ordered.mapInArrow(_trained, "weights binary").collect()
    return np.frombuffer(bytes(found[0].weights), "<f4").astype(np.float64) if found else np.zeros((1 << BITS) + 1)


def _scored(weights: np.ndarray, names: list[str]):
    def score(batches):
        forget()
        for batch in batches:
            for a, b, data, starts in W.chunks(batch.column("text")):
                total = np.full(b - a, weights[-1])
                for index, before in features(data, starts):
                    own = np.r_[0.0, np.cumsum(weights[index])]
                    total += GAIN * (own[before[1:]] - own[before[:-1]]) / np.maximum(np.diff(before), 1)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], names=[*names, "score"])

    return score


def scored(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``score`` (0 to 1, higher is better) of every row of ``docs``."""
    kept = docs.select(*keep)
    rows = kept if "text" in keep else docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return rows.mapInArrow(_scored(weights, list(keep)), f"{schema}, score double")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds, F.lit(0))


@llm_query("op8_classifier")
def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 3) != 1)
    found = scored(docs, train(docs, labels))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
