"""Exact vector search, BM25 and their combination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as tx
from weftline.functions import vectors as vx
from weftline.operators.rows import worked_out

BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.2, 0.75, 1e-6


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as a matrix, with zero rows (and a mask) where the length differs."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    good = sizes == dim
    if good.all():
        return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim), good
    out = np.zeros((len(column), dim))
    out[good] = np.asarray(column.filter(pa.array(good)).flatten(), dtype=np.float64).reshape(-1, dim)
    return out, good


def _scores(column: pa.Array, wanted: np.ndarray) -> np.ndarray:
    rows, good = _matrix(column, wanted.shape[1])
    size = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(wanted, axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((size == 0) | ~good[:, None], 0.0, (rows @ wanted.T) / size)


def _search(df: DataFrame, key: str, vector: str, queries: dict[int, list[float]], pick) -> DataFrame:
    """Score every vector against a few query vectors inside the scan; ``pick`` decides what leaves a batch."""
    names, wanted = list(queries), np.asarray(list(queries.values()), dtype=np.float64)
    out = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pick(((np.asarray(b.column(0)), _scores(b.column(1), wanted)) for b in batches if b.num_rows), names, out)

    return df.select(F.col(key).cast("bigint").alias(key), vector).mapInArrow(run, f"query_id bigint, {key} bigint, similarity double")


def top_k(df: DataFrame, key: str, vector: str, queries: dict[int, list[float]], k: int) -> DataFrame:
    """The ``k`` most similar rows per query, ties by key.

    Each task keeps only its own best ``k`` per query, so at most tasks * queries * k rows are shuffled.
    """

    def pick(scored, names, schema):
        best = {q: (np.empty(0, dtype=np.int64), np.empty(0)) for q in range(len(names))}
        for ids, sims in scored:
            for q in best:
                keep_ids, keep = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], sims[:, q]])
                if len(keep) > k:
                    floor = np.partition(keep, len(keep) - k)[len(keep) - k]
                    near = keep >= floor
                    keep_ids, keep = keep_ids[near], keep[near]
                order = np.lexsort((keep_ids, -keep))[:k]
                best[q] = (keep_ids[order], keep[order])
        for q, (ids, sims) in best.items():
            if len(ids):
                yield pa.record_batch([pa.array(np.full(len(ids), names[q])), pa.array(ids), pa.array(sims)], schema=schema)

    found = _search(df, key, vector, queries, pick)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def above(df: DataFrame, key: str, vector: str, queries: dict[int, list[float]], threshold: float) -> DataFrame:
    """Every row at least ``threshold`` similar to a query."""

    def pick(scored, names, schema):
        for ids, sims in scored:
            rows, cols = np.nonzero(sims >= threshold)
            if len(rows):
                yield pa.record_batch([pa.array(np.asarray(names)[cols]), pa.array(ids[rows]), pa.array(sims[rows, cols])], schema=schema)

    return _search(df, key, vector, queries, pick)


def query_vectors(df: DataFrame, key: str, vector: str, keys: list[int]) -> dict[int, list[float]]:
    """The vectors of a few named rows, as search arguments."""
    return {r[0]: list(r[1]) for r in df.filter(F.col(key).isin(keys)).select(key, vector).collect()}


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean per key, combined before the shuffle."""
    cells = df.select(key, F.posexplode_outer(vector).alias("pos", "value")).filter(F.col("pos").isNotNull())
    means = cells.groupBy(key, "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("centroid"))


def bm25(docs: DataFrame, key: str, text: Column, terms: list[str]) -> DataFrame:
    """``(key, rank)`` of documents that hold every term; lower is better, as full-text rank is.

    One pass gives document count, mean length and term frequencies, one pass scores; no postings are shuffled.
    """
    names = [f"_tf{i}" for i in range(len(terms))]

    def frequency(tokens, word):
        return F.size(tokens) - F.size(F.array_remove(tokens, word))

    def counts(tokens):
        return F.struct(F.size(tokens).alias("dl"), *[frequency(tokens, w).alias(n) for n, w in zip(names, terms)])

    counted = worked_out(docs, [key], tx.let(tx.terms(text), counts), "_c").select(key, "_c.*")
    stats = counted.agg(F.struct(
        F.count("*").alias("docs"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(n) > 0).alias(n) for n in names])).scalar()
    held = counted.filter(" AND ".join(f"{n} > 0" for n in names)).withColumn("_s", stats)
    score = F.lit(0.0)
    for n in names:
        df_n, docs_n = F.col(f"_s.{n}"), F.col("_s.docs")
        idf = F.greatest(F.log((docs_n - df_n + 0.5) / (df_n + 0.5)), F.lit(BM25_IDF_FLOOR))
        tf = F.col(n)
        score = score + idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("_s.avgdl")))
    return held.select(key, (-score).alias("rank"))


def candidates(docs: DataFrame, key: str, text: Column, terms: list[str], limit: int = fixed.CANDIDATES) -> DataFrame:
    return bm25(docs, key, text, terms).orderBy("rank", key).limit(limit)


def hybrid(docs: DataFrame, key: str, text: Column, embeddings: DataFrame, emb_key: str, vector: str, terms: list[str], limit: int,
           threshold: float | None = fixed.SIMILARITY_THRESHOLD, query_vector: list[float] | None = None) -> DataFrame:
    """BM25 candidates re-ranked by cosine; without candidates, every vector is scored.

    Without ``query_vector`` the vector of the best candidate that has one stands in for it.
    """
    found = candidates(docs, key, text, terms)
    scored = embeddings.join(F.broadcast(found), F.col(emb_key) == F.col(key)).select(key, "rank", F.col(vector).alias("_v"))
    if query_vector is None:
        asked = scored.orderBy("rank", key).limit(1).select("_v").scalar()
    else:
        asked = F.lit([float(x) for x in query_vector])
        every = embeddings.filter(found.agg(F.count("*")).scalar() == 0)
        scored = scored.unionByName(every.select(F.col(emb_key).alias(key), F.lit(None).cast("double").alias("rank"), F.col(vector).alias("_v")))
    result = scored.withColumn("_q", asked).select(key, "rank", vx.cosine(F.col("_v"), F.col("_q")).alias("similarity"))
    if threshold is not None:
        result = result.filter(F.col("similarity") >= threshold)
    return result.orderBy(F.desc("similarity"), key).limit(limit)


def term_table(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """``(key, term, tf, dl)``: each text's terms, how often they come, and the text's length in terms."""
    counted = worked_out(docs, [key], tx.terms(text), "_t").withColumn("dl", F.size("_t"))
    return counted.select(key, "dl", F.explode("_t").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def hashed_place(term: Column) -> tuple[Column, Column]:
    """Dimension and sign of a term."""
    code = F.md5(term.cast("binary"))
    return F.conv(F.substring(code, 1, 2), 16, 10).cast("int") % 64, F.when(F.substring(code, 3, 1) < "8", 1).otherwise(-1)


def term_vector(rows: DataFrame, key: str, weight: Column) -> DataFrame:
    """``(key, dim, v)`` by signed hashing of terms: the offline stand-in for a model, of texts and questions alike."""
    dim, sign = hashed_place(F.col("term"))
    return rows.groupBy(key, dim.alias("dim")).agg(F.sum(sign * weight).alias("v"))
