"""Greedy threshold clustering, the tree built from it, and search in the tree.

Greedy assignment depends on order, so it runs in one place for as many vectors as one task should hold. Beyond that,
vectors are split into blocks of bounded size: similar ones meet by the signs of fixed random projections, and a crowded
cell is split further by id. Up to one block the result is the sequential one; beyond, each block is.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import vectors as vx
from weftline.operators.retrieval import centroids
from weftline.operators.sizing import BROADCAST_ROWS, small_or_shuffled
from weftline.session import cut_lineage

BLOCK_ROWS = 5_000
CHILDREN_FOLLOWED = 3
LEVEL_STEP = 10**15


def greedy(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster number per row: the first cluster whose current mean is similar enough, else a new one."""
    n, dim = vectors.shape
    sums, sizes, count = np.zeros((max(n, 1), dim)), np.zeros(max(n, 1)), 0
    lengths = np.linalg.norm(vectors, axis=1)
    out = np.empty(n, dtype=np.int64)
    for i in range(n):
        home = count
        if count:
            # The mean points where the sum points, so the sum decides the cosine.
            size = np.linalg.norm(sums[:count], axis=1) * lengths[i]
            sims = np.divide(sums[:count] @ vectors[i], size, out=np.zeros(count), where=size > 0)
            near = sims >= threshold
            if near.any():
                home = int(near.argmax())
        count = max(count, home + 1)
        sums[home] += vectors[i]
        sizes[home] += 1
        out[i] = home
    return out


def _with_blocks(df: DataFrame, rows: int, block_rows: int) -> DataFrame:
    """Add ``block``: 0 for a small input, else a projection cell, split by id where it is crowded."""
    if rows <= block_rows:
        return df.withColumn("block", F.lit(0).cast("bigint"))
    bits = math.ceil(math.log2(rows / block_rows))

    @F.pandas_udf("bigint")
    def cell(vectors: pd.Series) -> pd.Series:
        m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
        planes = np.random.RandomState(7).standard_normal((m.shape[1], bits))
        return pd.Series((m @ planes > 0) @ (1 << np.arange(bits)))

    celled = df.withColumn("_cell", cell("vec"))
    crowd = small_or_shuffled(celled.groupBy("_cell").agg(F.ceil(F.count("*") / block_rows).alias("_parts")), "cells")
    part = F.pmod(F.xxhash64("id"), F.col("_parts"))
    return celled.join(crowd, "_cell").withColumn("block", F.xxhash64("_cell", part)).drop("_cell", "_parts")


PLACED = "block bigint, parent bigint, child bigint, vec array<double>, centroid array<double>"


def cluster(df: DataFrame, threshold: float, rows: int, level: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(block, parent, child, vec, centroid)`` for ``df(id bigint, vec array<double>)``, taken in id order within a block.

    A parent is named after its level and its lowest member, whose row carries the centroid.
    """

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        vectors = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]])
        homes = greedy(vectors, threshold)
        _, heads = np.unique(homes, return_index=True)
        ids = pdf["id"].to_numpy()
        means: list = [None] * len(pdf)
        for home, head in enumerate(heads):
            means[head] = vectors[homes == home].mean(axis=0)
        return pd.DataFrame({"block": pdf["block"], "parent": ids[heads][homes] % LEVEL_STEP + level * LEVEL_STEP, "child": ids, "vec": pdf["vec"], "centroid": means})

    blocked = _with_blocks(df.select("id", "vec"), rows, block_rows)
    return blocked.groupBy("block").applyInPandas(assign, PLACED)


def build_tree(df: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``nodes(id, level, vec)`` and ``edges(parent, child, level)`` from ``df(id bigint, vec array<double>)``.

    Leaves keep their ids at level 0. Clusters become parents level by level until one is left; when nothing merges, one
    root covers the whole level. Every level is stored, so losing an executor repeats one level at most.
    """
    current = cut_lineage(df.select("id", F.lit(0).alias("level"), F.transform("vec", lambda x: x.cast("double")).alias("vec")), "level0")
    nodes, edges, level, rows = [current], [], 0, current.count()
    while rows > 1:
        level += 1
        placed = cut_lineage(cluster(current, threshold, rows, level, block_rows), f"placed{level}")
        heads = placed.filter(F.col("centroid").isNotNull())
        groups = heads.count()
        current = heads.select(F.col("parent").alias("id"), F.lit(level).alias("level"), F.col("centroid").alias("vec"))
        if groups == rows:
            placed = placed.withColumn("parent", F.lit(level * LEVEL_STEP))
            root = centroids(placed, "parent", "vec").select(F.col("parent").alias("id"), F.lit(level).alias("level"), F.col("centroid").alias("vec"))
            current, groups = cut_lineage(root, "root"), 1
        nodes.append(current)
        edges.append(placed.select("parent", "child", F.lit(level).alias("level")))
        rows = groups
    if not edges:
        edges = [current.select(F.col("id").alias("parent"), F.col("id").alias("child"), "level").filter(F.lit(False))]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def with_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parent id and number of children for every node; the root has no parent."""
    counts = edges.groupBy("parent").agg(F.count("*").alias("children"))
    return (nodes.select("id", "level").join(edges.select(F.col("child").alias("id"), "parent"), "id", "left")
            .join(counts.withColumnRenamed("parent", "id"), "id", "left").select("id", "level", "parent", F.coalesce("children", F.lit(0)).alias("children")))


def tree_search(nodes: DataFrame, edges: DataFrame, queries: dict[int, list[float]], k: int) -> DataFrame:
    """``(query_id, id, similarity)`` found by following the three most similar children of every node.

    Nodes are met breadth first, so the leaves reached first are those with the lowest path of child ranks; the search
    stops once it has ``3 * k`` of them.
    """
    spark = nodes.sparkSession
    top = nodes.agg(F.max("level")).collect()[0][0]
    if top is None:
        return spark.createDataFrame([], "query_id bigint, id bigint, similarity double")
    asked = F.create_map(*[x for q, v in queries.items() for x in (F.lit(q).cast("bigint"), F.lit([float(y) for y in v]))])
    frontier = nodes.filter(F.col("level") == top).select(
        F.explode(F.array(*[F.lit(q).cast("bigint") for q in queries])).alias("query_id"), F.col("id"), F.lit("").alias("path"), "vec")
    frontier = frontier.withColumn("similarity", vx.cosine(F.col("vec"), asked[F.col("query_id")])).drop("vec")
    for level in range(top, 0, -1):
        here = frontier.select("query_id", F.col("id").alias("parent"), "path")
        # The frontier grows threefold per level at most, which bounds it before anything runs.
        if len(queries) * CHILDREN_FOLLOWED ** (top - level) <= BROADCAST_ROWS:
            here = F.broadcast(here)
        below = edges.filter(F.col("level") == level).join(here, "parent").withColumnRenamed("child", "id")
        scored = nodes.filter(F.col("level") == level - 1).select("id", "vec").join(below, "id")
        scored = scored.withColumn("similarity", vx.cosine(F.col("vec"), asked[F.col("query_id")])).drop("vec")
        rank = F.row_number().over(W.partitionBy("query_id", "parent").orderBy(F.desc("similarity"), "id"))
        kept = scored.withColumn("_r", rank).filter(F.col("_r") <= CHILDREN_FOLLOWED)
        frontier = kept.select("query_id", "id", F.concat("path", F.col("_r").cast("string")).alias("path"), "similarity")
    reached = frontier.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("path"))).filter(F.col("_n") <= 3 * k)
    final = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return reached.withColumn("_r", final).filter(F.col("_r") <= k).select("query_id", "id", "similarity")
