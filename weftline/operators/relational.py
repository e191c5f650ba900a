"""Keyed-table maintenance: every change is a new version computed from the old one and a delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replaced: list[str]) -> DataFrame:
    """Insert new keys; for known keys take ``replaced`` from ``new`` and keep the other columns."""
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in old.columns if c not in keys], F.lit(True).alias("_hit"))
    joined = old.withColumn("_kept", F.lit(True)).join(fresh, keys, "full_outer")
    cols = []
    for c in old.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in replaced:
            cols.append(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.when(F.col("_kept"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c))
    return joined.select(*cols)


def accumulate(old: DataFrame, delta: DataFrame, keys: list[str], totals: list[str]) -> DataFrame:
    """total = total + delta, one row per key; partial sums are combined before the shuffle."""
    return old.select(*keys, *totals).unionByName(delta.select(*keys, *totals)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in totals])


def add_to(old: DataFrame, delta: DataFrame, keys: list[str], total: str) -> DataFrame:
    """UPDATE total = total + delta for known keys only."""
    sums = delta.groupBy(*keys).agg(F.sum(total).alias("_add"))
    return old.join(sums, keys, "left").withColumn(total, F.col(total) + F.coalesce(F.col("_add"), F.lit(0))).select(*old.columns)


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row per key by ``order``, with map-side reduction."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*")


def delete_cascade(parent_keys_gone: DataFrame, child: DataFrame, key: str) -> DataFrame:
    return child.join(parent_keys_gone.select(key).distinct(), key, "left_anti")


def set_null(gone: DataFrame, child: DataFrame, key: str) -> DataFrame:
    marked = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return child.join(marked, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*child.columns)


def alive(expires_at: Column, as_of: Column) -> Column:
    """Not expired: no expiry, or not yet past it."""
    return expires_at.isNull() | (as_of <= expires_at)


def lru_survivors(accesses: DataFrame, key: str, at: list[str], capacity: int) -> DataFrame:
    """Keys an LRU cache of ``capacity`` holds after all accesses."""
    last = accesses.groupBy(key).agg(F.max(F.struct(*at)).alias("last_access"))
    return last.orderBy(F.desc("last_access")).limit(capacity)


def last_n(df: DataFrame, keys: list[str], order: Column, n: int) -> DataFrame:
    """The last ``n`` rows per key; Spark trims each input partition to ``n`` per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """added / modified (strictly newer) / deleted keys between two snapshots."""
    a = old.select(key, F.col(version).alias("_old"))
    b = new.select(key, F.col(version).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_new") > F.col("_old"), "modified")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter(F.col("change").isNotNull())


def hash_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys of ``new`` whose content hash differs or is unknown."""
    known = old.select(key, F.col(digest).alias("_old"))
    return new.join(known, key, "left").filter(~F.col(digest).eqNullSafe(F.col("_old"))).drop("_old")
