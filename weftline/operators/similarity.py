"""Fuzzy lookup of texts in a bounded cache of known texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as tx
from weftline.operators.rows import unnest


def token_set(text: Column) -> Column:
    """Distinct words of the normalised text; a blank text is the set of the empty word."""
    return F.array_distinct(F.split(tx.normalise(text), " "))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def prefix(tokens: Column, threshold: float) -> Column:
    """Hashes of which two sets of at least ``threshold`` similarity must share one.

    Both sides order tokens alike, long words first as they are rare; the leading n - ceil(threshold * n) + 1 must meet.
    """
    ordered = F.sort_array(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), F.xxhash64(t).alias("h"))))
    n = F.size(tokens)
    return F.transform(F.slice(ordered, 1, (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")), lambda s: s["h"])


def cached_texts(df: DataFrame, key: str, text: str, capacity: int | None) -> DataFrame:
    """What an LRU cache of ``capacity`` (none: no bound) holds after ``df`` was inserted in ``key`` order."""
    last = df.groupBy(tx.normalise(F.col(text)).alias("cached")).agg(F.max(key).alias("cached_id"))
    return last if capacity is None else last.orderBy(F.desc("cached_id")).limit(capacity)


def fuzzy_lookup(queries: DataFrame, key: str, text: str, cache: DataFrame, threshold: float = fixed.FUZZY_THRESHOLD) -> DataFrame:
    """Best cached text per query: the same text first, then highest Jaccard, then most recent.

    Candidates meet on prefix hashes only, by a join whose kind is left to the planner.
    """
    side = cache.select("cached_id", "cached", F.split("cached", " ").alias("_all")).select(
        "cached_id", "cached", F.array_distinct("_all").alias("cached_tokens"))
    side = unnest(side, ["cached_id", "cached", "cached_tokens"], prefix(F.col("cached_tokens"), threshold), "_h")
    asked = queries.select(key, tx.normalise(F.col(text)).alias("query")).withColumn("tokens", F.array_distinct(F.split("query", " ")))
    asked = unnest(asked, [key, "query", "tokens"], prefix(F.col("tokens"), threshold), "_h")
    # Similar sets also have similar sizes.
    sizes = (F.size("tokens") >= F.size("cached_tokens") * threshold) & (F.size("cached_tokens") >= F.size("tokens") * threshold)
    met = asked.join(side, "_h").filter(sizes)
    scored = met.withColumn("similarity", jaccard(F.col("tokens"), F.col("cached_tokens"))).filter(F.col("similarity") >= threshold)
    best = F.max_by(F.struct("cached_id", "similarity"), F.struct(F.col("query") == F.col("cached"), "similarity", "cached_id"))
    return scored.groupBy(key).agg(best.alias("_best")).select(key, "_best.*")
