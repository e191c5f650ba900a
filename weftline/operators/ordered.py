"""Ordered calculations over long per-key histories.

One key may own a third of all rows, so a plain window per key would put them in one task. Each calculation here first
works inside (key, time bucket), then carries totals between the few buckets of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


BUCKET_ROWS = 1_000_000
UNITS = ("day", "hour", "minute", "second", "millisecond", "microsecond")


def time_bucket(df: DataFrame, keys: list[str], ts: str, most: int = BUCKET_ROWS) -> Column:
    """The coarsest time unit in which no key has more than ``most`` rows, so that no bucket grows with the data."""
    for unit in UNITS[:-1]:
        crowd = df.groupBy(*keys, F.date_trunc(unit, ts).alias("_unit")).count().agg(F.max("count")).collect()[0][0]
        if (crowd or 0) <= most:
            return F.date_trunc(unit, ts)
    return F.date_trunc(UNITS[-1], ts)


def consecutive_runs(df: DataFrame, keys: list[str], order: list[str], bucket: Column, hit: Column) -> DataFrame:
    """Add ``run``: how many rows up to this one satisfied ``hit`` without a break; 0 on a row that breaks it.

    ``bucket`` must not decrease along ``order``.
    """
    part = [*keys, "_bucket"]
    local = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = df.withColumn("_bucket", bucket).withColumn("_hit", hit.cast("long"))
    marked = marked.withColumn("_hits", F.sum("_hit").over(local))
    marked = marked.withColumn("_break", F.max(F.when(F.col("_hit") == 0, F.col("_hits"))).over(local))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        marked.groupBy(*part)
        .agg(F.sum("_hit").alias("_total"), F.max("_break").alias("_last_break"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .withColumn("_carry", F.max(F.col("_offset") + F.col("_last_break")).over(earlier))
        .select(*part, "_offset", "_carry")
    )
    since = F.coalesce(F.col("_offset") + F.col("_break"), F.col("_carry"), F.lit(0))
    run = F.when(F.col("_hit") == 1, F.col("_offset") + F.col("_hits") - since).otherwise(F.lit(0))
    return marked.join(carried, part).withColumn("run", run.cast("bigint")).select(*df.columns, "run")


def running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Add the running sum of ``value`` along ``order``, this row included."""
    part = [*keys, "_bucket"]
    local = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = df.withColumn("_bucket", bucket).withColumn("_value", value)
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        marked.groupBy(*part).agg(F.sum("_value").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .select(*part, "_offset")
    )
    summed = marked.withColumn("_local", F.sum("_value").over(local)).join(carried, part)
    return summed.withColumn(name, F.col("_offset") + F.col("_local")).select(*df.columns, name)
