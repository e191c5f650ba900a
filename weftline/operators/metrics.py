"""Counters, nearest-rank percentiles and regression status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.sizing import BROADCAST_ROWS, stored_and_counted

PROBE_WIDTH = 0.0005
PROBE_ACCURACY = 10_000


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def nearest_rank(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles: the sample at index min(floor(n * p), n - 1) of the sorted samples.

    No group is sorted whole. A quantile sketch brackets every point; exact counts per bracket tell which bracket holds
    the wanted index; only rows of those brackets are ranked, after folding equal values. The sketch decides how much
    work is left, never the answer.
    """
    group = keys or ["_all"]
    data = df.withColumn("_all", F.lit(0)) if not keys else df
    data = data.select(*group, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    probes = sorted({min(1.0, max(0.0, p + s * PROBE_WIDTH)) for p in points.values() for s in (-1, 1)})
    bounds = data.groupBy(*group).agg(
        F.percentile_approx("_v", probes, PROBE_ACCURACY).alias("_bounds"), F.count("_v").alias("samples")
    )
    groups = 1
    if keys:
        bounds, groups = stored_and_counted(bounds, "bounds")
        placed = data.join(F.broadcast(bounds) if groups <= BROADCAST_ROWS else bounds, group)
    else:
        placed = data.withColumn("_s", bounds.select(F.struct("_bounds", "samples")).scalar()).select(*group, "_v", "_s.*")
    bracket = sum((F.col("_v") > F.col("_bounds")[i]).cast("int") for i in range(len(probes)))
    placed = placed.withColumn("_bracket", bracket)

    upto = W.partitionBy(*group).orderBy("_bracket").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = placed.groupBy(*group, "samples", "_bracket").count().withColumn("_cum", F.sum("count").over(upto))
    wanted = F.array(*[F.struct(F.lit(name).alias("point"), F.lit(float(p)).alias("p")) for name, p in points.items()])
    index = F.least(F.floor(F.col("samples") * F.col("p")), F.col("samples") - 1)
    targets = (
        counts.select("*", F.inline(wanted))
        .withColumn("_index", index)
        .filter((F.col("_cum") > F.col("_index")) & (F.col("_cum") - F.col("count") <= F.col("_index")))
        .select(*group, "samples", "_bracket", "point", (F.col("_index") - (F.col("_cum") - F.col("count"))).alias("_rest"))
    )
    if groups * len(points) <= BROADCAST_ROWS:  # one target per group and point
        targets = F.broadcast(targets)
    inside = placed.drop("samples", "_bounds").join(targets, [*group, "_bracket"])
    folded = inside.groupBy(*group, "samples", "point", "_rest", "_v").count()
    ranked = folded.withColumn(
        "_cum", F.sum("count").over(W.partitionBy(*group, "point").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    hit = ranked.filter((F.col("_cum") > F.col("_rest")) & (F.col("_cum") - F.col("count") <= F.col("_rest")))
    out = hit.groupBy(*group, "samples").agg(*[F.max(F.when(F.col("point") == n, F.col("_v"))).alias(n) for n in points])
    return out if keys else out.drop("_all")


def regression_percent(current: Column, baseline: Column) -> Column:
    return F.when(baseline == 0, F.lit(0.0)).otherwise((current - baseline) / baseline * 100.0)


def regression_status(percent: Column, threshold: Column | float) -> Column:
    return (
        F.when(percent < 0, "Faster")
        .when(percent <= 5, "Baseline")
        .when(percent <= threshold, "SlowerAcceptable")
        .otherwise("Regression")
    )


def backoff_delay(attempt: Column, base_ms: Column) -> Column:
    """Exponential backoff capped at 30 seconds."""
    return F.least(base_ms * F.pow(F.lit(2.0), attempt - 1), F.lit(30000.0)).cast("bigint")
