"""Metrics queries over ``events``: views are cache hits, clicks misses, errors errors, ``value`` a latency in ms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as tx
from weftline.operators import metrics as m
from weftline.operators.ordered import consecutive_runs, time_bucket
from weftline.operators.rules import error_type, first_match
from weftline.plans.corpus import cte, derived
from weftline.plans.sqltext import any_contains, cases, q
from weftline.registry import query
from weftline.sources.tables import table

ERROR_TYPE_SQL = cases([(any_contains("lower(message)", w), q(t)) for t, w in fixed.ERROR_TYPES.items()], q("Other"))
_POINTS_SQL = ", ".join(
    f"max(CASE WHEN rn = least(CAST(floor(n * CAST({p} AS DOUBLE)) AS BIGINT), n - 1) + 1 THEN value END) AS {name}"
    for name, p in fixed.POINTS.items()
)
_EVENT_LEVEL = {"view": "Debug", "click": "Info", "signup": "Info", "purchase": "Warn", "error": "Error"}
_SPLIT = "2024-01-16 00:00:00"


def _counters(events):
    return events.agg(
        F.count_if(F.col("event_type") == "view").alias("cache_hits"),
        F.count_if(F.col("event_type") == "click").alias("cache_misses"),
        F.count_if(F.col("event_type") != "error").alias("total_queries"),
        F.coalesce(F.avg(F.when(F.col("event_type") != "error", F.col("value"))), F.lit(0.0)).alias("avg_latency_ms"),
    )


def _snapshot(spark, sf):
    """Counters, percentiles and the error map on one row; each part is a scalar of the others' row."""
    events = table(spark, sf, "events")
    points = m.nearest_rank(events.filter(F.col("event_type") != "error"), [], "value", fixed.POINTS)
    points = points.select(F.struct("samples", *fixed.POINTS)).scalar()
    by_type = (
        derived(spark, sf, "error_log").filter("is_error").groupBy(error_type(F.col("message")).alias("t")).agg(F.count("*").alias("c"))
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("t", "c")))).alias("errors")).scalar()
    )
    row = _counters(events).withColumn("_p", points).withColumn("errors", by_type).select("*", "_p.*").drop("_p")
    return row.withColumn("cache_hit_rate", m.ratio(F.col("cache_hits"), F.col("cache_hits") + F.col("cache_misses")))


_SNAPSHOT_CTE = f"""
{cte("error_log")},
c AS (SELECT count(*) FILTER (event_type = 'view') AS cache_hits, count(*) FILTER (event_type = 'click') AS cache_misses,
  count(*) FILTER (event_type <> 'error') AS total_queries, coalesce(avg(value) FILTER (event_type <> 'error'), 0.0) AS avg_latency_ms FROM events),
r AS (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n FROM events WHERE event_type <> 'error'),
p AS (SELECT {_POINTS_SQL}, max(n) AS samples FROM r),
e AS (SELECT {ERROR_TYPE_SQL} AS t, count(*) AS c FROM error_log WHERE is_error GROUP BY 1),
s AS (SELECT c.*, p.*, CASE WHEN cache_hits + cache_misses = 0 THEN 0.0 ELSE cache_hits / (cache_hits + cache_misses) END AS cache_hit_rate FROM c, p)
"""


@query("metrics_snapshot", "AG8 AG9 AG10 AG12", f"""
WITH {_SNAPSHOT_CTE}
SELECT cache_hits, cache_misses, round(cache_hit_rate, 6) AS cache_hit_rate, total_queries, round(avg_latency_ms, 6) AS avg_latency_ms,
 p50, p95, p99, samples, (SELECT string_agg(t || '=' || c, ',' ORDER BY t) FROM e) AS errors_by_type FROM s""")
def metrics_snapshot(spark, sf):
    s = _snapshot(spark, sf)
    errors = F.array_join(F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select(
        "cache_hits", "cache_misses", F.round("cache_hit_rate", 6).alias("cache_hit_rate"), "total_queries",
        F.round("avg_latency_ms", 6).alias("avg_latency_ms"), "p50", "p95", "p99", "samples", errors.alias("errors_by_type"))


@query("metrics_export_csv", "SNK3", f"""
WITH {_SNAPSHOT_CTE}, rows AS (
SELECT 'cache_hits' AS metric, CAST(cache_hits AS STRING) AS value FROM s UNION ALL SELECT 'cache_misses', CAST(cache_misses AS STRING) FROM s
UNION ALL SELECT 'cache_hit_rate', printf('%.4f', cache_hit_rate) FROM s UNION ALL SELECT 'total_queries', CAST(total_queries AS STRING) FROM s
UNION ALL SELECT 'avg_latency_ms', printf('%.2f', avg_latency_ms) FROM s UNION ALL SELECT 'p50_latency_ms', printf('%.2f', p50) FROM s
UNION ALL SELECT 'p95_latency_ms', printf('%.2f', p95) FROM s UNION ALL SELECT 'p99_latency_ms', printf('%.2f', p99) FROM s
UNION ALL SELECT 'error_' || replace(t, ',', '_'), CAST(c AS STRING) FROM e) SELECT metric || ',' || value AS line FROM rows""")
def metrics_export_csv(spark, sf):
    s = _snapshot(spark, sf)
    pairs = {
        "cache_hits": F.col("cache_hits").cast("string"), "cache_misses": F.col("cache_misses").cast("string"),
        "cache_hit_rate": tx.fixed(F.col("cache_hit_rate"), 4), "total_queries": F.col("total_queries").cast("string"),
        "avg_latency_ms": tx.fixed(F.col("avg_latency_ms"), 2), "p50_latency_ms": tx.fixed(F.col("p50"), 2),
        "p95_latency_ms": tx.fixed(F.col("p95"), 2), "p99_latency_ms": tx.fixed(F.col("p99"), 2),
    }
    fixed_lines = F.array(*[F.concat(F.lit(k + ","), v) for k, v in pairs.items()])
    error_lines = F.transform(F.map_entries("errors"), lambda e: F.concat(F.lit("error_"), F.translate(e["key"], ",", "_"), F.lit(","), e["value"].cast("string")))
    return s.select(F.explode(F.concat(fixed_lines, error_lines)).alias("line"))


@query("metrics_report", "SC32", f"""
WITH {_SNAPSHOT_CTE}, top AS (SELECT t, c FROM e ORDER BY c DESC, t LIMIT 5)
SELECT 'Metrics Snapshot' || chr(10) || printf('  Cache: %d/%d hits (%.1f%% rate)', cache_hits, cache_hits + cache_misses, cache_hit_rate * 100) || chr(10)
 || printf('  Queries: %d total, %.1fms avg latency', total_queries, avg_latency_ms) || chr(10)
 || printf('  Latency: p50=%.0fms, p95=%.0fms, p99=%.0fms (%d samples)', p50, p95, p99, samples) || chr(10) || '  Errors:' || chr(10)
 || (SELECT string_agg('    - ' || t || ': ' || c || ' occurrences', chr(10) ORDER BY c DESC, t) FROM top) AS report FROM s""")
def metrics_report(spark, sf):
    s = _snapshot(spark, sf)
    by_count = F.slice(F.sort_array(F.transform(F.map_entries("errors"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("t")))), 1, 5)
    total = F.col("cache_hits") + F.col("cache_misses")
    head = F.concat(
        F.lit("Metrics Snapshot\n  Cache: "), F.col("cache_hits").cast("string"), F.lit("/"), total.cast("string"), F.lit(" hits ("),
        tx.fixed(F.col("cache_hit_rate") * 100, 1), F.lit("% rate)\n  Queries: "), F.col("total_queries").cast("string"), F.lit(" total, "),
        tx.fixed(F.col("avg_latency_ms"), 1), F.lit("ms avg latency\n  Latency: p50="), tx.fixed(F.col("p50"), 0), F.lit("ms, p95="),
        tx.fixed(F.col("p95"), 0), F.lit("ms, p99="), tx.fixed(F.col("p99"), 0), F.lit("ms ("), F.col("samples").cast("string"), F.lit(" samples)"))
    lines = F.array_join(F.transform(by_count, lambda e: F.concat(F.lit("    - "), e["t"], F.lit(": "), (-e["n"]).cast("string"), F.lit(" occurrences"))), "\n")
    return s.select(F.when(F.size("errors") > 0, F.concat(head, F.lit("\n  Errors:\n"), lines)).otherwise(head).alias("report"))


@query("latency_percentiles_by_type", "AG10", f"""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS samples, {_POINTS_SQL} FROM r GROUP BY event_type""")
def latency_percentiles_by_type(spark, sf):
    return m.nearest_rank(table(spark, sf, "events"), ["event_type"], "value", fixed.POINTS)


@query("latency_percentiles_by_user", "AG10", f"""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, max(n) AS samples, {_POINTS_SQL} FROM r GROUP BY user_id""")
def latency_percentiles_by_user(spark, sf):
    return m.nearest_rank(table(spark, sf, "events"), ["user_id"], "value", fixed.POINTS)


@query("hit_rate", "AG8 DM11", """
SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses,
 round(CASE WHEN count(*) FILTER (event_type IN ('view', 'click')) = 0 THEN 0.0
  ELSE count(*) FILTER (event_type = 'view') / count(*) FILTER (event_type IN ('view', 'click')) END, 6) AS hit_rate FROM events GROUP BY user_id""")
def hit_rate(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "click").alias("misses"))
    return g.withColumn("hit_rate", F.round(m.ratio(F.col("hits"), F.col("hits") + F.col("misses")), 6))


@query("error_top5", "AG11 CL14 TK2", f"""
WITH {cte("error_log")}
SELECT {ERROR_TYPE_SQL} AS error_type, count(*) AS occurrences FROM error_log WHERE is_error GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def error_top5(spark, sf):
    return (derived(spark, sf, "error_log").filter("is_error").groupBy(error_type(F.col("message")).alias("error_type"))
            .agg(F.count("*").alias("occurrences")).orderBy(F.desc("occurrences"), "error_type").limit(5))


def _status(spark, sf):
    events = table(spark, sf, "events").withColumn("side", F.when(F.col("ts") < F.lit(_SPLIT).cast("timestamp_ntz"), "base").otherwise("current"))
    p = m.nearest_rank(events, ["event_type", "side"], "value", fixed.POINTS)
    sides = [F.max(F.when(F.col("side") == s, F.col(n))).alias(f"{n}_{s}") for n in fixed.POINTS for s in ("base", "current")]
    percent = m.regression_percent(F.col("p50_current"), F.col("p50_base"))
    return p.groupBy("event_type").agg(*sides).withColumn("regression_percent", percent).withColumn("status", m.regression_status(percent, 20.0))


_STATUS_CTE = f"""
r AS (SELECT event_type, side, value, row_number() OVER (PARTITION BY event_type, side ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type, side) AS n
 FROM (SELECT *, CASE WHEN ts < TIMESTAMP '{_SPLIT}' THEN 'base' ELSE 'current' END AS side FROM events)),
p AS (SELECT event_type, side, {_POINTS_SQL} FROM r GROUP BY 1, 2),
w AS (SELECT b.event_type, b.p50 AS p50_base, c.p50 AS p50_current, b.p95 AS p95_base, c.p95 AS p95_current, b.p99 AS p99_base, c.p99 AS p99_current,
 CASE WHEN b.p50 = 0 THEN 0.0 ELSE (c.p50 - b.p50) / b.p50 * 100.0 END AS pct
 FROM p b JOIN p c ON b.event_type = c.event_type AND b.side = 'base' AND c.side = 'current'),
t AS (SELECT *, CASE WHEN pct < 0 THEN 'Faster' WHEN pct <= 5 THEN 'Baseline' WHEN pct <= 20 THEN 'SlowerAcceptable' ELSE 'Regression' END AS status FROM w)"""


@query("regression_status", "CL17 AG10", f"WITH {_STATUS_CTE} SELECT event_type, p50_base, p50_current, round(pct, 6) AS regression_percent, status FROM t")
def regression_status(spark, sf):
    return _status(spark, sf).select("event_type", "p50_base", "p50_current", F.round("regression_percent", 6).alias("regression_percent"), "status")


@query("benchmark_summary", "AG13", f"""WITH {_STATUS_CTE} SELECT count(*) AS total, count(*) FILTER (status <> 'Regression') AS passed,
 count(*) FILTER (status = 'Regression') AS regressions, count(*) FILTER (status = 'Faster') AS improvements, bool_and(status <> 'Regression') AS all_passed FROM t""")
def benchmark_summary(spark, sf):
    ok = F.col("status") != "Regression"
    return _status(spark, sf).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("regressions"),
        F.count_if(F.col("status") == "Faster").alias("improvements"), F.bool_and(ok).alias("all_passed"))


@query("benchmark_csv", "SNK4", f"""WITH {_STATUS_CTE} SELECT event_type || ',' || printf('%.2f,%.2f,%.2f,%.2f,%.2f,%.2f,%.2f', p50_current, p50_base, p95_current,
 p95_base, p99_current, p99_base, pct) || ',' || status AS line FROM t""")
def benchmark_csv(spark, sf):
    cols = ["p50_current", "p50_base", "p95_current", "p95_base", "p99_current", "p99_base", "regression_percent"]
    return _status(spark, sf).select(F.concat_ws(",", "event_type", *[tx.fixed(F.col(c), 2) for c in cols], "status").alias("line"))


_OPERATION = {"view": "cache_lookup", "click": "file_operations", "signup": "classification", "purchase": "tool_execution", "error": "tree_query"}


@query("preset_baselines", "CL18 CL17", f"""
WITH b(operation, target, base, threshold) AS (VALUES {", ".join(f"('{o}', {v[0]}, {v[1]}, {v[4]})" for o, v in fixed.PRESET_BASELINES.items())}),
r AS (SELECT {cases([(f"event_type = '{k}'", q(v)) for k, v in _OPERATION.items()])} AS operation, value,
 row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
p AS (SELECT operation, {_POINTS_SQL} FROM r GROUP BY 1),
j AS (SELECT p.*, target, base, threshold, CASE WHEN base = 0 THEN 0.0 ELSE (p50 - base) / base * 100.0 END AS pct FROM p JOIN b USING (operation))
SELECT operation, p50, p50 <= target AS meets_target, round(pct, 6) AS regression_percent,
 CASE WHEN pct < 0 THEN 'Faster' WHEN pct <= 5 THEN 'Baseline' WHEN pct <= threshold THEN 'SlowerAcceptable' ELSE 'Regression' END AS status FROM j""")
def preset_baselines(spark, sf):
    op = first_match([(F.col("event_type") == k, v) for k, v in _OPERATION.items()])
    p = m.nearest_rank(table(spark, sf, "events").withColumn("operation", op), ["operation"], "value", fixed.POINTS)

    def preset(i: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for o, v in fixed.PRESET_BASELINES.items() for x in (o, float(v[i]))]), F.col("operation"))

    percent = m.regression_percent(F.col("p50"), preset(1))
    return p.select("operation", "p50", (F.col("p50") <= preset(0)).alias("meets_target"), F.round(percent, 6).alias("regression_percent"),
                    m.regression_status(percent, preset(4)).alias("status"))


def _runs(spark, sf):
    log = derived(spark, sf, "error_log")
    return consecutive_runs(log, ["user_id"], ["ts", "event_id"], time_bucket(table(spark, sf, "events"), ["user_id"], "ts"), F.col("is_error"))


_RUN_CTE = f"""{cte("error_log")},
g AS (SELECT *, sum(CASE WHEN is_error THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM error_log),
runs AS (SELECT *, CASE WHEN is_error THEN count(*) FILTER (is_error) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) ELSE 0 END AS run FROM g)"""


@query("consecutive_errors", "WN10", f"WITH {_RUN_CTE} SELECT event_id, user_id, run FROM runs WHERE is_error")
def consecutive_errors(spark, sf):
    return _runs(spark, sf).filter("is_error").select("event_id", "user_id", "run")


@query("error_patterns", "AG20 WN10", f"""WITH {_RUN_CTE}, u AS (SELECT user_id, max(run) AS longest, arg_max(run, (ts, event_id)) AS current FROM runs GROUP BY 1)
SELECT count(*) FILTER (longest > 0) AS total_patterns, count(*) FILTER (current > 0) AS active_patterns, max(longest) AS longest_run FROM u""")
def error_patterns(spark, sf):
    per_user = _runs(spark, sf).groupBy("user_id").agg(
        F.max("run").alias("longest"), F.max_by("run", F.struct("ts", "event_id")).alias("current"))
    return per_user.agg(F.count_if(F.col("longest") > 0).alias("total_patterns"), F.count_if(F.col("current") > 0).alias("active_patterns"),
                        F.max("longest").alias("longest_run"))


_RETRY_SQL = cases([(f"error_type = {q(t)}", q(s)) for t, (s, _) in fixed.RETRY.items()], q("None"))
_BASE_SQL = cases([(f"error_type = {q(t)}", str(b)) for t, (s, b) in fixed.RETRY.items()], "0")


@query("retry_backoff", "SC29 CL15 CL14", f"""WITH {_RUN_CTE}, e AS (SELECT event_id, run, {ERROR_TYPE_SQL} AS error_type FROM runs WHERE is_error)
SELECT event_id, error_type, run AS attempt, {_RETRY_SQL} AS strategy,
 CAST(CASE WHEN {_RETRY_SQL} = 'ExponentialBackoff' THEN least({_BASE_SQL} * pow(2, run - 1), 30000) ELSE 0 END AS BIGINT) AS delay_ms FROM e""")
def retry_backoff(spark, sf):
    kind = F.col("error_type")
    strategy = first_match([(kind == t, s) for t, (s, _) in fixed.RETRY.items()], "None")
    base = first_match([(kind == t, b) for t, (_, b) in fixed.RETRY.items()], 0)
    return (_runs(spark, sf).filter("is_error").select("event_id", F.col("run").alias("attempt"), error_type(F.col("message")).alias("error_type"))
            .withColumn("strategy", strategy)
            .withColumn("delay_ms", F.when(F.col("strategy") == "ExponentialBackoff", m.backoff_delay(F.col("attempt"), base)).otherwise(F.lit(0).cast("bigint"))))


@query("log_level_filter", "FLT7", f"""
WITH l AS (SELECT event_id, {cases([(f"event_type = '{k}'", q(v)) for k, v in _EVENT_LEVEL.items()])} AS level FROM events)
SELECT event_id, level FROM l WHERE {cases([(f"level = '{k}'", str(v)) for k, v in fixed.LEVELS.items()])} >= 2""")
def log_level_filter(spark, sf):
    level = first_match([(F.col("event_type") == k, v) for k, v in _EVENT_LEVEL.items()])
    rank = first_match([(F.col("level") == k, v) for k, v in fixed.LEVELS.items()])
    return table(spark, sf, "events").select("event_id", level.alias("level")).filter(rank >= fixed.LEVELS["Warn"])
