"""Event-time streams over ``events``: four batches of files by time and a restart after each, with rows that come far too late.

Every fiftieth event of the first batch comes with the last one, weeks behind the watermark, and must change nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.plans.corpus import DERIVED
from weftline.registry import query
from weftline.session import scratch_path
from weftline.sources.tables import table
from weftline.streaming import event_time, jobs

_STARTS = ("2024-01-09", "2024-01-16", "2024-01-23")
_LATE = f"event_id % 50 = 0 AND ts < TIMESTAMP '{_STARTS[0]}'"
_BATCHES = (
    f"ts < TIMESTAMP '{_STARTS[0]}' AND NOT ({_LATE})",
    f"ts >= TIMESTAMP '{_STARTS[0]}' AND ts < TIMESTAMP '{_STARTS[1]}'",
    f"ts >= TIMESTAMP '{_STARTS[1]}' AND ts < TIMESTAMP '{_STARTS[2]}'",
    f"ts >= TIMESTAMP '{_STARTS[2]}' OR ({_LATE})",
)
_KEPT = f"e AS (SELECT * FROM events WHERE NOT ({_LATE})), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e)"
_DELAY = "1 hour"


def _run(spark, sf, job, twice: bool = False):
    """``job`` over the batches; the stream stops after each and goes on from its checkpoint."""
    events, folder = table(spark, sf, "events"), scratch_path(spark, "events")
    # batches are cut by time in UTC, as rows without a zone
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    for some in _BATCHES:
        batch = rows.filter(some)
        if twice:  # every third row comes twice
            batch = batch.unionByName(batch.filter("event_id % 3 = 0"))
        files = max(spark.sparkContext.defaultParallelism, batch.rdd.getNumPartitions())  # even ones, as the stream's tasks follow them
        batch.repartition(files, "event_id").write.mode("append").parquet(folder)
        found = event_time.run(job(event_time.files_in_order(spark, folder, rows.schema, None)), out, checkpoint)
    return found


def _plain(*columns: str):
    """Timestamps without a zone, as in the tables."""
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in columns]


@query("stream_windows", "SM10 AG9", f"""WITH {_KEPT} SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e, w
GROUP BY 1, 2, mark HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= mark""")
def stream_windows(spark, sf):
    """Daily counts by type, each published once when its day is over."""
    found = _run(spark, sf, lambda e: event_time.windows(e, "ts", ["event_type"], "value", "1 day", _DELAY))
    return found.select(*_plain("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding", "SM10", f"""WITH {_KEPT}, s AS (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM e)
SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM s, w GROUP BY start, mark HAVING start + INTERVAL 2 DAY <= mark""")
def stream_sliding(spark, sf):
    """Windows of two days, one starting every day."""
    found = _run(spark, sf, lambda e: event_time.windows(e, "ts", [], "value", "2 days", _DELAY, "1 day"))
    return found.select(*_plain("start"), "n", F.round("total", 4).alias("total"))


@query("stream_sessions", "SM10 WN10", f"""WITH {_KEPT}, s AS (SELECT *, CASE WHEN ts - lag(ts) OVER p >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM e WINDOW p AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM i, w GROUP BY user_id, no, mark HAVING max(ts) + INTERVAL 12 HOUR <= mark""")
def stream_sessions(spark, sf):
    """Sessions of a user with less than twelve hours between events."""
    found = _run(spark, sf, lambda e: event_time.sessions(e, "ts", ["user_id"], "12 hours", _DELAY))
    return found.select("user_id", *_plain("start", "end"), "n")


@query("stream_once", "SM10 ST4", f"WITH {_KEPT} SELECT event_id, user_id, event_type FROM e")
def stream_once(spark, sf):
    """Events that come twice leave once."""
    return _run(spark, sf, lambda e: event_time.once(e, "ts", ["event_id"], _DELAY), twice=True).select("event_id", "user_id", "event_type")


@query("stream_followed", "SM10 JN13", f"""WITH {_KEPT} SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY""")
def stream_followed(spark, sf):
    """Purchases within a day of a click of the same user: two streams joined on user and time."""
    found = _run(spark, sf, lambda e: event_time.followed_by(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), ["user_id"], "ts", "1 day", _DELAY))
    return found.select("user_id", "first_id", "then_id")


@query("stream_cache", "SM7 FLT9 FLT10 DM11", f"""WITH RECURSIVE {_KEPT}, m AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY 1
UNION ALL SELECT m.user_id, min(e.ts) FROM m JOIN e ON e.user_id = m.user_id AND e.ts >= m.ts + INTERVAL 24 HOUR GROUP BY m.user_id, m.ts)
SELECT event_id, user_id, (user_id, ts) NOT IN (SELECT (user_id, ts) FROM m) AS hit FROM e""")
def stream_cache(spark, sf):
    """Each event asks for its user's value, which lives for 24 hours of event time from its last load."""
    return _run(spark, sf, lambda e: event_time.cached(e.select("event_id", F.col("user_id").cast("bigint").alias("user_id"), "ts"), "user_id", 24 * 3_600_000, _DELAY))


_WEEK = 7 * 24 * 3_600_000


@query("stream_open_responses", "SM2 SM1 SRC9 SM7", f"""WITH {_KEPT}, stream_lines AS (SELECT {", ".join(f"{x} AS {c}" for c, x in DERIVED["stream_lines"][1].items())} FROM e),
p AS (SELECT event_id, user_id, ts, json_extract_string(line, '$.message.content') AS content, CAST(json_extract_string(line, '$.done') AS BOOLEAN) AS done FROM stream_lines WHERE json_valid(line)),
g AS (SELECT *, CASE WHEN coalesce(lag(done) OVER o, true) OR epoch_ms(ts) > epoch_ms(lag(ts) OVER o) + {_WEEK} THEN 1 ELSE 0 END AS fresh FROM p WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g), r AS (SELECT user_id, no, count(*) AS chunks, string_agg(content, '' ORDER BY ts, event_id) AS full_text, bool_or(done) AS finished, max(ts) AS last,
 no < max(no) OVER (PARTITION BY user_id) AS ended FROM n GROUP BY 1, 2)
SELECT user_id, chunks, full_text, finished FROM r, (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM p) WHERE finished OR ended OR epoch_ms(last) + {_WEEK} < epoch_ms(mark)""")
def stream_open_responses(spark, sf):
    """Responses from chunk lines; one that gets no chunk for a week ends unfinished."""
    columns = [f"{x} AS {c}" for c, x in DERIVED["stream_lines"][1].items()]

    def job(e):
        chunks = jobs.parsed_chunks(e.selectExpr(*columns), F.col("line"), ["event_id", "user_id", "ts"])
        return event_time.responses(chunks.withColumn("user_id", F.col("user_id").cast("bigint")), "user_id", _WEEK, _DELAY)

    return _run(spark, sf, job)
