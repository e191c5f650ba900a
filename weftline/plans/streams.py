"""Streaming queries over ``events``, read as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators.ordered import running_sum, time_bucket
from weftline.plans.corpus import DERIVED, cte, derived
from weftline.registry import query
from weftline.sources.tables import table
from weftline.streaming import jobs


def _line_stream(spark, sf):
    base, columns = DERIVED["stream_lines"]
    return jobs.table_stream(spark, sf, base).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


@query("stream_counters", "SM3 AG9", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS peak FROM events GROUP BY event_type")
def stream_counters(spark, sf):
    return jobs.counters(jobs.table_stream(spark, sf, "events"), "event_type", "value").withColumn("total", F.round("total", 4))


_CHUNKS = f"""{cte("stream_lines")}, p AS (SELECT event_id, user_id, ts, json_extract_string(line, '$.message.content') AS content, CAST(json_extract_string(line, '$.done') AS BOOLEAN) AS done FROM stream_lines WHERE json_valid(line)),
n AS (SELECT *, coalesce(sum(CASE WHEN done THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS response_no FROM p),
k AS (SELECT *, coalesce(last_value(CASE WHEN contains(content, '</think>') THEN 0 WHEN contains(content, '<think>') THEN 1 END IGNORE NULLS) OVER (PARTITION BY user_id, response_no ORDER BY ts, event_id), 0) AS thinking FROM n)"""


@query("stream_chunks", "SRC9 SM1", f"WITH {_CHUNKS} SELECT event_id, user_id, content, done FROM p")
def stream_chunks(spark, sf):
    """Chunk lines parsed in the stream and appended to files."""
    chunks = jobs.parsed_chunks(_line_stream(spark, sf), F.col("line"), ["event_id", "user_id"])
    return jobs.written(chunks, "chunks")


@query("stream_responses", "SM1 SM2 SC34 SRC9", f"""WITH {_CHUNKS} SELECT user_id, CAST(response_no AS BIGINT) AS response_no, CAST(count(*) AS INTEGER) AS chunks, string_agg(content, '' ORDER BY ts, event_id) AS full_text,
 coalesce(string_agg(content, '' ORDER BY ts, event_id) FILTER (thinking = 0), '') AS spoken_text, bool_or(done) AS finished FROM k GROUP BY 1, 2""")
def stream_responses(spark, sf):
    """Responses put together from chunk lines; a response ends with its done mark."""
    chunks = jobs.parsed_chunks(derived(spark, sf, "stream_lines"), F.col("line"), ["event_id", "user_id", "ts"])
    events = table(spark, sf, "events")
    numbered = running_sum(chunks, ["user_id"], ["ts", "event_id"], time_bucket(events, ["user_id"], "ts"), F.col("done").cast("bigint"), "_done")
    numbered = numbered.withColumn("response_no", F.col("_done") - F.col("done").cast("bigint"))
    return jobs.assembled(numbered, "user_id", ["ts", "event_id"], "response_no")


@query("stream_spoken", "SM2", f"""WITH {_CHUNKS}, r AS (SELECT user_id, CAST(response_no AS BIGINT) AS response_no, string_agg(content, '' ORDER BY ts, event_id) AS full_text, coalesce(string_agg(content, '' ORDER BY ts, event_id) FILTER (thinking = 0), '') AS spoken_text, bool_or(done) AS finished FROM k GROUP BY 1, 2)
SELECT user_id, response_no, full_text, spoken_text FROM r WHERE finished""")
def stream_spoken(spark, sf):
    """The same kept as streaming state: finished responses leave the stream."""
    chunks = jobs.parsed_chunks(_line_stream(spark, sf), F.col("line"), ["event_id", "user_id", "ts"])
    return jobs.written(jobs.spoken_responses(chunks, "user_id", ["ts", "event_id"]), "spoken")
