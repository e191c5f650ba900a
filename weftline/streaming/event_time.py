"""Jobs in event time: windows, sessions, duplicates, joins of two streams, and state that ends by itself.

Every job states how late a row may come (``delay``); rows later than that are left out, and state goes once nothing can reach it.
Times are compared as they stand in the rows, so a result does not depend on when a batch runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.session import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Keys share their state by so many buckets, a number that stays for the life of a checkpoint.
BUCKETS = 1024


def run(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Append to files what the stream gives now, exactly once; a later call with the same folders goes on."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # state on the executors' disks: it may outgrow their memory
    try:
        job = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        job.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(out)


def files_in_order(spark: SparkSession, folder: str, schema, at_once: int | None = 1) -> DataFrame:
    """A stream of the files of ``folder``, oldest first, ``at_once`` files a batch (None: all that are new when the stream starts)."""
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", at_once) if at_once else stream).parquet(folder)


def windows(rows: DataFrame, ts: str, keys: list[str], value: str, size: str, delay: str, slide: str | None = None) -> DataFrame:
    """Count and sum per window and key, once no row of the window can come."""
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    found = rows.withWatermark(ts, delay).groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(rows: DataFrame, ts: str, keys: list[str], gap: str, delay: str) -> DataFrame:
    """Runs of a key's rows with less than ``gap`` between neighbours."""
    found = rows.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(rows: DataFrame, ts: str, key: list[str], delay: str) -> DataFrame:
    """The first of the rows of one key that come within the delay."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def followed_by(first: DataFrame, then: DataFrame, keys: list[str], ts: str, within: str, delay: str) -> DataFrame:
    """Pairs of a row of ``first`` and a row of ``then`` of one key at most ``within`` later. Both sides' state ends with the span."""
    a = first.withWatermark(ts, delay).select(*keys, F.col(ts).alias("first_ts"), F.col("event_id").alias("first_id"))
    b = then.withWatermark(ts, delay).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(ts).alias("then_ts"), F.col("event_id").alias("then_id"))
    same: Column = (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, same).select(*keys, "first_id", "then_id", "first_ts", "then_ts")


def _by_bucket(rows: DataFrame, key: str, delay: str, buckets: int) -> GroupedData:
    """Rows by a bucket of their key. Rows without a key have a bucket of their own, so the others' keys stay whole numbers."""
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")
    return rows.withColumn("_bucket", bucket).withWatermark("ts", delay).groupBy("_bucket")


class _Shared(StatefulProcessor):
    """State of all keys of a bucket in one value, as arrays: a call to the state store costs more than the work on a key's rows.

    One timer a bucket stands at the time when the first of its keys ends.
    """

    def __init__(self, key: str, span_ms: int):
        self.key, self.span = key, span_ms

    def _open(self, handle: StatefulProcessorHandle, fields: str) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", fields)

    def _held(self) -> list[tuple]:
        """One tuple a key."""
        return list(zip(*self.state.get())) if self.state.exists() else []

    def _keep(self, rows: list[tuple], last_ms: list[int]) -> None:
        """Hold these rows until ``span_ms`` after the first of ``last_ms``."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rows:
            self.state.update(tuple(map(list, zip(*rows))))
            self.handle.registerTimer(min(last_ms) + self.span + 1)
        else:
            self.state.clear()

    def _in_order(self, bucket: int, rows: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, list, list[int]]:
        """The rows by key, time and id; their keys, and their times in microseconds."""
        asked = pd.concat(list(rows))
        micros = asked["ts"].to_numpy("datetime64[us]").astype("int64")
        keys = np.zeros(len(asked), np.int64) if bucket < 0 else asked[self.key].to_numpy()
        order = np.lexsort((asked["event_id"].to_numpy(), micros, keys))
        return asked.iloc[order], [None] * len(asked) if bucket < 0 else keys[order].tolist(), micros[order].tolist()

    def close(self) -> None:
        pass


class Cache(_Shared):
    """A value that is loaded on a miss and serves requests for ``span_ms`` of event time. A timer drops it when that is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open(handle, "keys array<bigint>, loaded array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked, keys, micros = self._in_order(key[0], rows)
        loaded, hits = dict(self._held()), []
        for one, now in zip(keys, micros):
            hit = one in loaded and now < loaded[one] + 1000 * self.span
            hits.append(hit)
            if not hit:
                loaded[one] = now
        self._keep(list(loaded.items()), [t // 1000 for t in loaded.values()])
        yield pd.DataFrame({"event_id": asked["event_id"].to_numpy(), self.key: keys, "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        left = [(one, t) for one, t in self._held() if t // 1000 + self.span >= now]
        self._keep(left, [t // 1000 for _, t in left])
        return iter(())


def cached(requests: DataFrame, key: str, ttl_ms: int, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """``(event_id, key, hit)`` of every request ``(event_id, key, ts)``: whether the key's value was loaded less than ``ttl_ms`` ago."""
    grouped = _by_bucket(requests, key, delay, buckets)
    return grouped.transformWithStateInPandas(Cache(key, ttl_ms), f"event_id bigint, {key} bigint, hit boolean", "Append", "EventTime")


class Responses(_Shared):
    """Chunks of a key's open response, put together; it leaves with its end mark, or unfinished when ``span_ms`` passed without a chunk."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open(handle, "keys array<bigint>, last array<bigint>, chunks array<bigint>, texts array<string>")

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, "chunks", "full_text", "finished"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked, keys, micros = self._in_order(key[0], rows)
        held, out = {one: (last, n, [text]) for one, last, n, text in self._held()}, []
        for one, micro, content, done in zip(keys, micros, asked["content"], asked["done"]):
            now = micro // 1000
            last, n, parts = held.pop(one, (now, 0, []))
            if now > last + self.span:
                out.append((one, n, "".join(parts), False))
                n, parts = 0, []
            parts.append(content)
            if done:
                out.append((one, n + 1, "".join(parts), True))
            else:
                held[one] = now, n + 1, parts
        self._keep([(one, last, n, "".join(parts)) for one, (last, n, parts) in held.items()], [last for last, _, _ in held.values()])
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), self._held()
        left = [row for row in held if row[1] + self.span >= now]
        self._keep(left, [last for _, last, _, _ in left])
        yield self._frame([(one, n, text, False) for one, last, n, text in held if last + self.span < now])


def responses(chunks: DataFrame, key: str, gap_ms: int, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """``(key, chunks, full_text, finished)`` of responses as they end, from ``(event_id, key, ts, content, done)`` rows."""
    grouped = _by_bucket(chunks, key, delay, buckets)
    return grouped.transformWithStateInPandas(Responses(key, gap_ms), f"{key} bigint, chunks bigint, full_text string, finished boolean", "Append", "EventTime")
