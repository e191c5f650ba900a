"""Structured Streaming jobs. Each runs over what is there (``availableNow``) and can be restarted from its checkpoint."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.session import scratch_path

CHUNK = "struct<model:string,created_at:string,message:struct<role:string,content:string>,done:boolean>"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, one file or a folder, as a stream of files."""
    folder = sf_dir.rstrip("/")
    # A pattern that matches just this name: the file source takes a single file only that way.
    pattern = f"{folder}/{name[:-1]}[{name[-1]}].parquet"
    return spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema).parquet(pattern)


def written(stream: DataFrame, label: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Append ``stream`` to parquet files exactly once and read them back."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, label)
    checkpoint = checkpoint or out + "-checkpoint"
    job = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def counters(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running count, sum and maximum per key, kept as state; one row per key is published."""
    spark = stream.sparkSession
    name = f"counters_{uuid.uuid4().hex}"
    state = stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("peak"))
    job = (state.writeStream.format("memory").queryName(name).outputMode("complete")
           .option("checkpointLocation", os.path.join(scratch_path(spark, "counters"), "checkpoint")).trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.table(name)


def parsed_chunks(lines: DataFrame, line: Column, keep: list[str]) -> DataFrame:
    """Content and end mark of each readable chunk line; blank and broken lines are dropped."""
    chunk = F.from_json(F.trim(line), CHUNK)
    rows = lines.select(*keep, chunk.alias("c"))
    return rows.filter(F.col("c.message.content").isNotNull() & F.col("c.done").isNotNull()).select(*keep, F.col("c.message.content").alias("content"), F.col("c.done").alias("done"))


def assembled(chunks: DataFrame, key: str, order: list[str], response: str) -> DataFrame:
    """Full and spoken text per response, in order.

    A chunk is spoken unless a think block is open after looking at that chunk's own marks.
    """
    item = F.struct(*order, "content", "done")
    g = chunks.groupBy(key, response).agg(F.sort_array(F.collect_list(item)).alias("l"))
    zero = F.struct(F.lit(False).alias("thinking"), F.lit("").alias("spoken"))

    def step(state, x):
        opens, closes = F.contains(x["content"], F.lit("<think>")), F.contains(x["content"], F.lit("</think>"))
        thinking = F.when(closes, False).when(opens, True).otherwise(state["thinking"])
        return F.struct(thinking.alias("thinking"), F.when(thinking, state["spoken"]).otherwise(F.concat(state["spoken"], x["content"])).alias("spoken"))

    return g.select(key, response, F.size("l").alias("chunks"), F.array_join(F.transform("l", lambda x: x["content"]), "").alias("full_text"),
                    F.aggregate("l", zero, step)["spoken"].alias("spoken_text"), F.exists("l", lambda x: x["done"]).alias("finished"))


def spoken_responses(chunks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """As ``assembled`` for a stream: state per key holds the open response; one row leaves per finished response."""
    output = f"{key} bigint, response_no bigint, full_text string, spoken_text string"

    def run(name, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, full, spoken, thinking = state.get if state.exists else (0, "", "", False)
        out = []
        for row in pd.concat(list(batches)).sort_values(order).itertuples(index=False):
            if "</think>" in row.content:
                thinking = False
            elif "<think>" in row.content:
                thinking = True
            full += row.content
            spoken += "" if thinking else row.content
            if row.done:
                out.append((name[0], number, full, spoken))
                number, full, spoken, thinking = number + 1, "", "", False
        state.update((number, full, spoken, thinking))
        yield pd.DataFrame(out, columns=[key, "response_no", "full_text", "spoken_text"])

    return chunks.groupBy(key).applyInPandasWithState(run, output, "number bigint, full string, spoken string, thinking boolean", "append", GroupStateTimeout.NoTimeout)
