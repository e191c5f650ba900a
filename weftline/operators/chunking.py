"""Splitting text into chunks."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.functions.text import WS_CHARS
from weftline.operators.rows import unnest, unnest_fields

SPANS = "array<struct<chunk_no:bigint,start_byte:int,end_byte:int,text:string>>"



def byte_windows(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Windows of at most ``limit`` UTF-8 bytes, as (start, end, text without outer white space).

    All places where a text may be cut are listed first: between characters, behind newlines, behind blanks. A window takes
    as many whole characters as fit, at least one; unless the text ends there, it then gives up what follows its last
    newline, or else its last blank. The next window starts at the last character boundary ``overlap`` bytes or more before
    that end, if this is behind the present start, or else at the end. Windows of white space only are left out.
    """
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw) or limit <= 0:
        return []
    between = [*np.flatnonzero(raw & 0xC0 != 0x80).tolist(), len(raw)]
    marks = [(np.flatnonzero(raw == byte) + 1).tolist() for byte in b"\n "]

    def last(places: list[int], low: int, high: int) -> int | None:
        """The greatest of the sorted places in (low, high]."""
        k = bisect_right(places, high)
        return places[k - 1] if k and places[k - 1] > low else None

    found, start, end = [], 0, 0
    while end < len(raw):
        end = last(between, start, start + limit) or between[bisect_right(between, start)]
        if end < len(raw) and end - start <= limit:
            end = last(marks[0], start, end) or last(marks[1], start, end) or end
        found.append((start, end, raw[start:end].tobytes().decode().strip(WS_CHARS)))
        start = last(between, start, end - overlap) or end
    return [w for w in found if w[2]]


def text_chunks(df: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """``(key, chunk_no, chunk_id, start_byte, end_byte, text)``; row-local, so no shuffle."""

    @F.pandas_udf(SPANS)
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([[(k, *w) for k, w in enumerate(byte_windows(t or "", limit, overlap))] for t in texts])

    rows = unnest(df, [key], split(F.col(text)), "_chunk")
    number = F.col("_chunk.chunk_no")
    chunk_id = F.sha2(F.concat_ws(":", F.col(key).cast("string"), number.cast("string")), 256)
    return rows.select(key, number, chunk_id.alias("chunk_id"), "_chunk.start_byte", "_chunk.end_byte", "_chunk.text")


def chunk_summary(kind: Column | str, first: Column, last: Column, count: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit(" chunk (lines "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(", "), count.cast("string"), F.lit(" lines)"))


def line_pieces(text: Column, lines: Column, window: int = 200) -> Column:
    """Windows of ``window`` lines as structs; a text no longer than that stays whole, as it is."""
    count = F.size(lines)
    starts = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)), F.lit(window))
    return F.transform(starts, lambda s: F.struct(
        (s + 1).alias("line_start"), F.least(s + window, count).alias("line_end"),
        F.when(count <= window, text).otherwise(F.array_join(F.slice(lines, s + 1, F.lit(window)), "\n")).alias("text")))


def line_chunks(df: DataFrame, key: str, text: str, window: int = 200) -> DataFrame:
    """One row per window of lines, with its summary."""
    rows = df.select(key, F.col(text).alias("_text"), tx.lines(F.col(text)).alias("_lines"))
    out = unnest_fields(rows, [key], line_pieces(F.col("_text"), F.col("_lines"), window))
    count = F.col("line_end") - F.col("line_start") + 1
    return out.withColumn("summary", chunk_summary("file", F.col("line_start"), F.col("line_end"), count))
