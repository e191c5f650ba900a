"""Ordered calculations over whole tables or hot keys: range parts, work within a part, and totals carried between parts.

Rows are dealt by ranges of (keys, order), so a key with a third of all rows lies in many parts. Each part is worked on by itself;
what goes from part to part is one row per key and part. Nothing runs before the query's own action but the sampling of ranges
and the writing of the dealt rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import cut_lineage

PART = "_part"


def dealt(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``_part``, a number that rises with the order within the keys. Equal (keys, order) share a part.

    Written once, so part numbers stay what they are if a task runs again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small parts are not put together
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return cut_lineage(ranged.withColumn(PART, F.spark_partition_id()), "parts")


def _earlier(keys: list[str]):
    """Over one row per key and part."""
    return W.partitionBy(*(keys or [F.lit(0)])).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)


def _joined(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    same = F.col(f"r.{PART}") == F.col(f"c.{PART}")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    return rows.alias("r").join(carried.alias("c"), same)


def numbered(df: DataFrame, keys: list[str], order: list[Column], tiles: int | None = None) -> DataFrame:
    """Add ``row_number`` and, with ``tiles``, ``ntile`` per key along ``order``, which must be total."""
    parts = dealt(df, keys, order)
    counts = parts.groupBy(*keys, PART).agg(F.count("*").alias("_n"))
    counts = counts.select(*keys, PART, F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*(keys or [F.lit(0)]))).alias("_all"))
    local = F.row_number().over(W.partitionBy(*keys, PART).orderBy(*order))
    number = F.col("c._before") + F.col("r._local")
    found = _joined(parts.withColumn("_local", local), counts, keys).select(*(F.col(f"r.{c}") for c in df.columns), number.alias("row_number"), F.col("c._all").alias("_all"))
    if tiles is not None:
        size, more = F.floor(F.col("_all") / tiles), F.col("_all") % tiles
        at, wide = F.col("row_number") - 1, (F.floor(F.col("_all") / tiles) + 1) * (F.col("_all") % tiles)
        tile = F.when(at < wide, F.floor(at / (size + 1))).otherwise(more + F.floor((at - wide) / F.greatest(size, F.lit(1))))
        found = found.withColumn("ntile", (tile + 1).cast("int"))
    return found.drop("_all")


def ranked(df: DataFrame, keys: list[str], order: dict[str, Column]) -> DataFrame:
    """Add ``rank``, ``dense_rank``, ``percent_rank`` and ``cume_dist`` per key. ``order``: columns and their sort expressions.

    Equal rows are counted before anything is dealt, so a value that a third of all rows have is one row.
    """
    names = list(order)
    values = dealt(df.groupBy(*keys, *names).agg(F.count("*").alias("_n")), keys, list(order.values()))
    per = W.partitionBy(*keys, PART).orderBy(*order.values())
    totals = values.groupBy(*keys, PART).agg(F.sum("_n").alias("_rows"), F.count("*").alias("_values"))
    group = W.partitionBy(*(keys or [F.lit(0)]))
    totals = totals.select(*keys, PART, *(F.coalesce(F.sum(c).over(_earlier(keys)), F.lit(0)).alias(f"{c}_before") for c in ("_rows", "_values")), F.sum("_rows").over(group).alias("_all"))
    local = values.withColumn("_upto", F.sum("_n").over(per.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_no", F.row_number().over(per))
    rank = F.col("c._rows_before") + F.col("r._upto") - F.col("r._n") + 1
    found = _joined(local, totals, keys).select(
        *(F.col(f"r.{c}") for c in [*keys, *names]), rank.alias("rank"), (F.col("c._values_before") + F.col("r._no")).alias("dense_rank"),
        F.when(F.col("c._all") > 1, (rank - 1) / (F.col("c._all") - 1)).otherwise(0.0).alias("percent_rank"), ((F.col("c._rows_before") + F.col("r._upto")) / F.col("c._all")).alias("cume_dist"),
    )
    same = F.lit(True)
    for c in [*keys, *names]:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"v.{c}"))
    return df.alias("d").join(found.alias("v"), same).select("d.*", "v.rank", "v.dense_rank", "v.percent_rank", "v.cume_dist")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, tie: str, carry: list[str]) -> DataFrame:
    """Every row of ``left`` with ``carry`` of the last row of ``right`` of its keys that is not later; null without one.

    ``tie`` orders rows of ``right`` at one time. Rows whose key or time is null have no partner.
    """
    mine = left.select(*keys, ts, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*left.columns).alias("_left"))
    taken = F.struct(*(F.col(c) for c in carry))
    theirs = right.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, ts])).select(*keys, ts, F.lit(0).alias("_side"), F.col(tie).alias("_tie"), taken.alias("_right"))
    order = [F.col(ts), F.col("_side"), F.col("_tie")]
    both = dealt(mine.unionByName(theirs, allowMissingColumns=True), keys, order)
    last = F.last("_right", ignorenulls=True)
    ends = both.filter("_side = 0").groupBy(*keys, PART).agg(F.max_by("_right", F.struct(ts, "_tie")).alias("_end"))
    places = both.select(*keys, PART).distinct().join(ends, [*keys, PART], "left")
    places = places.select(*keys, PART, F.last("_end", ignorenulls=True).over(_earlier(keys)).alias("_carried"))
    local = both.withColumn("_last", last.over(W.partitionBy(*keys, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    found = _joined(local.filter("_side = 1"), places, keys)
    known = F.col(f"r.{ts}").isNotNull()
    return found.select("r._left.*", F.when(known, F.coalesce("r._last", "c._carried")).alias("_r")).select(*left.columns, *(F.col("_r")[c].alias(f"last_{c}") for c in carry))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str, width: float) -> DataFrame:
    """Pairs of rows whose closed intervals of numbers meet: columns of ``a``, and of ``b`` as ``other_*``.

    Intervals meet in bins of ``width``; only the bin in which the later of the two begins reports a pair, so none comes twice.
    With the mean length as width there are about two rows an interval. A hot key is spread over its bins.
    """

    def binned(df):
        first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
        return df.filter(F.col(start) <= F.col(end)).withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))

    other = binned(b).select(*(F.col(c).alias(f"other_{c}") for c in b.columns), F.col("_first").alias("_other_first"), "_bin")
    same = F.col("a._bin") == F.col("b._bin")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.other_{k}"))
    met = binned(a).alias("a").join(other.alias("b"), same)
    held = (F.col(f"a.{start}") <= F.col(f"b.other_{end}")) & (F.col(f"b.other_{start}") <= F.col(f"a.{end}")) & (F.col("a._bin") == F.greatest("a._first", "b._other_first"))
    return met.filter(held).select(*(F.col(f"a.{c}") for c in a.columns), *(F.col(f"b.other_{c}") for c in b.columns))


# State machines


def machine(df: DataFrame, key: str, order: list[Column], event: str, table: list[list[int]], start: int) -> DataFrame:
    """Add ``before``, ``after`` and ``accepted`` of a state machine that reads each key's events in order.

    ``table[event][state]`` is the next state, or -1 where the event is not allowed and changes nothing. An event is a map from
    state to state and maps compose, so each part gives one map for all states, the maps of a key's parts are put together in
    order, and each part is then read once more from the state it really begins in.
    """
    moves = np.array([[s if t < 0 else t for s, t in enumerate(row)] for row in table])
    allowed = np.array(table) >= 0
    rows = dealt(df.withColumn("_key", F.col(key).cast("bigint")).withColumn("_event", F.col(event).cast("int")), ["_key"], order)
    ordered = rows.repartition(PART, "_key").sortWithinPartitions(PART, "_key", *order)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, whole = None, np.arange(moves.shape[1])

        def out():
            return pa.record_batch([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int64()), pa.array([whole.tolist()], pa.list_(pa.int32()))], names=[PART, "_key", "map"])

        for batch in batches:
            for part, name, e in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, name) != held:
                    if held is not None:
                        yield out()
                    held, whole = (part, name), np.arange(moves.shape[1])
                whole = moves[e][whole]
        if held is not None:
            yield out()

    done = ordered.select(PART, "_key", "_event").mapInArrow(maps, f"{PART} int, _key bigint, map array<int>")
    earlier = F.collect_list(F.struct(PART, "map")).over(_earlier(["_key"]))
    begin = F.aggregate(F.sort_array(earlier), F.lit(start), lambda s, m: F.element_at(m["map"], s + 1))
    begins = done.select(PART, "_key", begin.alias("_begin"))
    known = ordered.alias("r").join(begins.alias("c"), (F.col(f"r.{PART}") == F.col(f"c.{PART}")) & F.col("r._key").eqNullSafe(F.col("c._key"))).select("r.*", "c._begin")
    known = known.repartition(PART, "_key").sortWithinPartitions(PART, "_key", *order)
    columns = df.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, before int, after int, accepted boolean"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, start
        for batch in batches:
            before, after, good = [], [], []
            for part, name, e, first in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (PART, "_key", "_event", "_begin"))):
                if (part, name) != held:
                    held, state = (part, name), first
                before.append(state)
                good.append(bool(allowed[e][state]))
                state = int(moves[e][state])
                after.append(state)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.record_batch([*kept, pa.array(before, pa.int32()), pa.array(after, pa.int32()), pa.array(good)], names=[*columns, "before", "after", "accepted"])

    return known.mapInArrow(read, schema)
