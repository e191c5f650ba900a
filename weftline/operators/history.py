"""Undo and redo logs of bounded size.

The position in such a log (undo depth, log length) has few values, so what a run of operations does is a small table from
position to position. Runs of one time bucket are worked out apart, chained per session, and then replayed from their true
start, so no long session has to be walked in one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positions(limit: int) -> list[tuple[int, int]]:
    """Every (undo depth, length) of a log of at most ``limit`` entries."""
    return [(depth, length) for length in range(limit + 1) for depth in range(length + 1)]


def moves(limit: int) -> dict[str, list[int]]:
    """Position number to position number for push, undo and redo."""
    known = positions(limit)
    number = {p: i for i, p in enumerate(known)}
    return {
        "push": [number[(min(d + 1, limit),) * 2] for d, _ in known],
        "undo": [number[(max(d - 1, 0), n)] for d, n in known],
        "redo": [number[(min(d + 1, n), n)] for d, n in known],
    }


def replay(ops: DataFrame, session: str, order: list[str], op: str, bucket: Column, limit: int = 10) -> DataFrame:
    """Add ``applied``, ``undo_depth`` and ``redo_depth`` after every push, undo or redo of ``ops``."""
    table = moves(limit)
    known = F.lit([list(p) for p in positions(limit)])
    step_of = F.create_map(*[x for name, row in table.items() for x in (F.lit(name), F.lit(row))])
    keep = [c for c in ops.columns if c not in (session, op)]
    item = F.struct(*[F.col(c) for c in order], F.col(op).alias("_op"), F.struct(*keep).alias("_rest"))
    runs = ops.withColumn("_bucket", bucket).groupBy(session, "_bucket").agg(F.sort_array(F.collect_list(item)).alias("_ops"))
    same = F.lit(list(range(len(positions(limit)))))
    effect = F.aggregate(F.transform("_ops", lambda o: step_of[o["_op"]]), same, lambda at, move: F.transform(at, lambda p: F.element_at(move, p + 1)))
    runs = runs.withColumn("_effect", effect)

    chain = runs.groupBy(session).agg(F.sort_array(F.collect_list(F.struct("_bucket", "_effect"))).alias("_chain"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    walked = F.aggregate("_chain", zero, lambda s, c: F.struct(F.element_at(c["_effect"], s["at"] + 1).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")))
    starts = chain.select(session, F.explode_outer(F.arrays_zip(F.transform("_chain", lambda c: c["_bucket"]).alias("_bucket"), walked["starts"].alias("_start"))).alias("_s"))
    starts = starts.select(session, "_s._bucket", "_s._start")

    first = F.struct(F.col("_start").alias("at"), F.array().cast("array<struct<before:int,after:int>>").alias("seen"))

    def advance(state, o):
        after = F.element_at(step_of[o["_op"]], state["at"] + 1)
        return F.struct(after.alias("at"), F.array_append(state["seen"], F.struct(state["at"].alias("before"), after.alias("after"))).alias("seen"))

    placed = runs.select(session, "_bucket", "_ops").join(starts, [session, "_bucket"])
    done = placed.select(session, F.arrays_zip("_ops", F.aggregate("_ops", first, advance)["seen"].alias("_seen")).alias("_z"))
    rows = done.select(session, F.explode_outer("_z").alias("_r")).select(session, "_r._ops._op", "_r._ops._rest.*", "_r._seen.*")
    place = F.element_at(known, F.col("after") + 1)
    return rows.select(session, *keep, F.col("_op").alias(op), ((F.col("_op") == "push") | (F.col("before") != F.col("after"))).alias("applied"),
                       place[0].alias("undo_depth"), (place[1] - place[0]).alias("redo_depth"))
