"""Ranks over whole tables, as-of and interval joins, and the plan's state machine."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import carry
from weftline.registry import query
from weftline.sources.tables import table


@query("global_ranks", "WN12 TK4", """SELECT l_orderkey, l_linenumber, rank() OVER p AS rank, dense_rank() OVER p AS dense_rank, round(percent_rank() OVER p, 9) AS percent_rank, round(cume_dist() OVER p, 9) AS cume_dist
FROM lineitem WINDOW p AS (ORDER BY l_quantity DESC)""")
def global_ranks(spark, sf):
    """Ranks over all of lineitem by quantity, a column of few values that very many rows share."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    found = carry.ranked(rows, [], {"l_quantity": F.desc("l_quantity")})
    return found.select("l_orderkey", "l_linenumber", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"))


@query("global_tiles", "WN12", """SELECT l_orderkey, l_linenumber, row_number() OVER p AS row_number, CAST(ntile(97) OVER p AS INTEGER) AS ntile FROM lineitem WINDOW p AS (ORDER BY l_extendedprice, l_orderkey, l_linenumber)""")
def global_tiles(spark, sf):
    """Every line's place by price, and in which of 97 equal tiles it lies."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    found = carry.numbered(rows, [], [F.asc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], tiles=97)
    return found.select("l_orderkey", "l_linenumber", "row_number", "ntile")


@query("flag_tiles", "WN12", """SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER p AS row_number, CAST(ntile(10) OVER p AS INTEGER) AS ntile FROM lineitem WINDOW p AS (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber)""")
def flag_tiles(spark, sf):
    """The same within three hot groups."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return carry.numbered(rows, ["l_returnflag"], [F.asc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], tiles=10).drop("l_extendedprice")


@query("last_view", "JN13 WN8", """SELECT p.event_id, p.user_id, v.event_id AS last_event_id, v.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def last_view(spark, sf):
    """Each purchase with its user's last view so far."""
    e = table(spark, sf, "events")
    bought = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return carry.as_of(bought, e.filter("event_type = 'view'"), ["user_id"], "ts", "event_id", ["event_id", "value"]).drop("ts")


_ORDERS = "SELECT o_orderkey, o_custkey, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) // 86400 AS BIGINT) AS a, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) // 86400 + o_orderkey % 120 AS BIGINT) AS b FROM orders"


@query("open_together", "JN13", f"""WITH o AS ({_ORDERS}) SELECT x.o_custkey, x.o_orderkey, y.o_orderkey AS other_o_orderkey FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a <= y.b AND y.a <= x.b""")
def open_together(spark, sf):
    """Pairs of a customer's orders that were open at one time; an order stays open for some days."""
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", day.alias("a"), (day + F.col("o_orderkey") % 120).alias("b"))
    return carry.overlapping(o, o, ["o_custkey"], "a", "b", 60).filter("o_orderkey < other_o_orderkey").select("o_custkey", "o_orderkey", "other_o_orderkey")


#: A plan of four steps: ready, running at a step, paused at a step, completed, failed, cancelled. Only these moves are allowed.
STEPS = 4
READY, RUNNING, PAUSED, COMPLETED, FAILED, CANCELLED = 0, 1, 1 + STEPS, 1 + 2 * STEPS, 2 + 2 * STEPS, 3 + 2 * STEPS
EVENTS = ("signup", "view", "click", "purchase", "error")  # start or resume, pause, complete a step, complete a step, fail or (when paused) cancel


def _next(event: str, state: int) -> int:
    running, paused = RUNNING <= state < PAUSED, PAUSED <= state < COMPLETED
    if event == "signup":
        return RUNNING if state == READY else state - STEPS if paused else -1
    if event == "view":
        return state + STEPS if running else -1
    if event in ("click", "purchase"):
        return (state + 1 if state + 1 < PAUSED else COMPLETED) if running else -1
    return FAILED if running else CANCELLED if paused else -1


TABLE = [[_next(e, s) for s in range(CANCELLED + 1)] for e in EVENTS]
_CODE = "CASE event_type " + " ".join(f"WHEN '{e}' THEN {k}" for k, e in enumerate(EVENTS)) + " END"
_SQL_NEXT = "CASE " + " ".join(f"WHEN code = {e} AND before = {s} THEN {t}" for e, row in enumerate(TABLE) for s, t in enumerate(row) if t >= 0) + " ELSE -1 END"


@query("plan_states", "CX10 CX15 CL13", f"""WITH RECURSIVE e AS (SELECT event_id, user_id, {_CODE} AS code, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, user_id, i, code, before, {_SQL_NEXT} AS moved FROM (SELECT *, {READY} AS before FROM e WHERE i = 1)
UNION ALL SELECT event_id, user_id, i, code, before, {_SQL_NEXT} FROM (SELECT e.event_id, e.user_id, e.i, e.code, CASE WHEN r.moved < 0 THEN r.before ELSE r.moved END AS before FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT event_id, user_id, CAST(before AS INTEGER) AS before, CAST(CASE WHEN moved < 0 THEN before ELSE moved END AS INTEGER) AS after, moved >= 0 AS accepted FROM r""")
def plan_states(spark, sf):
    """A user's events as the commands of a plan: which are allowed, and what they lead to."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.expr(_CODE).alias("code"))
    return carry.machine(e, "user_id", [F.asc("ts"), F.asc("event_id")], "code", TABLE, READY).drop("ts", "code")


@query("plan_outcomes", "CX10 CX15 AG19 CL13", f"""WITH RECURSIVE e AS (SELECT event_id, user_id, {_CODE} AS code, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, {READY} AS before, CAST(0 AS BIGINT) AS refused, 0 AS code, false AS last FROM e WHERE i = 1
UNION ALL SELECT user_id, i + 1, CASE WHEN moved < 0 THEN before ELSE moved END, refused + CASE WHEN moved < 0 THEN 1 ELSE 0 END, 0, false FROM (SELECT *, {_SQL_NEXT} AS moved FROM (SELECT r.user_id, r.i, r.before, r.refused, e.code FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i)))
SELECT user_id, i - 1 AS events, refused, CAST(before AS INTEGER) AS state, CASE WHEN before = {READY} THEN 0 WHEN before < {PAUSED} THEN before - {RUNNING} WHEN before < {COMPLETED} THEN before - {PAUSED} END AS next_step
FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def plan_outcomes(spark, sf):
    """Where every plan ends, how many commands were refused, and its next step if one is pending."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.expr(_CODE).alias("code"))
    found = carry.machine(e, "user_id", [F.asc("ts"), F.asc("event_id")], "code", TABLE, READY)
    s = F.max_by("after", F.struct("ts", "event_id"))
    out = found.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(~F.col("accepted")).alias("refused"), s.alias("state"))
    step = F.when(F.col("state") == READY, 0).when(F.col("state") < PAUSED, F.col("state") - RUNNING).when(F.col("state") < COMPLETED, F.col("state") - PAUSED)
    return out.withColumn("next_step", step)
