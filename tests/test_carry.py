"""Ranks, as-of and interval joins and state machines with hot keys, ties and nulls, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import carry
from weftline.plans import ordered


@pytest.fixture(scope="module")
def rows():
    """One key holds half of all rows; values repeat; some keys and values are null."""
    r = random.Random(11)
    return [(k, r.choice(["hot", "hot", "a", "b", None]), r.choice([1, 1, 1, 2, 5, 9, None])) for k in range(400)]


def groups(rows):
    out = {}
    for k, g, v in rows:
        out.setdefault(g, []).append((k, v))
    return out


def low(v):
    return (v is not None, v or 0)


def test_numbered(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, v int")
    found = {r.id: (r.row_number, r.ntile) for r in carry.numbered(df, ["g"], [F.asc("v"), F.asc("id")], tiles=7).collect()}
    for members in groups(rows).values():
        at = sorted(members, key=lambda m: (low(m[1]), m[0]))
        n = len(at)
        tiles = [t for t in range(7) for _ in range(n // 7 + (t < n % 7))]
        assert [found[k] for k, _ in at] == [(i + 1, tiles[i] + 1) for i in range(n)]


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_ranked(spark, rows, keys):
    df = spark.createDataFrame(rows, "id long, g string, v int")
    found = {r.id: r for r in carry.ranked(df, keys, {"v": F.desc("v")}).collect()}
    assert len(found) == len(rows)
    for members in (groups(rows).values() if keys else [[(k, v) for k, _, v in rows]]):
        values = sorted((low(v) for _, v in members), reverse=True)
        for k, v in members:
            r, n = found[k], len(members)
            rank = values.index(low(v)) + 1
            assert (r["rank"], r.dense_rank) == (rank, len({x for x in values if x > low(v)}) + 1)
            assert r.percent_rank == pytest.approx((rank - 1) / (n - 1) if n > 1 else 0) and r.cume_dist == pytest.approx(sum(x >= low(v) for x in values) / n)


def test_small_tables(spark):
    empty = spark.createDataFrame([], "id long, g string, v int")
    one = spark.createDataFrame([(1, "a", 3)], "id long, g string, v int")
    for df, n in ((empty, 0), (one, 1)):
        assert carry.numbered(df, [], [F.asc("v")], tiles=3).count() == n
        assert carry.ranked(df, ["g"], {"v": F.asc("v")}).count() == n
        assert carry.as_of(df, df, ["g"], "v", "id", ["id"]).count() == n
        assert carry.overlapping(df, df, ["g"], "v", "v", 2).count() == n
        assert carry.machine(df.withColumn("e", F.lit(0)), "id", [F.asc("v")], "e", ordered.TABLE, 0).count() == n


def test_as_of(spark, rows):
    left, right = rows[:200], rows[200:]
    schema = "id long, g string, v int"
    found = {r.id: r.last_id for r in carry.as_of(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["g"], "v", "id", ["id"]).collect()}
    assert len(found) == 200
    for k, g, v in left:
        earlier = [(w, i) for i, h, w in right if g is not None and h == g and v is not None and w is not None and w <= v]
        assert found[k] == (max(earlier)[1] if earlier else None)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlapping(spark, width):
    r = random.Random(5)
    spans = [(k, r.choice(["x", "x", "y", None]), (a := r.randrange(-50, 200)), a + r.choice([-1, 0, 1, 5, 60])) for k in range(120)]
    df = spark.createDataFrame(spans, "id long, g string, a long, b long")
    got = sorted((x.id, x.other_id) for x in carry.overlapping(df, df, ["g"], "a", "b", width).collect())
    want = sorted((p[0], q[0]) for p in spans for q in spans if p[1] == q[1] is not None and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3])
    assert got == want


def test_machine(spark):
    r = random.Random(6)
    events = [(k, r.choice([1, 1, 1, 2, 3]), k * 7 % 997, r.randrange(5)) for k in range(600)]
    df = spark.createDataFrame(events, "id long, who long, at long, e int")
    found = {x.id: (x.before, x.after, x.accepted) for x in carry.machine(df, "who", [F.asc("at"), F.asc("id")], "e", ordered.TABLE, ordered.READY).collect()}
    for who in (1, 2, 3):
        state = ordered.READY
        for k, _, _, e in sorted((x for x in events if x[1] == who), key=lambda x: (x[2], x[0])):
            to = ordered.TABLE[e][state]
            assert found[k] == (state, state if to < 0 else to, to >= 0)
            state = state if to < 0 else to


def test_what_a_plan_allows():
    go = lambda *names: [state := ordered.READY] + [state := (lambda t, s: s if t < 0 else t)(ordered.TABLE[ordered.EVENTS.index(n)][state], state) for n in names]
    assert go("view", "click", "error") == [ordered.READY] * 4  # nothing but a start leaves ready
    assert go("signup", "view", "click", "signup", "click")[1:] == [1, 5, 5, 1, 2]  # a paused plan completes no step
    assert go("signup", *["purchase"] * 4, "signup", "error")[-3:] == [ordered.COMPLETED] * 3
    assert go("signup", "view", "error")[-1] == ordered.CANCELLED and go("signup", "error", "signup")[-1] == ordered.FAILED


def test_a_hot_key_lies_in_many_parts(spark):
    df = spark.range(4000).select("id", F.lit("hot").alias("g"))
    parts = carry.dealt(df, ["g"], [F.asc("id")])
    assert parts.select(carry.PART).distinct().count() > 2
    plan = carry.numbered(df, [], [F.asc("id")])._jdf.queryExecution().executedPlan().toString()
    # one task sees the counts, a row for each part, and no rows of the table
    assert len(re.findall("SinglePartition", plan)) == len(re.findall(r"SinglePartition.*\n[^\n]*HashAggregate\(keys=\[_part", plan)) > 0
