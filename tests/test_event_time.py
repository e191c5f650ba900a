"""State that ends by itself, over several batches with a restart."""

import datetime
import random

from pyspark.sql import functions as F

from weftline.streaming import event_time

ZERO = datetime.datetime(2024, 1, 1)


def at(seconds):
    return ZERO + datetime.timedelta(seconds=seconds)


def follow(spark, folder, schema, batches, job, runs=(1,)):
    """Files one after the other; the stream is started again after the batches in ``runs`` and at the end."""
    found = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k in runs or k == len(batches) - 1:
            found = event_time.run(job(event_time.files_in_order(spark, f"{folder}/in", schema)), f"{folder}/out", f"{folder}/checkpoint")
    return sorted(map(tuple, found.collect()))


def test_a_value_lives_for_sixty_seconds(spark, tmp_path):
    batches = [
        [(2, 1, at(30)), (1, 1, at(0)), (3, 2, at(5))],  # out of order within a batch
        [(4, 1, at(59.999)), (5, 1, at(60)), (6, 2, at(64))],
        [(7, 1, at(119)), (8, 1, at(121)), (9, 2, at(4000))],
        [(10, 1, at(4001)), (11, 1, at(130)), (12, 2, at(4059))],  # 11 is behind the watermark
    ]
    got = follow(spark, tmp_path, "event_id long, user_id long, ts timestamp", batches, lambda s: event_time.cached(s, "user_id", 60_000, "10 seconds"))
    hits = {i: h for i, _, h in got}
    assert hits == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True, 8: False, 9: False, 10: False, 12: True} | ({11: hits[11]} if 11 in hits else {})


def test_unfinished_responses_end_by_rule(spark, tmp_path):
    batches = [
        [(1, 1, at(0), "a", False), (2, 1, at(1), "b", True), (3, 1, at(2), "c", False), (4, 2, at(2), "x", False)],
        [(5, 1, at(3), "d", False), (6, 3, at(10), "p", False)],
        [(7, 3, at(500), "q", True), (8, 1, at(501), "e", False)],  # both keys' open texts are older than the gap
        [(9, 1, at(502), "f", True), (10, 4, at(2000), "end", True)],
    ]
    job = lambda s: event_time.responses(s, "user_id", 60_000, "10 seconds")
    got = follow(spark, tmp_path, "event_id long, user_id long, ts timestamp, content string, done boolean", batches, job)
    assert got == sorted([(1, 2, "ab", True), (1, 2, "cd", False), (1, 2, "ef", True), (2, 1, "x", False), (3, 1, "p", False), (3, 1, "q", True), (4, 1, "end", True)])


def test_rows_behind_the_watermark_change_nothing(spark, tmp_path):
    batches = [[(1, "a", at(0)), (2, "a", at(50))], [(3, "a", at(1000))], [(4, "a", at(2000)), (5, "b", at(1))], [(6, "a", at(3000)), (7, "b", at(2))]]
    got = follow(spark, tmp_path, "event_id long, kind string, ts timestamp", batches, lambda s: event_time.windows(s.withColumn("v", F.lit(1.0)), "ts", ["kind"], "v", "100 seconds", "10 seconds"))
    assert [(r[0] - ZERO).total_seconds() for r in got] == [0, 1000, 2000] and {r[2] for r in got} == {"a"} and got[0][3] == 2


def test_keys_of_one_bucket_keep_their_own_state(spark, tmp_path):
    r, keys = random.Random(3), [None, 7, -1, 0, (1 << 60) + 1, (1 << 60) + 2, *range(100, 130)]
    times = sorted(r.randrange(0, 4000) for _ in range(400))
    rows = [(n, r.choice(keys), at(t), f"{n},", r.random() < 0.3) for n, t in enumerate(times)] + [(900, 1 << 61, at(4300), "end", True)]
    batches = [[x for x in rows if 1000 * b <= (x[2] - ZERO).total_seconds() < 1000 * (b + 1)] for b in range(5)]
    schema = "event_id long, user_id long, ts timestamp, content string, done boolean"
    got = follow(spark, tmp_path / "a", schema, batches, lambda s: event_time.cached(s.select("event_id", "user_id", "ts"), "user_id", 300_000, "1 second", buckets=2), (0, 2))
    loaded, want = {}, []
    for n, k, t, _, _ in rows:
        hit = k in loaded and (t - loaded[k]).total_seconds() < 300
        loaded[k] = loaded[k] if hit else t
        want.append((n, k, hit))
    assert got == want
    batches = [[x for x in b if x[1] is not None] for b in batches]
    got = follow(spark, tmp_path / "b", schema, batches, lambda s: event_time.responses(s, "user_id", 300_000, "1 second", buckets=2), (0, 2))
    held, want = {}, []
    for n, k, t, text, done in (x for x in rows if x[1] is not None):
        last, parts = held.pop(k, (t, []))
        if (t - last).total_seconds() > 300:
            want.append((k, len(parts), "".join(parts), False))
            parts = []
        if done:
            want.append((k, len(parts) + 1, "".join([*parts, text]), True))
        else:
            held[k] = t, [*parts, text]
    want += [(k, len(parts), "".join(parts), False) for k, (last, parts) in held.items() if last < at(4300 - 1 - 300)]
    assert got == sorted(want)


def test_all_new_files_are_one_batch(spark, tmp_path):
    spark.range(40).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = event_time.files_in_order(spark, f"{tmp_path}/in", "id long", None)
    job = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    assert [p.numInputRows for p in job.recentProgress] == [40] and spark.read.parquet(f"{tmp_path}/out").count() == 40
