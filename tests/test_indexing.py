"""The chunk index: batches, restarts and repeats against one full build."""

import pytest

from weftline.streaming.reindex import ChunkIndex, change_stream

SCHEMA = "file_id long, version long, text string"


def state(index):
    chunks = sorted(map(tuple, index.chunks().select("file_id", "version", "chunk_no", "line_start", "line_end", "text").collect()))
    return chunks, sorted(map(tuple, index.files().collect())), sorted(r.hash for r in index.vectors().collect())


@pytest.fixture(scope="module")
def batches():
    long = "\n".join(f"line {k}" for k in range(7))
    return [
        [(1, 1, long), (2, 1, "two"), (3, 1, ""), (4, 1, "gone soon"), (None, 1, "x"), (9, None, "x")],
        [(1, 3, long + "\nlast"), (2, 2, None), (5, 1, "two"), (5, 2, "five"), (5, 2, "fives")],
        [(1, 2, "late"), (4, 2, None), (2, 1, "late too"), (6, 1, "six")],
    ]


def test_batches_give_what_one_build_gives(spark, batches, tmp_path):
    parts = ChunkIndex(spark, f"{tmp_path}/parts", window=3, buckets=4)
    for k, rows in enumerate(batches):
        parts.apply(spark.createDataFrame(rows, SCHEMA), k)
    whole = ChunkIndex(spark, f"{tmp_path}/whole", window=3, buckets=4)
    whole.apply(spark.createDataFrame(sum(batches, []), SCHEMA), 0)
    chunks, files, vectors = state(parts)
    assert (chunks, files) == state(whole)[:2]
    assert [(c[0], c[1]) for c in chunks if c[2] == 0] == [(1, 3), (3, 1), (5, 2), (6, 1)]
    assert [c[5] for c in chunks if c[0] == 1] == ["line 0\nline 1\nline 2", "line 3\nline 4\nline 5", "line 6\nlast"]
    assert [c[5] for c in chunks if c[0] == 5] == ["fives"]
    assert (2, 2, False) in files and (4, 2, False) in files
    before = state(parts)
    for k, rows in enumerate(batches):  # run again
        parts.apply(spark.createDataFrame(rows, SCHEMA), k)
    assert state(parts) == before
    assert [r.embedded for r in parts.reports().orderBy("batch_id").collect()] == [0, 0, 0]
    assert len(vectors) == len(set(vectors)) and set(state(whole)[2]) <= set(vectors)


def test_a_stream_goes_on_after_a_restart(spark, batches, tmp_path):
    index = ChunkIndex(spark, f"{tmp_path}/index", window=3, buckets=4)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
        if k != 1:
            index.follow(change_stream(spark, f"{tmp_path}/changes"), f"{tmp_path}/checkpoint")
    whole = ChunkIndex(spark, f"{tmp_path}/whole", window=3, buckets=4)
    whole.apply(spark.createDataFrame(sum(batches, []), SCHEMA), 0)
    assert state(index)[:2] == state(whole)[:2]
    reports = index.reports().orderBy("batch_id").collect()
    assert [r.files_modified for r in reports] == [4, 2, 1] and [r.files_deleted for r in reports] == [0, 1, 1]


def test_a_failed_model_leaves_the_index_as_it_was(spark, batches, tmp_path):
    good = ChunkIndex(spark, f"{tmp_path}/index", window=3, buckets=4)
    good.apply(spark.createDataFrame(batches[0], SCHEMA), 0)
    before = state(good)

    def broken(texts):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        ChunkIndex(spark, good.path, 3, 4, broken).apply(spark.createDataFrame(batches[1], SCHEMA), 1)
    assert state(good) == before
    good.apply(spark.createDataFrame(batches[1], SCHEMA), 1)
    assert {(f[0], f[2]) for f in state(good)[1]} == {(1, True), (2, False), (3, True), (4, True), (5, True)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    index = ChunkIndex(spark, f"{tmp_path}/index", buckets=8)
    index.apply(spark.createDataFrame([(k, 1, f"text {k}") for k in range(40)], SCHEMA), 0)
    names = {str(p) for p in tmp_path.glob("index/chunks/bucket=*/*.parquet")}
    index.apply(spark.createDataFrame([(3, 2, "other")], SCHEMA), 1)
    now = {str(p) for p in tmp_path.glob("index/chunks/bucket=*/*.parquet")}
    assert len({p.split("/")[-2] for p in now - names}) == 1 and len({p.split("/")[-2] for p in names & now}) == 7


def test_no_changes(spark, tmp_path):
    index = ChunkIndex(spark, f"{tmp_path}/index")
    index.apply(spark.createDataFrame([], SCHEMA), 0)
    assert state(index) == ([], [], []) and index.reports().count() == 0


def test_more_files_are_not_more_batches(spark, tmp_path):
    from weftline.plans.indexing import _followed

    docs = spark.range(60).selectExpr("id AS doc_id", "concat('text ', id % 50) AS text")
    docs.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    index = _followed(spark, str(tmp_path))
    assert index.reports().count() == 3
    assert index.files().count() == 60 and index.files().filter("present").count() == 51
