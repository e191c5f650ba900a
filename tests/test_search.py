"""Search and nearest neighbours against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import nearest as nn
from weftline.operators import postings, retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(30)] + ["the"] * 30 + ["of"] * 15
    texts = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))) for k in range(300)] + [(900, None), (901, ""), (902, "the " * 50)]
    questions = [(1, "the of"), (2, "the"), (3, "w1 w2 the"), (4, "w3 unknown"), (5, ""), (6, None), (7, "the the of w5 w6 w7 w8"), (8, "THE w9!")]
    return texts, questions, spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame(questions, "q long, ask string")


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def plain_candidates(texts, questions, limit):
    held = {i: Counter(tokens(t)) for i, t in texts}
    size = {i: sum(c.values()) for i, c in held.items()}
    mean = sum(size.values()) / len(texts)
    df = Counter(x for c in held.values() for x in c)
    out = {}
    for q, ask in questions:
        want = set(tokens(ask))
        rows = []
        for i, c in held.items():
            if want and all(x in c for x in want):
                score = sum(max(math.log((len(texts) - df[x] + 0.5) / (df[x] + 0.5)), 1e-6) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for x in want)
                rows.append((round(-score, 9), i))
        out[q] = sorted(rows)[:limit]
    return out


@pytest.mark.parametrize("block_texts", [4096, 20])
def test_every_word_of_every_question(corpus, block_texts):
    texts, questions, docs, asks = corpus
    index = postings.build(docs, "id", F.col("body"), block_texts=block_texts)
    words = postings.asked(index, asks, "q", F.col("ask"))
    got = {}
    for r in postings.candidates(index, words, "q", 7).collect():
        got.setdefault(r.q, []).append((r["rank"], r.id))
    want = {q: rows for q, rows in plain_candidates(texts, questions, 7).items() if rows}
    assert got.keys() == want.keys()
    for q in want:
        assert np.allclose([a for a, _ in sorted(got[q])], [a for a, _ in want[q]], atol=2e-9)
        if want[q][-1][0] < want[q][0][0] - 1:
            assert sorted(i for _, i in got[q]) == sorted(i for _, i in want[q])


def test_blocks_out_of_reach_are_not_searched(spark, monkeypatch):
    texts = [(k, "rare " + "other " * (20 + k % 5) if k % 4 == 0 else "other other") for k in range(200)] + [(777, "rare rare rare")]
    index = postings.build(spark.createDataFrame(texts, "id long, body string"), "id", F.col("body"), block_texts=10)
    searched = []
    scored = postings._scored
    monkeypatch.setattr(postings, "_scored", lambda i, w, q, lists, blocks: searched.append(blocks.count()) or scored(i, w, q, lists, blocks))
    words = postings.asked(index, spark.createDataFrame([(1, "rare")], "q long, ask string"), "q", F.col("ask"))
    assert [r.id for r in postings.candidates(index, words, "q", 1).collect()] == [777]
    assert searched == [1, 0] and index.table("postings").filter("term = 'rare'").count() > 10


def test_a_question_reads_its_terms_only(spark, corpus):
    _, _, docs, asks = corpus
    index = postings.build(docs, "id", F.col("body"))
    words = postings.asked(index, asks, "q", F.col("ask"))
    plan = postings._bounded(index, words, "q", True)._jdf.queryExecution().executedPlan().toString()
    assert "docs#" not in plan and "dynamicpruning" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_an_empty_index(spark):
    index = postings.build(spark.createDataFrame([], "id long, body string"), "id", F.col("body"))
    asks = spark.createDataFrame([(1, "the")], "q long, ask string")
    assert postings.search(index, asks, "q", F.col("ask"), 5, 50, 0.3).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<float>")


def plain_nearest(queries, base, k, threshold):
    def cosine(a, b):
        a, b = np.array(a, "f4").astype(float), np.array(b, "f4").astype(float)
        size = math.sqrt((a * a).sum()) * math.sqrt((b * b).sum()) if len(a) == len(b) else 0
        return a @ b / size if size else 0.0

    out = []
    for q, v in queries:
        rows = sorted((-cosine(v, w), i) for i, w in base if w is not None) if v is not None else []
        out += [(q, i, n + 1) for n, (s, i) in enumerate(r for r in rows if threshold is None or -r[0] >= threshold) if n < k]
    return sorted(out)


@pytest.mark.parametrize("threshold", [None, 0.2])
@pytest.mark.parametrize("block, broadcast_blocks", [(2048, 32), (7, 32), (7, 0)])
def test_nearest(spark, monkeypatch, threshold, block, broadcast_blocks):
    monkeypatch.setattr(nn, "packed", lambda df, key, vector, pack=nn.packed: pack(df, key, vector, block))
    r = np.random.default_rng(2)
    base = [(k, r.normal(size=8).tolist()) for k in range(200)] + [(500, None), (501, [0.0] * 8), (502, [1.0, 2.0]), (503, []), (504, base_copy := r.normal(size=8).tolist()), (505, base_copy)]
    queries = [(k, r.normal(size=8).tolist()) for k in range(20)] + [(50, base_copy), (51, [0.0] * 8), (52, [1.0, 2.0]), (53, None)]
    found = nn.nearest(vectors(spark, queries).repartition(3), "id", "v", vectors(spark, base).repartition(4), "id", "v", 5, threshold, broadcast_blocks)
    assert sorted((x.query_id, x.id, x["rank"]) for x in found.collect()) == plain_nearest(queries, base, 5, threshold)


def test_nearest_of_nothing(spark):
    some, none = vectors(spark, [(1, [1.0])]), vectors(spark, [])
    assert nn.nearest(none, "id", "v", some, "id", "v", 3).collect() == []
    assert nn.nearest(some, "id", "v", none, "id", "v", 3).collect() == []


def test_nearest_joins_no_loops(spark):
    some = vectors(spark, [(k, [1.0, float(k)]) for k in range(9)])
    for blocks in (32, 0):
        plan = nn.nearest(some, "id", "v", some, "id", "v", 3, None, blocks)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_terms_are_counted_where_the_texts_are(spark):
    texts = [(k, t) for k, t in enumerate([None, "", "Été été ete x1", "of the the of a " * 9, "日本 日本 ß"])] + [(9 + k, f"w{k} w{k % 7} the") for k in range(50)]
    docs = spark.createDataFrame(texts, "id long, body string")
    rows = postings.all_terms(docs, "id", F.col("body"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    found = {r.id: r for r in rows.collect()}
    assert set(found) == {i for i, _ in texts} and found[1].terms == {} and found[1].vector == [0.0] * 64
    table = retrieval.term_table(docs.na.fill(""), "id", F.col("body"))
    for r in postings.dense(table, "id", F.col("tf")).collect():
        assert found[r.id].vector == r.vector
    want = {}
    for r in table.collect():
        want.setdefault(r.id, {})[r.term] = r.tf
        assert found[r.id].dl == r.dl
    assert {i: r.terms for i, r in found.items() if r.dl} == want
    assert postings.own_terms(docs, "id", F.col("body")).count() == len(want)


def test_questions_of_the_same_words_are_answered_once_from_the_lists(spark, corpus, monkeypatch):
    texts, _, docs, _ = corpus
    index = postings.build(docs, "id", F.col("body"), block_texts=50)
    monkeypatch.setattr(postings, "QUESTIONS_AT_ONCE", 1)
    scored, seen = postings._scored, []

    def watched(i, w, q, lists, blocks):
        out = scored(i, w, q, lists, blocks)
        seen.append((w.count(), "/texts" in "".join(out.inputFiles())))
        return out

    monkeypatch.setattr(postings, "_scored", watched)
    asks = [(1, "w1 the"), (2, "THE w1"), (3, "the w1 w1"), (4, "w2")]
    words = postings.asked(index, spark.createDataFrame(asks, "q long, ask string"), "q", F.col("ask"))
    got = {}
    for r in postings.candidates(index, words, "q", 5).collect():
        got.setdefault(r.q, []).append((r["rank"], r.id))
    want = plain_candidates(texts, asks, 5)
    assert seen == [(2, False)] * 2 and sorted(got[1]) == sorted(got[2]) == sorted(got[3])
    assert all(np.allclose([a for a, _ in sorted(got[q])], [a for a, _ in want[q]], atol=2e-9) for q in want)


def test_a_list_names_texts_by_places_of_two_bytes(spark):
    texts = [(-7, "often " * 70_000 + "x"), (1 << 40, "often " * 300 + "y x"), (3, "often y"), (4, None), (5, "x")]
    docs = spark.createDataFrame(texts, "id long, body string").coalesce(1)
    index = postings.build(docs, "id", F.col("body"), block_texts=2)
    rows = index.table("postings").collect()
    own = {r.block: np.frombuffer(r.docs, "<i8").tolist() for r in rows if r.term is None}
    size = {k: n for r in rows if r.term is None for k, n in zip(own[r.block], np.frombuffer(r.tfs, "<i4").tolist())}
    assert max(map(len, own.values())) <= 2
    got = Counter()
    for r in rows:
        if r.term is not None:
            assert len(r.docs) == 2 * r.n and len(r.tfs) // r.n == (1 if r.max_tf < 256 else 2 if r.max_tf < 65536 else 4)
            counts = np.frombuffer(r.tfs, f"<u{len(r.tfs) // r.n}").tolist()
            held = [own[r.block][p] for p in np.cumsum(np.frombuffer(r.docs, "<u2"))]
            assert max(counts) == r.max_tf and min(size[k] for k in held) == r.min_dl
            got.update({(r.term, k): n for k, n in zip(held, counts)})
    assert got == Counter({(w, k): n for k, t in texts for w, n in Counter(tokens(t)).items()})
    asks = [(1, "often"), (2, "often x"), (3, "y x often"), (4, "x")]
    words = postings.asked(index, spark.createDataFrame(asks, "q long, ask string"), "q", F.col("ask"))
    found = sorted((r.q, r["rank"], r.id) for r in postings.candidates(index, words, "q", 2).collect())
    want = sorted((q, *row) for q, some in plain_candidates(texts, asks, 2).items() for row in some)
    assert [(q, i) for q, _, i in found] == [(q, i) for q, _, i in want] and np.allclose([r for _, r, _ in found], [r for _, r, _ in want], atol=2e-9)


def test_blocks_end_before_they_have_too_many_terms(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_TERMS", 10)
    rows = [pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([n] * 6, pa.int32()), pa.array([[f"w{k}" for k in range(n)]] * 6), pa.array([[1] * n] * 6)], names=["doc", "dl", "words", "counts"]) for n in (4, 25)]
    blocks = [np.frombuffer(r["docs"], "<i8").tolist() for b in postings._posted(5)(iter(rows)) for r in b.to_pylist() if r["term"] is None]
    assert [k for b in blocks for k in b] == [*range(6)] * 2 and max(map(len, blocks)) == 3 and blocks[-5:] == [[1], [2], [3], [4], [5]]
