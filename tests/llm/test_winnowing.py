import random

import brute
import pytest

from weftline.llm import winnowing


@pytest.fixture(scope="module")
def docs(odd, prose):
    shared = prose(50, 30)
    return odd + [(20 + k, f"{prose(60 + k, 20 + 3 * k)} {shared}") for k in range(12)] + [(40, "A" * 24), (41, "a" * 25), (42, "ab " * 200), (43, "x" * 63), (44, "x" * 64), (45, "x" * 65)]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("k, window", [(25, 40), (3, 1), (5, 4), (7, 64)])
def test_fingerprints(make, docs, k, window):
    found = winnowing.fingerprints(make(docs, "hashes part tail"), k, window)
    want = [(i, len(t or ""), *brute.winnowed(t, k, window)) for i, t in docs]
    assert got(found) == sorted(want, key=str)


@pytest.mark.parametrize("piece", [1 << 20, 100])
def test_compared_with_edits(make, docs, monkeypatch, piece):
    monkeypatch.setattr(winnowing, "PIECE", piece)
    found = winnowing.compared_with_edits(make(docs, "part tail copies _id _text").repartition(5), 9, 12)
    assert got(found) == sorted(brute.compared_with_edits(docs, 9, 12), key=str)


@pytest.mark.parametrize("rows", [[], [(3, "one text alone")], [(3, "the same")] * 7, [(None, None)] * 3])
def test_small_tables(make, rows):
    found = winnowing.compared_with_edits(make(rows), 4, 3)
    assert got(found) == sorted(brute.compared_with_edits(rows, 4, 3), key=str)


def test_a_text_longer_than_a_piece(prose):
    text = prose(70, 300_000) + " " * 70_000 + prose(71, 9)
    assert len(text) > 2 * winnowing.PIECE
    (long,) = winnowing.Winnower()([text])
    whole = winnowing.Winnower()
    codes, at = winnowing._plain(text)
    _, gram, hashes = whole._chosen(codes, winnowing.np.array([0, len(codes)]))
    assert (long[0] == hashes).all() and (long[1] == at[gram]).all()


def test_a_shared_passage_shares_a_hash_at_its_place():
    r = random.Random(3)
    for _ in range(60):
        passage = "".join(r.choice("abcd") for _ in range(12 + 7 - 1))
        texts = ["".join(r.choice("efgh") for _ in range(r.randrange(90))) + passage + "".join(r.choice("ijkl") for _ in range(r.randrange(90))) for _ in range(2)]
        a, b = (dict(zip((p - t.index(passage) for p in at.tolist()), h.tolist())) for t, (h, at) in zip(texts, winnowing.Winnower(12, 7)(texts)))
        assert any(0 <= p <= 6 and b.get(p) == h for p, h in a.items())


def test_the_query_gives_every_document(spark, sf):
    found = winnowing.op13_winnowing(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, found)) == sorted(brute.compared_with_edits(docs, winnowing.K, winnowing.WINDOW))
