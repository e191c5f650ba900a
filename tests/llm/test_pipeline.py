import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import jaccard
from weftline.session import cut_lineage


@pytest.fixture(scope="module")
def folder(spark, make, prose, tmp_path_factory):
    """A folder of tables with planted cases."""
    at = tmp_path_factory.mktemp("sf")
    clean = [(k, prose(1000 + k, 80 + k % 60)) for k in range(120)]
    junk = [(200 + k, " ".join(x.upper() + "!!" for x in prose(2000 + k, 60).split())) for k in range(40)]
    copies = [(300 + k, clean[k % 5][1]) for k in range(20)]
    near = [(400 + k, clean[20 + k][1].replace(" ", " changed ", 1)) for k in range(20)]
    passage = prose(5000, 70)
    shared = [(500 + k, f"{prose(5100 + k, 60)} {passage} {prose(5200 + k, 60)}") for k in range(10)]
    items = [(k, prose(6000 + k, 25)) for k in range(5)]
    leaks = [(600 + k, f"{prose(6100 + k, 60)} {items[k][1]} {prose(6200 + k, 40)}") for k in range(5)]
    odd = [(None, prose(7000, 90)), (None, None), (700, ""), (701, None), (702, prose(7001, 90)), (702, prose(7001, 90))]
    docs = make(clean + junk + copies + near + shared + leaks + odd)
    docs.write.parquet(f"{at}/documents.parquet")
    labels = [(k, 1, 0) for k, _ in clean] + [(k, 0, 0) for k, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"_key": F.lit("x"), "rest": F.lit(1), "score": F.lit(1)})
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut_lineage(stage(spark, docs, folder), "stage")
        kept.append(docs)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert docs.dtypes == before.select(*corpus_pipeline.COLUMNS).dtypes
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert not ids[0] & set(range(200, 240)) and set(range(120)) <= ids[0]
    assert not ids[1] & (set(range(300, 320)) | set(range(400, 420))) and set(range(120)) <= ids[1]
    assert kept[1].filter("doc_id = 702").count() == 1 and None in ids[1]
    texts = {r.doc_id: r.text for r in kept[2].collect()}
    passage = brute.words([r.text for r in kept[1].filter("doc_id = 500").collect()][0])[60:130]
    assert " ".join(passage) in texts[500] and not any(" ".join(passage[10:60]) in texts[k] for k in range(501, 510))
    assert all(texts[k] == r.text for r in kept[1].filter("doc_id < 120").collect() for k in [r.doc_id])
    assert ids[2] - ids[3] == set(range(600, 605))
    assert {r.doc_id for r in kept[4].collect()} == ids[3]


def test_run_gives_what_the_stages_give(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, folder), "stage")
    run = corpus_pipeline.run(spark, folder)
    total = lambda df: sorted((r.doc_id or -1, r.n) for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect())
    assert total(run) == total(docs)


def test_empty_tables(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_several_texts_of_one_id(spark, make, prose, tmp_path):
    a, b, item = prose(7100, 90), prose(7101, 90), prose(7102, 25)
    docs = make([(3, b), (5, a), (5, b), (8, prose(7103, 60)), (8, f"{prose(7104, 40)} {item} {prose(7105, 30)}"), (9, a + " end"), (9, a)])
    kept = corpus_pipeline.near(spark, docs, "")
    assert sorted((r.doc_id, r.text == b) for r in kept.filter("doc_id <> 8").collect()) == [(3, True), (5, False)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.text for r in corpus_pipeline.leaks(spark, docs.filter("doc_id = 8"), str(tmp_path)).collect()] == [prose(7103, 60)]


def _shingles(text):
    w = brute.words(brute.lower(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("pairwise, cells", [(48, None), (1, None), (3, 8)])
def test_near_duplicates_are_exact(make, prose, odd, monkeypatch, pairwise, cells):
    monkeypatch.setattr(jaccard, "PAIRWISE", pairwise)
    r, docs, passage = random.Random(4), list(odd), prose(8999, 40)
    for k in range(120):  # similarities of about 0.7 to 0.95, a group of copies, a passage in many texts
        w = prose(9000 + k, 300).split()
        v = list(w)
        for at in r.sample(range(300), 2 + k % 12):
            v[at] = "changed"
        docs += [(1000 + 2 * k, " ".join(w)), (1001 + 2 * k, " ".join(v))]
    for k in range(40):
        w = prose(9500, 150).split()
        for at in r.sample(range(150), 3):
            w[at] = f"own{k}"
        docs += [(2000 + k, " ".join(w)), (3000 + k, f"{passage} {prose(9600 + k, 5 + k % 9)}")]
    sets = [_shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [root[b] if x == root[a] else x for x in root]
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    found = jaccard.near_duplicates(make(docs, "node n keys key root"), log2_cells=cells, **corpus_pipeline.NEAR).select("doc_id", "component_id")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((i, least.get(root[k])) for k, (i, _) in enumerate(docs)), key=str)


def test_near_links_fingerprints_within_the_radius(make, prose):
    r, docs = random.Random(6), []
    for k in range(60):  # from the same text to far from it
        w = prose(9700 + k, 120).split()
        docs.append((2 * k, " ".join(w)))
        for at in r.sample(range(120), k % 8):
            w[at] = f"own{k}"
        docs.append((2 * k + 1, " ".join(w)))
    docs += [(500 + k, prose(9800, 150) + f" end{k}" * (1 + k % 2)) for k in range(60)]
    prints = [brute.fingerprint(t, corpus_pipeline.PRINTS["shingle"]) for _, t in docs]
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= corpus_pipeline.PRINTS["radius"] and root[a] != root[b]:
                root = [root[b] if x == root[a] else x for x in root]
    firsts = {}
    for k, (i, _) in enumerate(docs):
        firsts[root[k]] = min(firsts.get(root[k], i), i)
    assert len(firsts) < len(docs) - 60
    assert sorted(x.doc_id for x in corpus_pipeline.near(None, make(docs), "").collect()) == sorted(firsts.values())
