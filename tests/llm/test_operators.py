import cProfile
import itertools
import math
import random
import tracemalloc
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import classifier, decontamination, divergence, huffman, katz, packing, sharding, simhash, sketch, substring_dedup, suffix_dedup, tokens


LIBRARY = Tokenizer.from_file(tokens.TOKENIZER)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def mixed(odd, prose):
    """The odd rows, copies, near copies, and a passage that many texts share."""
    passage = prose(99, 70)
    shared = [(100 + k, f"{prose(200 + k, 30 + k)} {passage} {prose(300 + k, 25)}") for k in range(30)]
    copies = [(200 + k, prose(7, 90)) for k in range(6)]
    near = [(300 + k, prose(7, 90).replace(" ", f" z{k} ", 1 + k % 2)) for k in range(6)]
    return odd + shared + copies + near


def test_substring_dedup(make, mixed):
    found = substring_dedup.without_repeated_windows(make(mixed, "_id _text h bucket found"), log2_cells=16)
    want = sorted(brute.kept_words(mixed), key=str)
    assert rows(found, "doc_id", "n_words", "n_removed", "text") == want


def test_substring_dedup_with_a_sketch_that_is_full(make, mixed):
    found = substring_dedup.without_repeated_windows(make(mixed), log2_cells=4)
    assert rows(found, "doc_id", "n_words", "n_removed", "text") == sorted(brute.kept_words(mixed), key=str)


@pytest.mark.parametrize("hot", [240, 1])
@pytest.mark.parametrize("keep_first", [False, True])
def test_suffix_dedup(make, mixed, monkeypatch, hot, keep_first):
    monkeypatch.setattr(sketch, "HOT", hot)
    texts = [x for x in mixed if x != (5, mixed[7][1])]  # texts of one doc_id are ordered by hash
    found = suffix_dedup.without_repeats(make(texts, "_id rest h at"), keep_first=keep_first, log2_cells=14)
    want = sorted(((i, n, r, s, bytearray(b)) for i, n, r, s, b in brute.kept_bytes(texts, keep_first=keep_first)), key=str)
    assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == want


def test_suffix_dedup_keeps_characters_whole(make):
    text = "é" * 300
    found = suffix_dedup.without_repeats(make([(1, text), (2, "a" + text)]), log2_cells=10).collect()
    assert all(set(r.text) <= {"é", "a"} for r in found)


def test_tasks_of_suffix_dedup_hold_little(prose):
    import tokenizers

    texts = pa.array([prose(k, 3000) for k in range(220)])
    n = len(texts)
    cut = pa.record_batch([texts, pa.array(range(n)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.string())], names=["_text", "_id", "runs", "rest"])
    made = tokenizers.__dict__.setdefault("_encoders", {})
    made["left by another step"] = None
    tracemalloc.start()
    try:
        assert sum(map(len, suffix_dedup._anchor_hashes(200)(iter([pa.record_batch([texts], names=["_text"])])))) > 1000
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 << 20 and not made
    parts = list(suffix_dedup._cut(iter([cut])))
    assert len(parts) > 2 and pa.Table.from_batches(parts).column("text").combine_chunks().to_pylist() == texts.to_pylist()


@pytest.mark.parametrize("limit", [50_000, 1])
def test_simhash(make, mixed, limit):
    found = simhash.near_duplicates(make(mixed, "fingerprint node fp"), bucket_limit=limit)
    want = sorted(((i, int(np.array(f, np.uint64).view(np.int64)), c) for i, f, c in brute.component_ids(mixed)), key=str)
    assert rows(found, "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_the_radius(radius):
    rng = np.random.default_rng(5)
    masks = simhash.covering_masks(list(range(64)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        differing = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(not m & differing for m in masks)


def test_large_buckets_are_connected_as_by_all_pairs():
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 1 << 12, 500).astype(np.uint64))
    a, b = simhash._grown(fp.view(np.int64), fp[None, :], 1)
    _, mine = simhash._forest(a, b)
    x, y = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 1, 1))
    child, root = simhash._forest(fp[x].view(np.int64), fp[y].view(np.int64))
    got = dict(zip(*simhash._forest(a, b)))
    assert got == dict(zip(child, root)) and len(mine)


def test_divergence_counts(make, mixed):
    found = divergence.judged(make(mixed, "words c chars"))
    want = sorted(((i, *brute.quality_counts(t)) for i, t in mixed), key=str)
    assert rows(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in found.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed) and (r.n_words >= divergence.MIN_WORDS or r.kept == (not r.base_failed))


def test_divergence_drops_what_is_far_from_its_language(spark, make):
    clean = [(k, " ".join(["the", f"word{k}a", "of", "a", f"thing{k}", "and", "it", "was"] * 3 + [f"x{j}y{k}" for j in range(40)])) for k in range(40)]
    junk = [(100, " ".join(f"{x}###$$$%%%&&&" for x in "abcdefghijklmnopqrstuvwxyz" * 3))]
    kept = {r.doc_id: r.kept for r in divergence.judged(make(clean + junk).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))).collect()}
    assert not kept[100]


def test_js_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5])], "p array<double>, q array<double>")
    assert [r.d for r in df.select(divergence.js_distance(F.col("p"), F.col("q")).alias("d")).collect()] == [1.0, 0.0]


def test_decontamination(spark, make, prose, mixed):
    items = [(k, prose(400 + k, 20 + k)) for k in range(8)] + [(50, None), (51, "too short"), (None, prose(450, 30)), (1, prose(401, 21)), (60, prose(460, 10))]
    items += [(70, prose(470, 8)), (71, prose(471, 6)), (72, prose(472, 5)), (73, "one two three four")]
    changed = items[2][1].split()
    changed[5], changed[14] = "other", "words"
    texts = mixed + [(500, "Start " + items[0][1].upper() + " end"), (501, prose(1, 30) + " " + " ".join(changed)), (502, items[1][1]), (503, items[10][1]), (504, items[12][1]), (505, prose(3, 99))]
    texts += [(506, prose(470, 8)), (507, f"a {prose(471, 6)} b {prose(471, 6)}"), (508, prose(471, 6).replace(" ", " other ", 1)), (509, prose(472, 5)), (510, "one two three four")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("seed", F.lit("x"))
    found = decontamination.contaminated(make(texts, "mask seed around d i"), bench)
    want = brute.overlaps(texts, items, decontamination.MASKS, decontamination.SPAN, decontamination.WINDOW, decontamination.SIMILARITY, decontamination.SHORTEST)
    assert rows(found, "doc_id", "item_id", "n_hits", "n_equal") == want
    assert {(500, 0), (501, 2), (502, 1), (503, None), (504, 60), (506, 70), (507, 71), (509, 72)} <= {r[:2] for r in want}
    assert not any(r[0] in (505, 508, 510) for r in want)


def test_decontamination_finds_every_pattern_of_changed_words(spark, make, prose):
    items, texts = [], []
    for n in range(9, 14):
        items.append((n, prose(900 + n, n)))
        for out in itertools.combinations(range(n), n - math.ceil(n * decontamination.SIMILARITY - 1e-9)):
            w = ["other" if k in out else x for k, x in enumerate(items[-1][1].split())]
            texts.append((n * 1000 + len(texts), " ".join(["before", *w, "after"])))
    found = decontamination.contaminated(make(texts), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found, "doc_id", "item_id") == sorted(((i, i // 1000) for i, _ in texts), key=str) and len(texts) == 253


def test_classifier(spark, make, prose, odd):
    good = [(k, prose(k, 40 + k % 50)) for k in range(300)]
    bad = [(1000 + k, " ".join(x.upper() + "!!" for x in prose(k, 60).split())) for k in range(100)]
    docs = make(good + bad + [(k and k + 5000, t) for k, t in odd], "score at")
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good if k % 3] + [(k, 0, 0) for k, _ in bad if k % 3] + [(7, None, 0), (8, 5, 0), (None, 1, 0), (1001, 0, 0)], "doc_id long, quality int, toxic int")
    weights = classifier.train(docs, labels)
    got = {r.doc_id: r.score for r in classifier.scored(docs, weights).collect()}
    right = [(got[k] >= 0.5) == (k < 1000) for k, _ in good + bad if k % 3 == 0]
    assert sum(right) / len(right) > 0.95 and all(0 <= s <= 1 for s in got.values())
    same = {r.doc_id: r.score for r in classifier.scored(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)), weights).collect()}
    assert same == got


def test_classifier_without_labels(spark, make):
    docs = make([(1, "a text"), (2, None)])
    weights = classifier.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in classifier.scored(docs, weights).collect()} == {0.5}


@pytest.mark.parametrize("hot, size", [(1 << 20, None), (30, 500)])
def test_katz(make, mixed, monkeypatch, hot, size):
    if size:
        for name in ("BLOCK_TOKENS", "BUCKET_WORDS", "BUCKET_PAIRS"):
            monkeypatch.setattr(katz, name, size)
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(True))
    found, total = katz.scored(make(mixed, "train block words"), train, hot)
    want, total_, sums = brute.katz(mixed, katz.discounts, hot)
    assert total == total_ and max(abs(s - 1) for s in sums) < 1e-9
    got = sorted(((None if r._id == brute.NONE else r._id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in found.collect()), key=str)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9)
        assert math.isclose(g[5], w[5], rel_tol=1e-9)


def test_good_turing_discounts():
    d = katz.discounts([1000, 400, 200, 120, 80, 50])
    assert all(0 < x < 1 for x in d[1:]) and katz.discounts([0] * 6)[1:] == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]


@pytest.mark.parametrize("n, smooth_from", [
    ([1655711, 262472, 56325, 23262, 20048, 8151], 4),  # bigrams of sf0.1: groups of copies lift n5
    ([1000, 400, 900, 120, 80, 50], 2), ([1000, 1200, 200, 120, 80, 50], 1), ([1000, 400, 200, 0, 80, 50], 3), ([1000, 400, 200, 120, 80, 150], 1),
])
def test_good_turing_discounts_of_copies(n, smooth_from):
    d = katz.discounts(n)
    tail = 6 * n[5] / n[0]
    for r in range(1, smooth_from):
        assert math.isclose(d[r], ((r + 1) * n[r] / n[r - 1] / r - tail) / (1 - tail))
    slope = np.polyfit(np.log([r for r in range(1, 7) if n[r - 1]]), np.log([x * (2 / 3 if n[3] == 0 and r in (3, 5) else 1) for r, x in enumerate(n, 1) if x]), 1)[0] + 1
    for r in range(smooth_from, 6):
        assert math.isclose(d[r], ((1 + 1 / r) ** slope - 6**slope) / (1 - 6**slope))
    assert all(0 < x < 1 for x in d[1:])


def test_good_turing_falls_back_for_what_stays_invalid():
    assert katz.discounts([0, 400, 200, 120, 80, 50])[1:] == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]
    assert katz.discounts([10, 20, 30, 40, 50, 60])[1:] == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]


def encoded(text, end):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("weights", [None, {"src0": 1, None: 3, "b": 2}])
def test_packing(make, mixed, weights):
    docs = make(mixed, "part before n").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "b").when(F.col("doc_id") % 3 == 1, F.lit("src0")))
    pieces = packing.packed(docs, weights, length=128).collect()
    assert sum(r.length for r in pieces) == sum(len(encoded(t, 1)) for _, t in mixed)
    want = sorted((i is None, i or 0, zlib.crc32(encoded(t, 1).tobytes()), len(encoded(t, 1))) for i, t in mixed)
    by, got = {}, []
    for r in sorted(pieces, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.doc_tokens, r.start)):
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    once = {k: v for k, v in by.items() if sum(r.start == 0 for r in v) == 1}
    for (i, n), parts in once.items():
        raw = b"".join(bytes(r.ids) for r in parts)
        assert [r.start for r in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        got.append((i is None, i or 0, zlib.crc32(raw), n))
    assert set(got) <= set(want) and len(got) > 40
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 128 or s == len(sequences) - 1


def test_mixture_keeps_its_targets():
    mixture = packing.Mixture([5000, 3000, 200, 0, 40], [5, 3, 1, 7, 1], 64)
    before = [0] * 5
    for w in range(1, 130):
        given = mixture.given(w)
        assert all(a >= b for a, b in zip(given, before)) and sum(given) == min(64 * w, 8240)
        if w < 6:
            assert all(abs(g - 64 * w * s / 10) <= 4 for g, s in zip(given, (5, 3, 1, 0, 1)))
        before = given
    assert before == [5000, 3000, 200, 0, 40]


def test_encoder_agrees_with_the_library(odd, prose):
    e = tokens.encoder(tokens.TOKENIZER)
    odd_texts = [t or "" for _, t in odd] + [" a  b ", "a\n b \n\n c", "x  y 　z", "don't we'll I'M", "a\x1c b \x1d", "<|endoftext|> a", " ", "a\u0085 b", "日本 語 😀a", "x" * 500]
    for text in odd_texts + [prose(k, 50) for k in range(5)]:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [128, tokens.CHUNK])
def test_encoder_agrees_with_the_library_on_random_characters(monkeypatch, chunk):
    import random

    import pyarrow as pa

    monkeypatch.setattr(tokens, "CHUNK", chunk)
    e, r = tokens.Encoder(tokens.TOKENIZER), random.Random(chunk)
    some = [*"abA12 .,'é×÷日  \n\t\u0085\u3000\u2003“–ß😀\x1c\x7f", "<|endoftext|>", "<|end", " 's", "don't ", "\n"]
    texts = ["".join(r.choice(some) for _ in range(r.choice([0, 5, 30, 400]))) for _ in range(400)] + ["a" * 1000, None]
    at_row = 0
    for a, b, ids, at in e.encode_column(pa.array(texts, pa.string()), 7):
        assert a == at_row and len(at) == b - a + 1
        at_row = b
        for k in range(b - a):
            assert ids[at[k] : at[k + 1]].tolist() == [*LIBRARY.encode(texts[a + k] or "", add_special_tokens=False).ids, 7]
    assert at_row == len(texts)


def test_encoder_maps_new_pieces_together(monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choices("abcdeéß", [9, 9, 9, 9, 9, 1, 1], k=9)) for _ in range(4000)]
    want = LIBRARY.encode(" ".join(words), add_special_tokens=False).ids
    profile = cProfile.Profile()
    e = tokens.Encoder(tokens.TOKENIZER)
    e.encode("whatever loads at first")
    profile.enable()
    ids = e.encode(" ".join(words))
    profile.disable()
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert sum(x.callcount for x in profile.getstats()) < 9 * len(words)
    monkeypatch.setattr(tokens, "CACHE", 300)
    e = tokens.Encoder(tokens.TOKENIZER)
    for part in (words, words[-500:], words[:200] + ["x" * 80], words):
        assert np.frombuffer(e.encode(" ".join(part)), "<u4").tolist() == LIBRARY.encode(" ".join(part), add_special_tokens=False).ids
        assert len(e.known) <= 300 and len(e.before) <= 300


@pytest.mark.parametrize("file_bytes, block_ids", [(1 << 25, 1 << 16), (2000, 100)])
def test_huffman_round_trip(spark, make, mixed, tmp_path, file_bytes, block_ids):
    path = f"file://{tmp_path}/set"
    huffman.write_ids(make(mixed, "th n file_no"), path, file_bytes=file_bytes, block_ids=block_ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in huffman.read_ids(spark, path).orderBy("start").collect()]
    assert [brute.order(r[0]) for r in got] == sorted(brute.order(i) for i, _ in mixed)
    assert [r[1] for r in got] == [sum(q[2] for q in got[:k]) for k in range(len(got))]
    assert all(zlib.crc32(r[4]) == r[3] and len(r[4]) == 4 * r[2] for r in got)
    assert sorted((brute.order(r[0]), r[4]) for r in got) == sorted((brute.order(i), encoded(t, 2).tobytes()) for i, t in mixed)


def small(task):
    """A task that refuses batches of more than 6 MB."""

    def run(batches):
        def held():
            for batch in batches:
                if batch.nbytes > 6 << 20:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield batch

        return task(held())

    return run


def wide(spark):
    return spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 900).alias("text"))


def test_huffman_sends_small_batches(spark, tmp_path, monkeypatch):
    for name in ("_tokenized", "_blocked", "_encoded"):
        monkeypatch.setattr(huffman, name, lambda *args, made=getattr(huffman, name): small(made(*args)))
    own = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    huffman.write_ids(wide(spark), f"file://{tmp_path}/set")
    assert huffman.read_ids(spark, f"file://{tmp_path}/set", with_ids=False).count() == 2000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == own


@pytest.mark.parametrize("limit", [6, 8, 16])
def test_code_lengths_are_optimal_under_the_limit(limit):
    import itertools

    rng = np.random.default_rng(limit)
    counts = (rng.pareto(0.7, 40) * 5 + 1).astype(np.int64)
    bits = huffman.code_lengths(counts, limit)
    assert bits.max() <= limit and sum(0.5 ** int(b) for b in bits) <= 1
    few = counts[:4]
    best = min(sum(c * b for c, b in zip(few, x)) for x in itertools.product(range(1, 4), repeat=4) if sum(0.5**b for b in x) <= 1)
    assert int((few * huffman.code_lengths(few, 3)).sum()) == best


def test_sharding_table():
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup(names, 251)
    share = np.bincount(table, minlength=7)
    assert share.min() >= 35 and share.max() <= 36
    order = {k: [] for k in range(7)}  # brute force: turns over full preference lists
    for k, s in enumerate(names):
        start, step = sharding._number(f"start:{s}") % 251, sharding._number(f"step:{s}") % 250 + 1
        order[k] = [(start + j * step) % 251 for j in range(251)]
        assert sorted(order[k]) == list(range(251))
    owner = {}
    while len(owner) < 251:
        for k in range(7):
            slot = next((x for x in order[k] if x not in owner), None)
            if slot is not None:
                owner[slot] = k
    assert [owner[x] for x in range(251)] == table
    fewer = sharding.lookup(names[:-1], 251)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 60
    with pytest.raises(ValueError):
        sharding.lookup(names, 250)


def test_sharding_places_every_row(make, mixed):
    got = sharding.placed(make(mixed, "slot shard"), [f"s{k}" for k in range(5)], 101).collect()
    assert len(got) == len(mixed) and {r.slot for r in got} <= set(range(101))


def test_empty_tables(spark, make, tmp_path):
    empty, no_items = make([]), spark.createDataFrame([], "item_id long, text string")
    huffman.write_ids(empty, f"file://{tmp_path}/none")
    results = [
        substring_dedup.without_repeated_windows(empty, log2_cells=8), suffix_dedup.without_repeats(empty, log2_cells=8), simhash.near_duplicates(empty), divergence.judged(empty),
        decontamination.contaminated(empty, no_items), decontamination.contaminated(make([(1, "a b c d e f g h i j")]), no_items), packing.packed(empty),
        huffman.read_ids(spark, f"file://{tmp_path}/none"), sharding.placed(empty), katz.scored(empty, F.lit(True))[0],
        classifier.scored(empty, classifier.train(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))),
    ]
    assert [df.count() for df in results] == [0] * len(results)


def _thue_morse(n, a="a", b="b"):
    return "".join(a if bin(k).count("1") % 2 else b for k in range(n))


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_long_words_that_differ_are_not_held_equal(make, prose, n):
    before, behind = prose(31, 8), prose(32, 12)
    docs = [(1, f"{before} {_thue_morse(n)} {behind}"), (2, f"{before} {_thue_morse(n, 'b', 'a')} {behind}")]
    found = substring_dedup.without_repeated_windows(make(docs), log2_cells=14)
    assert rows(found, "doc_id", "n_words", "n_removed", "text") == sorted(brute.kept_words(docs), key=str)


def test_executors_without_the_package(tmp_path):
    """A session started elsewhere, with the package on the driver's path only."""
    import os
    import pathlib
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.append({str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
for name in ("op4_suffix_dedup", "op9_substring_dedup", "op12_prefixes", "op13_winnowing"):
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert not done.returncode, done.stderr[-2000:]


def test_pipeline_steps_send_small_batches(spark, monkeypatch):
    for module, name in ((suffix_dedup, "_anchor_hashes"), (suffix_dedup, "_contexts"), (suffix_dedup, "_matched"), (simhash, "_fingerprinted")):
        monkeypatch.setattr(module, name, lambda *args, made=getattr(module, name): small(made(*args)))
    docs = wide(spark)
    assert suffix_dedup.without_repeats(docs, log2_cells=16).filter("n_removed > 0").count() == 2000
    assert simhash.near_duplicates(docs).count() == 2000
    batches = [pa.record_batch([pa.array(range(300)), pa.array(["some words " * 1000] * 300)], names=["doc_id", "text"])]
    parts = list(classifier._scored(np.zeros((1 << classifier.BITS) + 1), ["doc_id", "text"])(iter(batches)))
    assert sum(p.num_rows for p in parts) == 300 and max(p.nbytes for p in parts) < 2 << 20


def test_packing_sends_small_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "_tokenized", lambda *args, made=packing._tokenized: small(made(*args)))
    docs = wide(spark).withColumn("source", F.lit("s"))
    assert packing.packed(docs, with_ids=False).select("doc_id").distinct().count() == 2000
