import random

import brute
import pytest
from pyspark.sql import functions as F

from weftline.llm import prefixes

SCHEMA = "lang string, source string, text string"


@pytest.fixture(scope="module")
def docs():
    r = random.Random(8)
    stems = ["a", "ab", "abc", "abcdefgh", "abcdefghi", "é", "éé" * 9, "日本" * 4, "Zebra", "zebras", "x" * 40, "x" * 41, "y" * 300, "ab\x7fcd", "don't"]
    rows = []
    for k in range(160):
        words = [r.choice(stems) + ("" if r.random() < 0.5 else r.choice(["", "s", "ed", "ing", str(k), f"q{'abcdefghij'[k % 10]}"])) for _ in range(r.randrange(1, 30))]
        rows.append((r.choice(["en", "en", "de", None]), r.choice(["s1", "s1", "s2", "s3", "", None]), r.choice([" ", "\n", "-"]).join(words)))
    odd = [("en", "lone", None), ("en", "empty", ""), ("fr", "s1", "one text only"), ("fr", "s2", "123 456"), (None, None, None), ("en", "é", "ZEBRA " * 50)]
    return rows + odd + [("de", "s2", "same text again")] * 12


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("bits, block, terms, tile, cells", [(26, 1 << 23, 1 << 14, 256, 1 << 20), (6, 200, 3, 2, 7)])
def test_against_plain_counts(spark, docs, monkeypatch, bits, block, terms, tile, cells):
    for name, value in (("LOG2_BITS", bits), ("BLOCK", block), ("TERMS", terms), ("TILE", tile), ("CELLS", cells)):
        monkeypatch.setattr(prefixes, name, value)
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"piece": F.lit("x"), "number": F.lit("x"), "n": F.lit(1), "term": F.lit("x")}).repartition(3)
    assert got(prefixes.audited(df, support=6, shown=5)) == sorted(brute.audited(docs, 6, 5))


@pytest.mark.parametrize("support", [1, 1000])
def test_all_terms_and_none(spark, docs, support):
    some = docs[:30] + docs[-16:]
    assert got(prefixes.audited(spark.createDataFrame(some, SCHEMA), support)) == sorted(brute.audited(some, support))


def test_an_empty_table(spark):
    assert got(prefixes.audited(spark.createDataFrame([], SCHEMA))) == []


def test_rare_prefixes_are_not_followed(spark, monkeypatch):
    """A long term of few documents is in no table of a level beyond the one at which its prefix is closed."""
    seen = []
    cut = prefixes.cut_lineage
    monkeypatch.setattr(prefixes, "cut_lineage", lambda df, label: seen.append((label, cut(df, label))) or seen[-1][1])
    docs = [("en", "s", f"common{'x' * 30} rare{'abcdefghij'[k]}{'z' * 60}") for k in range(10)] + [("en", "s", f"q{'uvwxyzabcd'[k]}{'z' * 60}") for k in range(10)]
    emitted, level = {}, prefixes._level

    def noted(before, length, opened):
        blocks = next(df for label, df in seen if label == "blocks")
        emitted[length] = {bytes(r.piece) for r in blocks.mapInArrow(level(before, length, opened), prefixes._LEVEL).collect()}
        return level(before, length, opened)

    monkeypatch.setattr(prefixes, "_level", noted)
    prefixes.term_counts(spark.createDataFrame(docs, SCHEMA), 5).collect()
    levels = {label: {bytes(r.piece) for r in df.collect()} for label, df in seen if label.startswith("prefixes")}
    assert list(levels) == ["prefixes-2", "prefixes-4", "prefixes-8", "prefixes-16", "prefixes-32", "prefixes-64"][: len(levels)] and len(levels) >= 6
    assert levels["prefixes-4"] == {b"comm", b"rare"} and levels["prefixes-8"] == {b"commonxx"} and levels["prefixes-64"] == {b"common" + b"x" * 30}
    assert emitted[4] == {b"comm", b"rare"} and emitted[8] > {b"commonxx", b"rareazzz"} and emitted[16] == {b"common" + b"x" * 10}
