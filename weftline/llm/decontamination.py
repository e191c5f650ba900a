"""Benchmark decontamination by spaced-seed hashing.

Texts are compared by their words: runs of letters and digits, lower-cased. A seed is a fixed mask over ``SPAN`` words of which
only some count, so words at the other places may differ. Seeds of all items and all documents are hashed and joined; around
each hit, windows of ``WINDOW`` words that hold the seed are compared word by word, and a pair is reported if one of them has
``SIMILARITY`` of its words equal at the same places. The three masks were searched for so that any two changed words of 10 to 13,
or one of 9, leave a seed whole; a test goes through all these patterns. Items of ``SPAN`` words may lose one changed word.

Items of fewer than ``SPAN`` words have one seed, all their words, and are reported where they stand unchanged. Under ``shortest``
words an item says too little: a document with the same few words need not come from it.

Documents are not exploded into all their seeds: bit maps of the items' words and seeds, of ``2**log2_bits`` bits whatever their
number, travel as constants and let through what may be in them; the join then decides. A hit carries the few words around it, never
its document, so a passage found in a third of all documents costs each of them a small row. All of it is built-in expressions.

Defined cases: null texts have no words; items of fewer than ``shortest`` words are never reported; items shorter than a window
need their share of their own words; rows of one doc_id are reported together, as are those of one item_id, null ids included.
Other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.llm.registry import llm_query
from weftline.operators.rows import unnest, unnest_fields
from weftline.sources.tables import table

MASKS = ("10001111", "10110101", "11011001")
SPAN = 8
SHORTEST = 5
WINDOW = 13
SIMILARITY = 0.8
LOG2_BITS = 22


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _mask(mask: int) -> str:
    """The mask of a number: one of ``MASKS``, then all words of an item of 1, 2, ... words."""
    return MASKS[mask] if mask < len(MASKS) else "1" * (mask - len(MASKS) + 1)


def _seed(h: Column, at: Column, mask: int) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(h, at + k) for k, c in enumerate(_mask(mask)) if c == "1"])


def _around(h: Column, at: Column) -> Column:
    """The words of every window that holds the seed; null outside of the text."""
    return F.transform(F.sequence(at - (WINDOW - SPAN), at + (WINDOW - 1)), lambda k: F.get(h, k))


def _seeds(text: Column, masks: list[int], known=None, kept=None) -> Column:
    """``mask, at, seed, around, n_words`` of every seed of an item; or of those of a document that ``kept`` lets through.

    Words that ``known`` tells apart from all words of items become null, and only seeds that begin and end with a known word
    are hashed.
    """

    def places(h: Column, span: int) -> Column:
        last = F.size(h) - span
        every = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        if known is not None:
            return F.filter(every, lambda at: F.get(h, at).isNotNull() & F.get(h, at + (span - 1)).isNotNull())
        return every if span == SPAN else F.filter(every, lambda at: last == 0)

    def found(h: Column) -> Column:
        def own(mask: int, at_places: Column) -> Column:
            if kept is not None:
                at_places = F.filter(at_places, lambda at: kept(_seed(h, at, mask)))
            return F.transform(
                at_places,
                lambda at: F.struct(
                    F.lit(mask).alias("mask"), at.alias("at"), _seed(h, at, mask).alias("seed"), _around(h, at).alias("around"), F.size(h).alias("n_words")
                ),
            )

        short = [own(m, places(h, len(_mask(m)))) for m in masks if m >= len(MASKS)]
        return tx.let(places(h, SPAN), lambda shared: F.concat(*[own(m, shared) for m in range(len(MASKS))], *short))

    hashes = F.transform(_words(text), lambda w: F.xxhash64(w))
    return tx.let(hashes if known is None else F.transform(hashes, lambda h: F.when(known(h), h)), found)


def _filter_of(seeds: DataFrame, log2_bits: int):
    """A test on hashes that all in column ``seed`` pass, and few others."""
    size = 1 << (log2_bits - 6)
    bit = F.col("seed").bitwiseAND((1 << log2_bits) - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    rows = seeds.groupBy(F.shiftright(bit, 6).alias("place")).agg(F.bit_or(one).alias("bits")).collect()  # at most ``size`` rows
    bits = [0] * size
    for r in rows:
        bits[r.place] = r.bits
    constant = F.from_json(F.lit(json.dumps(bits)), "array<bigint>")

    def passes(seed: Column) -> Column:
        at = seed.bitwiseAND((1 << log2_bits) - 1)
        return F.call_function("shiftrightunsigned", F.get(constant, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    return passes


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, log2_bits: int = LOG2_BITS, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, item_id, n_hits`` (hits that held) and ``n_equal`` (most equal words of a window) of every pair that overlaps."""
    lengths = items.select(F.size(_words(F.col("text"))).alias("n")).filter(F.col("n").between(shortest, SPAN - 1)).distinct().collect()  # SPAN rows at most
    masks = [*range(len(MASKS)), *sorted(len(MASKS) + r.n - 1 for r in lengths)]
    own = unnest_fields(items, [F.col("item_id").cast("long").alias("item_id")], _seeds(F.col("text"), masks))
    passes = _filter_of(own.select("seed"), log2_bits)
    known = _filter_of(unnest(items, [], F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)), "seed"), log2_bits)
    theirs = unnest_fields(docs, [F.col("doc_id").cast("long").alias("doc_id")], _seeds(F.col("text"), masks, known, passes))
    both = theirs.alias("d").join(own.alias("i"), (F.col("d.mask") == F.col("i.mask")) & (F.col("d.seed") == F.col("i.seed")))
    equal = F.zip_with("d.around", "i.around", lambda a, b: F.when(a == b, 1).otherwise(0))
    in_window = tx.let(
        equal, lambda e: F.greatest(*[F.aggregate(F.slice(e, k + 1, WINDOW), F.lit(0), lambda x, y: x + y) for k in range(WINDOW - SPAN + 1)])
    )
    hits = both.select("doc_id", "item_id", in_window.alias("n_equal"), F.least("i.n_words", F.lit(WINDOW)).alias("window"))
    needed = F.when(F.col("window") < SPAN, F.col("window")).otherwise(F.ceil(F.col("window") * similarity - 1e-9))
    held = hits.filter(F.col("n_equal") >= needed)
    return held.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_hits"), F.max("n_equal").alias("n_equal"))


def _sql() -> str:
    pad, tail = "['','','','','']", "['','','','','','','','','','','','']"
    masks = [*range(len(MASKS)), *range(len(MASKS) + SHORTEST - 1, len(MASKS) + SPAN - 1)]
    picks = {m: " || ' ' || ".join(f"p[pos + {5 + k}]" for k, c in enumerate(_mask(m)) if c == "1") for m in masks}
    windows = ", ".join("+".join(f"CAST(d.p[d.pos + {o + k}] = i.p[i.pos + {o + k}] AND d.p[d.pos + {o + k}] <> '' AS INTEGER)" for k in range(WINDOW)) for o in range(WINDOW - SPAN + 1))
    assert WINDOW - SPAN == 5

    def where(name: str, m: int) -> str:
        if m < len(MASKS):
            return f"pos <= n - {SPAN} + 1"
        n = len(_mask(m))
        return f"pos = 1 AND n = {n}" if name == "i" else f"pos <= n - {n} + 1 AND {n} IN (SELECT len(w) FROM i_words)"

    def side(name: str, ident: str) -> str:
        seeds = " UNION ALL ".join(f"SELECT {ident}, pos, n, p, {m} AS mask, {pick} AS seed FROM {name}_at WHERE {where(name, m)}" for m, pick in picks.items())
        return f"""
{name}_words AS (SELECT {ident}, [x for x in string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') if x <> ''] AS w FROM {'documents' if ident == 'doc_id' else 'benchmark'}),
{name}_at AS (SELECT {ident}, list_concat({pad}, w, {tail}) AS p, len(w) AS n, unnest(range(1, len(w) + 1)) AS pos FROM {name}_words),
{name} AS ({seeds})"""

    return f"""
WITH {side('i', 'item_id')},{side('d', 'doc_id')},
hits AS (SELECT doc_id, item_id, least(i.n, {WINDOW}) AS window_, greatest({windows}) AS n_equal FROM d JOIN i ON d.mask = i.mask AND d.seed = i.seed)
SELECT doc_id, item_id, count(*) AS n_hits, max(n_equal) AS n_equal FROM hits
WHERE n_equal >= CASE WHEN window_ < {SPAN} THEN window_ ELSE ceil(window_ * {SIMILARITY} - 1e-9) END GROUP BY doc_id, item_id
"""


@llm_query("op7_decontamination", _sql())
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
