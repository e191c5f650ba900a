"""Divergence of sources by their terms, where the terms of a language are found by iceberg prefix refinement.

A term belongs to a language's vocabulary if enough of its documents hold it. Texts are cut into terms once; what is kept is, for
each block of texts, its distinct terms and for each document which of them it holds how often. Then prefixes grow level by level
(2, 4, 8, ... bytes): a level counts the distinct documents of each prefix among the terms whose shorter prefix is still open,
and closes the prefixes that too few documents hold. A term no longer than the level's length is whole: it is kept or dropped
there. Levels end when no open prefix is left, so rare long terms are never grouped as such. Occurrences by source are then
counted for the terms kept.

Tasks learn which prefixes are open, and in the end which terms are kept, from a bit map of ``2**LOG2_BITS`` bits, made in Spark and of that size whatever the input.
Prefixes that share a bit with an open one are followed too; whole terms are counted and joined exactly, so the result is the same.

The distance of two sources is a sum over the vocabulary. Counts are dealt by blocks of terms; a task adds up the distances
over its terms for all sources of the language as one array, some sources at a time, and sends one row for each pair.

Defined cases: null text, lang and source are empty; every row is a document of its own, also if rows repeat; a source without
terms, or a language without a vocabulary, has its rows with the shares that zero counts give, and distance 0 where there is no
vocabulary. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.registry import llm_query
from weftline.llm.words import each, lowered, utf8
from weftline.session import cut_lineage
from weftline.sources.tables import table

SUPPORT = 30
SHOWN = 50
SHARE = 1_000_000_000
SMOOTHING = 5
LOG2_BITS = 26
#: Bytes of text in a block; terms in a task's block of distances, and sources measured against all others there.
BLOCK = 1 << 23
TERMS = 1 << 14
TILE = 256
CELLS = 1 << 20

_IS_TERM = np.zeros(256, bool)
_IS_TERM[0x41:0x5B] = _IS_TERM[0x61:0x7B] = _IS_TERM[0x80:] = True

_BLOCKS = "groups array<struct<lang:string,source:string>>, n_docs int, n_entries int, n_pairs int, doc_group binary, entry_group binary, entry_end binary, entries binary, pairs binary, counts binary"
_LEVEL = "lang string, piece binary, whole boolean, docs long"
_COUNTED = "lang string, source string, piece binary, n long"


def _squeezed(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(blob: bytes, n: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """Byte strings that stand one behind the other in ``data``."""
    ends = np.r_[0, ends].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _numbered(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _terms(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.ChunkedArray]:
    """The row of every term, and the terms. Long data is taken in pieces that end behind a term."""
    rows, found, a = [np.zeros(0, np.int64)], [pa.array([], pa.large_binary())], 0
    while a < len(data):
        b = min(a + BLOCK, len(data))
        while b < len(data) and _IS_TERM[data[b]]:
            ahead = _IS_TERM[data[b : b + 4096]]
            b += len(ahead) if ahead.all() else int(ahead.argmin())
        piece = data[a:b]
        inside = _IS_TERM[piece]
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1]
        cut = starts[(starts >= a) & (starts < b)] - a
        fresh[cut] |= inside[cut]
        begin = np.flatnonzero(fresh)
        if len(begin):
            before = np.cumsum(inside)[begin] - 1
            rows.append(np.searchsorted(starts, begin + a, "right") - 1)
            found.append(_binary(np.r_[before[1:], inside.sum()], lowered(piece[inside])))
        a = b
    return np.concatenate(rows), pa.chunked_array(found)


_BLOCK_SCHEMA = pa.schema(
    [("groups", pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string())])))]
    + [(x, pa.int32()) for x in ("n_docs", "n_entries", "n_pairs")]
    + [(x, pa.binary()) for x in ("doc_group", "entry_group", "entry_end", "entries", "pairs", "counts")]
)


def _block(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Some texts as the terms they hold: ``pairs`` are document * n_entries + entry, rising."""
    lang, lang_names = _numbered(langs)
    source, source_names = _numbered(sources)
    group, doc_group = np.unique(lang * len(source_names) + source, return_inverse=True)
    group_lang, group_source = np.divmod(group, len(source_names))
    names = [{"lang": x, "source": y} for x, y in zip(lang_names.take(pa.array(group_lang)).to_pylist(), source_names.take(pa.array(group_source)).to_pylist())]
    doc, terms = _terms(*utf8(texts))
    term, known = _numbered(terms)
    order = pc.sort_indices(known)
    rank = np.empty(len(known), np.int64)
    rank[order.to_numpy()] = np.arange(len(known))
    term, known, n_known = rank[term], known.take(order), max(len(known), 1)
    entry, at = np.unique(lang[doc] * n_known + term, return_inverse=True)
    entry_lang, entry_term = np.divmod(entry, n_known)
    some_group = np.zeros(len(lang_names), np.int32)  # of each language; an entry names its language by it
    some_group[group_lang] = np.arange(len(group))
    pairs, counts = np.unique(doc * max(len(entry), 1) + at, return_counts=True)
    data, ends = utf8(known.take(pa.array(entry_term)))
    blobs = [doc_group.astype(np.int32), some_group[entry_lang], ends[1:], data, np.diff(pairs, prepend=0), counts.astype(np.int32)]
    columns = [[names], [len(texts)], [len(entry)], [len(pairs)], *([_squeezed(x)] for x in blobs)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK_SCHEMA)], schema=_BLOCK_SCHEMA)


def _blocked(batches):
    for batch in batches:
        size, a = np.r_[0, np.cumsum(pc.binary_length(batch.column(2)).to_numpy())], 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, size[a] + BLOCK, "right")) - 1)
            yield _block(*(batch.column(k).slice(a, b - a) for k in range(3)))
            a = b


def _clipped(ends: np.ndarray, data: np.ndarray, which: np.ndarray, most: int) -> pa.Array:
    """The first ``most`` bytes of the entries ``which``."""
    begin = np.r_[0, ends[:-1]][which]
    length = np.minimum(ends[which] - begin, most)
    stop = np.cumsum(length)
    return _binary(stop, data[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(begin - (stop - length), length)])


def _bit(lang: str, prefix: bytes) -> int:
    """As ``xxhash64(lang, prefix)`` in Spark."""
    return xxhash.xxh64_intdigest(prefix, xxhash.xxh64_intdigest(lang.encode(), 42)) & (1 << LOG2_BITS) - 1


class _Held:
    """A stored block. Entries stand by language and bytes, pairs by document and entry, so equal prefixes are neighbours."""

    def __init__(self, row):
        self.groups, self.n_docs, self.n_entries, self.n_pairs, self._group, group, ends, entries, self._pairs, self._counts = row
        self.ends = _unsqueezed(ends, self.n_entries, np.int64)
        self.data = _unsqueezed(entries, int(self.ends[-1]) if self.n_entries else 0, np.uint8)
        self.size = np.diff(self.ends, prepend=0)
        langs, self.lang_names = _numbered(pa.array([g["lang"] for g in self.groups], pa.string()))
        self.lang = langs[_unsqueezed(group, self.n_entries, np.int32)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and entry of each pair."""
        return np.divmod(np.cumsum(_unsqueezed(self._pairs, self.n_pairs, np.int64)), max(self.n_entries, 1))

    def counts(self) -> np.ndarray:
        return _unsqueezed(self._counts, self.n_pairs, np.int32)

    def doc_group(self) -> np.ndarray:
        return _unsqueezed(self._group, self.n_docs, np.int32)

    def runs(self, which: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """For the entries ``which``, cut to ``most`` bytes: the number of the run of equal ones, the first of each run, the cut entries."""
        cut = _clipped(self.ends, self.data, which, most)
        code, _ = _numbered(cut)
        whole, lang = self.size[which] <= most, self.lang[which]
        fresh = np.ones(len(which), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (whole[1:] != whole[:-1]) | (lang[1:] != lang[:-1])
        return np.cumsum(fresh) - 1, np.flatnonzero(fresh), cut

    def marked(self, which: np.ndarray, most: int, bits: np.ndarray) -> np.ndarray:
        """Which of ``which`` have the bit of their first ``most`` bytes."""
        run, first, cut = self.runs(which, most)
        names = self.lang_names.to_pylist()
        place = np.array([_bit(names[g], p) for g, p in zip(self.lang[which[first]].tolist(), cut.take(pa.array(first)).to_pylist())], np.int64)
        return (bits[place >> 3] >> (place & 7) & 1 > 0)[run]


def _level(before: int, length: int, opened):
    """Distinct documents of the whole terms of up to ``length`` bytes and of the first ``length`` bytes of longer ones."""
    names = [x.split()[0] for x in _LEVEL.split(", ")]

    def counted(held: _Held) -> pa.RecordBatch:
        which = np.flatnonzero(held.size > before)
        if before:
            which = which[held.marked(which, before, opened.value)]
        run, first, cut = held.runs(which, length)
        run_of = np.full(held.n_entries, -1)
        run_of[which] = run
        doc, entry = held.pairs()
        run = run_of[entry]
        doc, run = doc[run >= 0], run[run >= 0]
        once = np.ones(len(run), bool)  # a document counts once however many of its terms begin so
        once[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
        at = which[first]
        columns = [held.lang_names.take(pa.array(held.lang[at])), cut.take(pa.array(first)).cast(pa.binary()), pa.array(held.size[at] <= length)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.bincount(run[once], minlength=len(first)))], names=names)

    def level(batches):
        for batch in batches:
            for row in each(batch, 1):
                yield counted(_Held(row))

    return level


def _occurrences(kept):
    """Occurrences by source of the whole terms that have a bit."""
    names = [x.split()[0] for x in _COUNTED.split(", ")]

    def counted(held: _Held) -> pa.RecordBatch:
        which = np.arange(held.n_entries)
        which = which[held.marked(which, int(held.size.max(initial=1)), kept.value)]
        place = np.full(held.n_entries, -1)
        place[which] = np.arange(len(which))
        doc, entry = held.pairs()
        at = place[entry]
        mine = at >= 0
        key, inverse = np.unique(held.doc_group()[doc[mine]].astype(np.int64) * max(len(which), 1) + at[mine], return_inverse=True)
        n = np.bincount(inverse, weights=held.counts()[mine], minlength=len(key)).astype(np.int64)
        group, at = np.divmod(key, max(len(which), 1))
        pieces = _clipped(held.ends, held.data, which, int(held.size.max(initial=1))).cast(pa.binary())
        sources = pa.array([g["source"] for g in held.groups], pa.string())
        columns = [held.lang_names.take(pa.array(held.lang[which[at]])), sources.take(pa.array(group)), pieces.take(pa.array(at)), pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def occurrences(batches):
        for batch in batches:
            for row in each(batch, 1):
                yield counted(_Held(row))

    return occurrences


def _bit_map(opened: DataFrame):
    """A broadcast bit map of the open prefixes."""
    place = opened.select(F.xxhash64("lang", "piece").bitwiseAND((1 << LOG2_BITS) - 1).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << LOG2_BITS - 6, np.uint64)  # 2**(LOG2_BITS - 6) rows of two longs at most
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return opened.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def term_counts(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``lang, source, term, n``: occurrences in each source of the terms that at least ``support`` documents of ``lang`` hold."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    blocks = cut_lineage(rows.mapInArrow(_blocked, _BLOCKS), "blocks")
    whole, before, length, bits = [], 0, 2, None
    while True:
        counted = blocks.mapInArrow(_level(before, length, bits), _LEVEL).groupBy("lang", "piece", "whole").agg(F.sum("docs").alias("docs"))
        kept = cut_lineage(counted.filter(F.col("docs") >= support), f"prefixes-{length}")
        whole.append(kept.filter("whole").select("lang", "piece"))
        opened = kept.filter("NOT whole")
        if opened.isEmpty():
            break
        before, length, bits = length, 2 * length, _bit_map(opened)
    kept = whole[0]
    for more in whole[1:]:
        kept = kept.unionByName(more)
    found = blocks.mapInArrow(_occurrences(_bit_map(kept)), _COUNTED).groupBy("lang", "source", "piece").agg(F.sum("n").alias("n"))
    return found.join(kept, ["lang", "piece"], "left_semi").select("lang", "source", F.col("piece").cast("string").alias("term"), "n")


# Shares and distances


def _share(count: str, n: str = "n_all", v: str = "v") -> F.Column:
    wide = "CAST({} AS DECIMAL(19, 0))"
    return F.expr(f"1 + (CAST({SHARE} AS DECIMAL(10, 0)) * {wide.format(f'{count} + {SMOOTHING}')}) DIV {wide.format(f'greatest({n} + {SMOOTHING} * {v}, 1)')}")


def _distances(batches):
    """Sums over a block's terms for each pair of sources: first rows of kind 0 (source and share of a zero count), then by term."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])

    def result(lang, tile, sums):
        i, j = np.indices(sums.shape).reshape(2, -1)
        i = i + tile * TILE
        for at in range(0, len(i), 1 << 20):
            part = slice(at, at + (1 << 20))
            keep = i[part] != j[part]
            columns = [pa.array([lang] * int(keep.sum()), pa.string()), *(pa.array(x[part][keep].astype(np.int32)) for x in (i, j)), pa.array(sums.ravel()[part][keep])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    key = zero = sums = cells = None
    held = 0

    def measured():
        some = cells[:, :held]
        for k in range(sums.shape[0]):
            sums[k] += np.abs(some - some[key[2] * TILE + k]).sum(axis=1)

    zeros, last = [], None
    for batch in batches:
        for lang, block, tile, kind, term, number, share in zip(*(c.to_pylist() for c in batch.columns)):
            if (lang, block, tile) != key:
                if sums is not None:
                    measured()
                    yield from result(key[0], key[2], sums)
                key, zeros, sums, held, last = (lang, block, tile), [], None, 0, None
            if kind == 0:
                zeros.append(share)
                continue
            if sums is None:
                zero = np.array(zeros, np.int64)
                sums = np.zeros((min(TILE, len(zero) - tile * TILE), len(zero)), np.int64)
                cells = np.empty((len(zero), max(1, CELLS // len(zero))), np.int64)
            if term != last:
                if held == cells.shape[1]:
                    measured()
                    held = 0
                cells[:, held] = zero
                held, last = held + 1, term
            cells[number, held - 1] = share
    if sums is not None:
        measured()
        yield from result(key[0], key[2], sums)


def audited(docs: DataFrame, support: int = SUPPORT, shown: int = SHOWN) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source's shares are from the others', and the terms it overuses."""
    counts = cut_lineage(term_counts(docs, support), "counts")
    names = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    sizes = whole.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_all"))
    used = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    groups = names.join(used, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["n_all", "v", "lang_all"])
    groups = groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("zero", _share("0"))
    groups = cut_lineage(groups, "groups")

    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n"))
    over = shares.join(whole, ["lang", "term"]).withColumn("value", F.col("p") - _share("lang_n", "lang_all")).filter("value > 0")
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    lists = groups.groupBy("lang").agg(F.count("*").alias("of"), (F.floor(F.max("v") / TERMS) + 1).cast("int").alias("blocks"))
    tiled = lists.select("lang", "blocks", F.explode(F.sequence(F.lit(0), F.floor((F.col("of") - 1) / TILE).cast("int"))).alias("tile"))
    dealt = shares.join(tiled, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "tile", F.lit(1).alias("kind"), "term", "number", F.col("p").alias("share"))
    zeros = groups.join(tiled, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "tile", F.lit(0).alias("kind"), F.lit("").alias("term"), "number", F.col("zero").alias("share"))
    dealt = dealt.unionByName(zeros).repartition("lang", "block", "tile").sortWithinPartitions("lang", "block", "tile", "kind", "term", "number")
    sums = dealt.mapInArrow(_distances, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one, other = groups.select("lang", "source", "number"), groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"))
    pairs = one.join(other, (one.lang == other.lang) & (F.col("number") != F.col("b"))).select(one.lang, "source", "item", F.col("number").alias("a"), "b")
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= shown)
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)


def _sql(support: int = SUPPORT, shown: int = SHOWN) -> str:
    share = f"1 + ({SHARE} * ({{}} + {SMOOTHING})) // ({{}} + {SMOOTHING} * v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {support}),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS lang_all FROM kept GROUP BY lang),
used AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::BIGINT AS n_all FROM used GROUP BY ALL),
g AS (SELECT lang, source, coalesce(n_all, 0) AS n_all FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN totals USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {share.format('coalesce(n, 0)', 'n_all')} AS p, {share.format('lang_n', 'lang_all')} AS q
      FROM g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang LEFT JOIN used u ON g.lang = u.lang AND g.source = u.source AND k.term = u.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
         UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows) WHERE part = 'pair' OR rank <= {shown}
"""


@llm_query("op12_prefixes", _sql())
def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))
