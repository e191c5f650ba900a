"""Quality rules by divergence from language references.

Each text gives two histograms: its characters by class, and how often each common word of its language occurs among its words.
The references are the pooled histograms of all texts of a language that are long enough and pass the base rules. A text is
dropped if the Jensen-Shannon distance to its reference is over a threshold; texts with fewer than ``MIN_WORDS`` words are too
short to be judged so, and keep what the base rules say.

One pass over the texts works all counts out within each row, in built-in expressions; they are stored, and references and
verdicts come from them. A reference is one row per known language, and is broadcast.

Defined cases: a null text has no words; a language that is null or has no word list is taken to be the one whose common words
the text has most of; repeated rows are judged each; a language without a reference judges nothing. Columns other than doc_id,
text and lang are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.llm.registry import llm_query
from weftline.session import cut_lineage
from weftline.sources.tables import table

MIN_WORDS = 50
CHAR_LIMIT = 0.28
WORD_LIMIT = 0.42
WINDOW = 8

# The commonest words of each language.
COMMON = {
    "en": "the of and to a in is that it for was on with as be by this are at from".split(),
    "fr": "de la le et les en des un du une que est pour qui dans par sur au pas avec".split(),
    "de": "der die und in den von zu das mit sich des für auf im ist nicht dem ein eine als".split(),
    "es": "de la que el en y los se del las un por con no una para su es al lo".split(),
}
CLASSES = ("a-z", "A-Z", "0-9", " \\t-\\r", ".,;:?!'\"()\\-", "#*$%&|<>@+=/\\\\_~^\\[\\]{}`")
SPACE = "[ \\t-\\r]+"


def _of_class(text: Column, inside: str) -> Column:
    return F.char_length(F.regexp_replace(text, F.lit(f"[^{inside}]+"), F.lit("")))


def _words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _in_repeats(words: Column, size: int) -> Column:
    """Number of words in windows of ``size`` words that are found twice or more in the row."""

    def covered(windows: Column) -> Column:
        def by_hash(s: Column) -> Column:
            n = F.size(s)
            same = F.transform(
                F.sequence(F.lit(1), n),
                lambda k: F.when(
                    ((k > 1) & (F.get(s, k - 2).h == F.get(s, k - 1).h)) | ((k < n) & (F.get(s, k).h == F.get(s, k - 1).h)), F.get(s, k - 1).at
                ),
            )
            return tx.let(F.sort_array(F.array_compact(same)), gaps)

        def gaps(at: Column) -> Column:
            nxt = F.concat(F.slice(at, 2, F.size(at)), F.array(F.get(at, F.size(at) - 1) + size))
            return F.aggregate(F.zip_with(at, nxt, lambda a, b: F.least(F.lit(size), b - a)), F.lit(0), lambda x, y: x + y)

        placed = F.sort_array(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(tx.let(placed, by_hash))

    def hashed(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda k: F.xxhash64(F.slice(h, k, size)))
        return tx.let(windows, covered)

    return F.when(F.size(words) < size, F.lit(0)).otherwise(tx.let(F.transform(words, lambda w: F.xxhash64(w)), hashed))


def _language(lang: Column, lowered: Column) -> Column:
    """The row's own language, or the one with most common words in it."""
    known = list(COMMON)

    def matches(words: list[str]) -> Column:
        return F.size(F.filter(lowered, lambda w: w.isin(words)))

    score = [matches(COMMON[k]) for k in known]
    best = F.lit(known[-1])
    for k in reversed(range(len(known) - 1)):
        ahead = F.lit(True)
        for j in range(k + 1, len(known)):
            ahead = ahead & (score[k] >= score[j])
        best = F.when(ahead, known[k]).otherwise(best)
    return F.when(lang.isin(known), lang).otherwise(best)


def _common_counts(lang: Column, lowered: Column) -> Column:
    def counted(common: Column) -> Column:
        out = None
        for k, words in COMMON.items():
            counts = F.array(*[F.size(common) - F.size(F.array_remove(common, w)) for w in words])
            out = F.when(lang == k, counts) if out is None else out.when(lang == k, counts)
        return out

    everything = sorted({w for words in COMMON.values() for w in words})
    return tx.let(F.filter(lowered, lambda w: w.isin(everything)), counted)


def counts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: the base counts, ``lang`` as taken, and the two histograms as arrays."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    own = [_of_class(F.col("text"), c) for c in CLASSES]
    got = rows.select(
        "doc_id",
        tx.let(
            _words_of(F.col("text")),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _in_repeats(w, WINDOW).cast("long").alias("n_repeat_words")),
        ).alias("w"),
        _of_class(F.col("text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        tx.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.concat(F.array(*own), F.array(F.char_length("text"))).alias("chars"),
        tx.let(
            _words_of(F.lower("text")),
            lambda w: tx.let(_language(F.col("lang"), w), lambda k: F.struct(k.alias("lang"), _common_counts(k, w).alias("common"))),
        ).alias("c"),
    )
    return got.select("doc_id", "w.*", "n_symbols", "n_dup_lines", "chars", "c.lang", "c.common")


def _closed(parts: Column, total: Column) -> Column:
    """Shares of the parts and of the rest."""
    rest = total - F.aggregate(parts, F.lit(0.0), lambda x, y: x + y)
    return F.transform(F.concat(parts, F.array(rest)), lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits."""

    def term(a: Column, b: Column) -> Column:
        half = lambda x: F.when(x > 0, x * F.log2(x * 2 / (a + b))).otherwise(F.lit(0.0))
        return (half(a) + half(b)) / 2

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda x, y: x + y), F.lit(0.0)))


def judged(docs: DataFrame, min_words: int = MIN_WORDS, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the two distances (null where not judged) of every row of ``docs``."""
    got = cut_lineage(counts(docs), "divergence")
    got = got.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    got = got.select(
        "*",
        _closed(doubles(F.slice("chars", 1, len(CLASSES))), F.get("chars", F.lit(len(CLASSES))).cast("double")).alias("char_share"),
        _closed(doubles(F.col("common")), F.col("n_words").cast("double")).alias("word_share"),
    )
    long = (F.col("n_words") >= min_words) & ~F.col("base_failed")
    sums = [F.sum(F.get("char_share", F.lit(k)) * F.get("chars", F.lit(len(CLASSES)))).alias(f"c{k}") for k in range(len(CLASSES) + 1)]
    size = len(next(iter(COMMON.values()))) + 1
    sums += [F.sum(F.get("word_share", F.lit(k)) * F.col("n_words")).alias(f"w{k}") for k in range(size)]
    pooled = got.filter(long).groupBy("lang").agg(*sums)
    share = lambda cols: F.transform(F.array(*cols), lambda x: x / sum(map(F.col, cols), F.lit(0.0)))
    reference = pooled.select("lang", share([f"c{k}" for k in range(len(CLASSES) + 1)]).alias("char_ref"), share([f"w{k}" for k in range(size)]).alias("word_ref"))
    at = got.join(F.broadcast(reference), "lang", "left")  # as many rows as there are word lists
    at = at.withColumns({
        "char_distance": F.when(F.col("n_words") >= min_words, js_distance(F.col("char_share"), F.col("char_ref"))),
        "word_distance": F.when(F.col("n_words") >= min_words, js_distance(F.col("word_share"), F.col("word_ref"))),
    })
    far = (F.coalesce("char_distance", F.lit(0.0)) > char_limit) | (F.coalesce("word_distance", F.lit(0.0)) > word_limit)
    return at.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "lang", "char_distance", "word_distance")


def _sql() -> str:
    ws = "[ \\t-\\r]+"
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    listed = lambda words: "[" + ", ".join(map(quoted, words)) + "]"
    of_class = lambda inside: f"length(regexp_replace(text, {quoted('[^' + inside + ']+')}, '', 'g'))"
    known = list(COMMON)
    score = [f"len([x for x in lw if list_contains({listed(COMMON[k])}, x)])" for k in known]
    best = " ".join(f"WHEN {score[k]} >= greatest({', '.join(score[k + 1 :])}) THEN '{known[k]}'" for k in range(len(known) - 1))
    common = " ".join(f"WHEN '{k}' THEN [{', '.join(f'len([x for x in lw if x = {quoted(w)}])' for w in words)}]" for k, words in COMMON.items())
    n_chars, n_common = len(CLASSES) + 1, len(COMMON[known[0]]) + 1

    def distance(p: str, q: str, total: str, n: int) -> str:
        terms = []
        for k in range(1, n + 1):
            x, y = f"({p}[{k}] / {total})", f"{q}[{k}]"
            half = [f"CASE WHEN {z} > 0 THEN {z} * log2({z} * 2 / ({x} + {y})) ELSE 0 END" for z in (x, y)]
            terms.append(f"({half[0]} + {half[1]}) / 2")
        return f"sqrt(greatest({' + '.join(terms)}, 0.0))"

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, [x for x in string_split_regex(text, '{ws}') if x <> ''] AS w, [x for x in string_split_regex(lower(text), '{ws}') if x <> ''] AS lw,
 [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^ \\t-\\r]')] AS ls FROM d),
win AS (SELECT rid, k, array_to_string(w[k : k + {WINDOW - 1}], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM w)),
rep AS (SELECT rid, k FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(k, k + {WINDOW})) AS p FROM rep) GROUP BY rid),
l AS (SELECT *, CASE WHEN lang IN {tuple(known)} THEN lang {best} ELSE '{known[-1]}' END AS lang_ FROM w),
c AS (SELECT rid, doc_id, lang_, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({of_class('#*$%&|<>')} AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(length(text) AS DOUBLE) AS size, CAST([{', '.join(map(of_class, CLASSES))}] AS DOUBLE[]) AS ch, CAST(CASE lang_ {common} END AS DOUBLE[]) AS co FROM l),
b AS (SELECT c.*, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, list_append(ch, size - list_sum(ch)) AS chars, list_append(co, n_words - list_sum(co)) AS common FROM c LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM b),
r AS (SELECT lang_, [{', '.join(f'sum(chars[{k}]) / sum(size)' for k in range(1, n_chars + 1))}] AS char_ref, [{', '.join(f'sum(common[{k}]) / sum(n_words)' for k in range(1, n_common + 1))}] AS word_ref
 FROM f WHERE n_words >= {MIN_WORDS} AND NOT base_failed GROUP BY lang_),
j AS (SELECT f.*, r.lang_ IS NOT NULL AND n_words >= {MIN_WORDS} AND ({distance('chars', 'char_ref', 'size', n_chars)} > {CHAR_LIMIT} OR {distance('common', 'word_ref', 'n_words', n_common)} > {WORD_LIMIT}) AS far FROM f LEFT JOIN r USING (lang_))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM j
"""


@llm_query("op6_divergence", _sql())
def op6_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("lang", "char_distance", "word_distance")
