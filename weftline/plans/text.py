"""Text, line and chunk queries over ``documents`` and derived files."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as tx
from weftline.operators import chunking, search, similarity
from weftline.plans.corpus import cte, derived
from weftline.plans.rules import TRIM, WS
from weftline.plans.sqltext import any_contains, cases, in_list, q
from weftline.registry import query
from weftline.sources.tables import spread, table

LINES = "CASE WHEN text = '' THEN [] ELSE string_split_regex(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n') END"
WORDS = f"list_filter(string_split_regex(text, '{WS}+'), lambda w: w <> '')"


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


@query("text_metrics", "SC1 SC2 SC3 SC4 SC14", f"""
SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(strlen(text) AS INTEGER) AS bytes, CAST(len({LINES}) AS INTEGER) AS lines, CAST(len({WORDS}) AS INTEGER) AS words, greatest(strlen(text) // 4, 1) AS tokens,
 CAST((strlen(text) - strlen(replace(text, 'the', ''))) / 3 AS BIGINT) AS the_count, md5(array_to_string(list_filter(string_split_regex(lower(text), '{WS}+'), lambda w: w <> ''), ' ')) AS normal_md5 FROM documents""")
def text_metrics(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id", F.length(t).alias("chars"), F.octet_length(t).alias("bytes"), F.size(tx.lines(t)).alias("lines"), F.size(tx.words(t)).alias("words"),
        tx.token_estimate(t).alias("tokens"), tx.count_of(t, "the").alias("the_count"), F.md5(tx.normalise(t)).alias("normal_md5"))


@query("read_lines", "SRC4", f"""WITH l AS (SELECT doc_id, {LINES} AS ls FROM documents)
SELECT doc_id, array_to_string(ls[2:4], chr(10)) AS content, CAST(len(ls) AS INTEGER) AS total_lines, '2-' || (1 + greatest(least(4, len(ls)) - 1, 0)) AS lines_read FROM l""")
def read_lines(spark, sf):
    """Lines 2 to 4 of every document."""
    rows = _docs(spark, sf).select("doc_id", tx.lines(F.col("text")).alias("ls")).withColumn("part", F.slice("ls", 2, 3))
    return rows.select("doc_id", F.array_join("part", "\n").alias("content"), F.size("ls").alias("total_lines"),
                       F.concat(F.lit("2-"), (F.size("part") + 1).cast("string")).alias("lines_read"))


def _grep_sql(pattern: str, lead: str, tail: str) -> str:
    return f"""WITH l AS (SELECT doc_id, {LINES} AS ls FROM documents), r AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l), m AS (SELECT doc_id, ls, i, ls[i] AS line FROM r WHERE regexp_matches(ls[i], {q(pattern)})),
h AS (SELECT *, regexp_extract(line, {q(lead)}, 1) AS head, regexp_extract(line, {q(lead)}, 2) AS hit FROM m)
SELECT doc_id, CAST(i AS INTEGER) AS line_number, line, array_to_string(ls[greatest(i - 2, 1):i - 1], chr(10)) AS context_before, array_to_string(ls[i + 1:i + 2], chr(10)) AS context_after,
 CAST(strlen(head) AS INTEGER) AS match_start, CAST(strlen(head) + strlen(hit) AS INTEGER) AS match_end FROM h {tail}"""


@query("grep_regex", "WN1 SC7", _grep_sql("[tT]hat? [a-z]+ing", "^(.*?)([tT]hat? [a-z]+ing)", ""))
def grep_regex(spark, sf):
    return search.grep(_docs(spark, sf), "doc_id", "text", search.search_pattern("[tT]hat? [a-z]+ing", is_regex=True))


@query("grep_literal_top", "WN1 TK9 SC10", _grep_sql("(?i)of the", "(?i)^(.*?)(of the)", "ORDER BY doc_id, i LIMIT 100"))
def grep_literal_top(spark, sf):
    """First 100 matches in document and line order."""
    hits = search.grep(_docs(spark, sf), "doc_id", "text", search.search_pattern("of the", ignore_case=True))
    return hits.orderBy("doc_id", "line_number").limit(100)


@query("grep_summary", "CX20 AG3", f"""WITH l AS (SELECT doc_id, lang, {LINES} AS ls FROM documents), n AS (SELECT doc_id, lang, len(list_filter(ls, lambda x: regexp_matches(x, '(?i)error|de la|of the'))) AS n FROM l)
SELECT lang, count(*) AS files_searched, count(*) FILTER (n > 0) AS files_with_matches, CAST(sum(n) AS BIGINT) AS total_matches FROM n GROUP BY lang""")
def grep_summary(spark, sf):
    pattern = search.search_pattern("error|de la|of the", is_regex=True, ignore_case=True)
    n = table(spark, sf, "documents").select("lang", F.size(F.filter(tx.lines(F.col("text")), lambda x: x.rlike(pattern))).alias("n"))
    return n.groupBy("lang").agg(F.count("*").alias("files_searched"), F.count_if(F.col("n") > 0).alias("files_with_matches"), F.sum("n").alias("total_matches"))


@query("replace_count", "SC8", "SELECT doc_id, CAST(len(regexp_extract_all(text, 'th[ae]')) AS BIGINT) AS replacements, md5(regexp_replace(text, 'th[ae]', '$1-X', 'g')) AS new_md5 FROM documents")
def replace_count(spark, sf):
    replaced, count = search.replace_counted(F.col("text"), search.search_pattern("th[ae]", is_regex=True), "$1-X")
    return _docs(spark, sf).select("doc_id", count.alias("replacements"), F.md5(replaced).alias("new_md5"))


_NW = r"[^\p{L}\p{M}\p{N}_]"


@query("rename_word", "SC9", f"""WITH l AS (SELECT doc_id, {LINES} AS ls FROM documents), r AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM l),
n AS (SELECT doc_id, i, line, regexp_replace(regexp_replace(line, '(^|{_NW})the({_NW}|$)', '\\1$a\\2', 'g'), '(^|{_NW})the({_NW}|$)', '\\1$a\\2', 'g') AS new_text FROM r)
SELECT doc_id, CAST(i AS INTEGER) AS line_number, line AS old_text, new_text FROM n WHERE line <> new_text""")
def rename_word(spark, sf):
    return search.rename(_docs(spark, sf), "doc_id", "text", "the", "$a")


@query("style_score", "CD12", f"""WITH l AS (SELECT doc_id, {LINES} AS ls FROM documents)
SELECT doc_id, CAST(greatest(0, 100 - len(list_filter(ls, lambda x: ends_with(x, ' ') OR ends_with(x, chr(9)))) - len(list_filter(ls, lambda x: strlen(x) > 100))) AS INTEGER) AS style_score FROM l""")
def style_score(spark, sf):
    from weftline.operators.code import style_score as score

    return _docs(spark, sf).select("doc_id", score(F.col("text")).alias("style_score"))


_WINDOW = 20


@query("line_chunks", "CH2 CH4 CH5", f"""WITH l AS (SELECT doc_id, text, {LINES} AS ls FROM documents), s AS (SELECT *, unnest(range(0, greatest(len(ls), 1), {_WINDOW})) AS s FROM l),
c AS (SELECT doc_id, CAST(s + 1 AS INTEGER) AS line_start, CAST(least(s + {_WINDOW}, len(ls)) AS INTEGER) AS line_end, CASE WHEN len(ls) <= {_WINDOW} THEN text ELSE array_to_string(ls[s + 1:s + {_WINDOW}], chr(10)) END AS text FROM s)
SELECT *, 'file chunk (lines ' || line_start || '-' || line_end || ', ' || (line_end - line_start + 1) || ' lines)' AS summary FROM c""")
def line_chunks(spark, sf):
    return chunking.line_chunks(_docs(spark, sf), "doc_id", "text", _WINDOW)


def _chunk_sql(limit: int, overlap: int) -> str:
    # Each multi-byte character is padded with chr(1) to its byte length, so positions count bytes.
    x = "chr(1)"
    pad = (f"regexp_replace(regexp_replace(regexp_replace(text, '([\\x{{80}}-\\x{{7FF}}])', '\\1' || {x}, 'g'), '([\\x{{800}}-\\x{{FFFF}}])', '\\1' || {x} || {x}, 'g'), "
           f"'([\\x{{10000}}-\\x{{10FFFF}}])', '\\1' || {x} || {x} || {x}, 'g')")

    def back(p):
        return f"({p} - CASE WHEN {p} >= n OR substr(pad, {p} + 1, 1) <> {x} THEN 0 WHEN substr(pad, {p}, 1) <> {x} THEN 1 WHEN substr(pad, {p} - 1, 1) <> {x} THEN 2 ELSE 3 END)"

    def ahead(p):
        return f"least(n, {p} + CASE WHEN substr(pad, {p} + 1, 1) <> {x} THEN 0 WHEN substr(pad, {p} + 2, 1) <> {x} THEN 1 WHEN substr(pad, {p} + 3, 1) <> {x} THEN 2 ELSE 3 END)"

    def step(src):
        return f"""SELECT doc_id, pad, n, i, cut, CASE WHEN nx <= i THEN {ahead('greatest(cut, i + 1)')} ELSE nx END AS nxt FROM (SELECT *, {back('nx0')} AS nx FROM (
 SELECT *, CASE WHEN {overlap} < cut - i THEN cut - {overlap} ELSE cut END AS nx0 FROM (SELECT *, CASE WHEN cut1 <= i THEN {ahead('(i + 1)')} ELSE cut1 END AS cut FROM (
 SELECT *, CASE WHEN e < n AND e > i AND contains(sl, chr(10)) THEN i + length(regexp_extract(sl, '(?s)^.*\\n')) WHEN e < n AND e > i AND contains(sl, ' ') THEN i + length(regexp_extract(sl, '(?s)^.* ')) ELSE e END AS cut1 FROM (
 SELECT *, substr(pad, i + 1, e - i) AS sl FROM (SELECT *, {back(f'least(n, i + {limit})')} AS e FROM {src}))))))"""

    return f"""WITH RECURSIVE d AS (SELECT doc_id, pad, length(pad) AS n, CAST(0 AS BIGINT) AS i FROM (SELECT doc_id, {pad} AS pad FROM documents) WHERE pad <> ''),
w AS ({step('d')} UNION ALL {step('(SELECT doc_id, pad, n, nxt AS i FROM w WHERE cut < n AND nxt < n)')}),
t AS (SELECT doc_id, i, cut, regexp_replace(replace(substr(pad, i + 1, cut - i), {x}, ''), {TRIM}) AS text FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, sha256(doc_id || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)) AS chunk_id,
 CAST(i AS INTEGER) AS start_byte, CAST(cut AS INTEGER) AS end_byte, text FROM t WHERE text <> ''"""


@query("text_chunks", "CH1 CH5 SC16", _chunk_sql(500, 50))
def text_chunks(spark, sf):
    return chunking.text_chunks(_docs(spark, sf), "doc_id", "text", 500, 50)


@query("byte_cut", "SC6 SC5", """WITH s AS (SELECT doc_id, text, list_max([substr(text, 1, 800 - CAST(k AS INTEGER)) FOR k IN range(0, 600) IF strlen(substr(text, 1, 800 - CAST(k AS INTEGER))) <= 800]) AS head FROM documents)
SELECT doc_id, CASE WHEN strlen(text) > 800 THEN head || '...(cut)' ELSE text END AS text, substr(text, 1, 100) AS first_chars FROM s""")
def byte_cut(spark, sf):
    return _docs(spark, sf).select("doc_id", search.byte_cut(F.col("text"), 800, "...(cut)").alias("text"), F.substring("text", 1, 100).alias("first_chars"))


_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_EXT = f"regexp_extract({_NAME}, '^.+\\.([^.]*)$', 1)"
_LANG = ("CASE WHEN contains(substr(name, 2), '.') THEN coalesce(" + cases([(f"name = {q(n)}", q(v)) for n, v in fixed.LANGUAGE_BY_NAME.items()]) + ", "
         + cases([(f"lower(ext) = {q(e)}", q(v)) for e, v in fixed.LANGUAGE_BY_EXTENSION.items()]) + ") END")
_FTYPE = f"""CASE WHEN ends_with(lname, '.config') OR ends_with(lname, '.conf') OR {any_contains('lname', fixed.CONFIG_NAME_PARTS)} OR lext IN {in_list(fixed.CONFIG_EXTENSIONS)} OR lname IN ('.env', 'dockerfile') OR starts_with(lname, '.env.') THEN 'Config'
 WHEN lext IN {in_list(fixed.DOC_EXTENSIONS)} OR lname IN {in_list(fixed.DOC_NAMES)} THEN 'Documentation' WHEN lext IN {in_list(fixed.DATA_EXTENSIONS)} THEN 'Data' WHEN lext IN {in_list(fixed.BINARY_EXTENSIONS)} THEN 'Binary' WHEN language IS NOT NULL THEN 'Source' ELSE 'Other' END"""


@query("file_classes", "PRJ2 PRJ3 PRJ4 FLT11 FLT12 SRC3 SC12", f"""WITH {cte("file_paths")}, n AS (SELECT *, {_NAME} AS name, {_EXT} AS ext FROM file_paths), l AS (SELECT *, lower(name) AS lname, lower(ext) AS lext, {_LANG} AS language FROM n)
SELECT file_id, path, language, {_FTYPE} AS file_type, lower(path) IN {in_list(fixed.KEY_FILES)} OR ends_with(lower(path), 'mod.rs') OR ends_with(lower(path), '/main.rs') OR contains(lower(path), 'src/lib') OR contains(lower(path), 'src/main') AS key_file,
 ends_with(name, '.rs') AS glob_rs, starts_with(name, 'test') AS glob_test, lext NOT IN {in_list(fixed.UNSEARCHED_EXTENSIONS)} AS searchable, starts_with(name, '.') OR ext = 'md' OR name = 'view.js' OR contains(path, 'view.js') OR contains(path, 'a/b') AS ignored,
 CASE WHEN size >= 1073741824 THEN printf('%.2f GB', size / 1073741824) WHEN size >= 1048576 THEN printf('%.2f MB', size / 1048576) WHEN size >= 1024 THEN printf('%.2f KB', size / 1024) ELSE size || ' B' END AS size_text FROM l""")
def file_classes(spark, sf):
    path = F.col("path")
    name = tx.file_name(path)
    f = derived(spark, sf, "file_paths").withColumn("language", search.language(path))
    return f.select(
        "file_id", "path", "language", search.file_type(path, F.col("language")).alias("file_type"), search.is_key_file(path).alias("key_file"),
        search.glob_match(name, "*.rs").alias("glob_rs"), search.glob_match(name, "test*").alias("glob_test"), search.searchable(path).alias("searchable"),
        search.ignored(path, ["*.md", "view.js", "a/b"]).alias("ignored"), tx.format_bytes(F.col("size")).alias("size_text"))


def _asked(spark, sf):
    """Benchmark texts, the same ones altered, and every message."""
    b = table(spark, sf, "benchmark")
    altered = F.expr("CASE item_id % 4 WHEN 0 THEN text || ' ' || text WHEN 1 THEN 'please ' || text WHEN 2 THEN substr(text, 1 + instr(text, ' ')) ELSE '  ' || text || '  x y z w v u t s r q p o' END")
    c = table(spark, sf, "conversations")
    return (b.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text")
            .unionByName(b.select(F.concat(F.lit("a"), F.col("item_id").cast("string")).alias("id"), altered.alias("text")))
            .unionByName(c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"), "text")))


def _fuzzy_sql(limit: str) -> str:
    return f"""WITH n AS (SELECT item_id, array_to_string(list_filter(string_split_regex(lower(text), '{WS}+'), lambda w: w <> ''), ' ') AS cached FROM benchmark),
cache AS (SELECT cached, max(item_id) AS cached_id FROM n GROUP BY 1 {limit}), asked AS (SELECT 'b' || item_id AS id, text FROM benchmark UNION ALL
 SELECT 'a' || item_id, CASE item_id % 4 WHEN 0 THEN text || ' ' || text WHEN 1 THEN 'please ' || text WHEN 2 THEN substr(text, 1 + instr(text, ' ')) ELSE '  ' || text || '  x y z w v u t s r q p o' END FROM benchmark
 UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations),
a AS (SELECT id, array_to_string(list_filter(string_split_regex(lower(text), '{WS}+'), lambda w: w <> ''), ' ') AS query FROM asked),
s AS (SELECT id, query, cached, cached_id, list_distinct(string_split(query, ' ')) AS x, list_distinct(string_split(cached, ' ')) AS y FROM a, cache),
j AS (SELECT *, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS sim FROM s)
SELECT id, arg_max(cached_id, (query = cached, sim, cached_id)) AS cached_id, round(arg_max(sim, (query = cached, sim, cached_id)), 6) AS similarity FROM j WHERE sim >= 0.85 GROUP BY id"""


@query("fuzzy_match", "JN10 CL9 ST1 SC3", _fuzzy_sql(f"ORDER BY 2 DESC LIMIT {fixed.FUZZY_CACHE}"))
def fuzzy_match(spark, sf):
    """Against the cache of the client, which holds so many texts."""
    cache = similarity.cached_texts(table(spark, sf, "benchmark"), "item_id", "text", fixed.FUZZY_CACHE)
    return similarity.fuzzy_lookup(_asked(spark, sf), "id", "text", cache).withColumn("similarity", F.round("similarity", 6))


@query("fuzzy_match_all", "JN10 CL9 ST1 SC3", _fuzzy_sql(""))
def fuzzy_match_all(spark, sf):
    cache = similarity.cached_texts(table(spark, sf, "benchmark"), "item_id", "text", None)
    return similarity.fuzzy_lookup(_asked(spark, sf), "id", "text", cache).withColumn("similarity", F.round("similarity", 6))


@query("snippets", "CX5 SC11 SC24 SC26 FLT6", f"""WITH {cte("snippet_files")}, k AS (SELECT file_id, size, content, json_keys(content)[1] AS name FROM snippet_files),
b AS (SELECT file_id, size, name, json_extract(content, '$.*')[1] AS s FROM k),
c AS (SELECT file_id, size, name, coalesce(json_extract_string(s, '$.description'), '') AS description, CASE WHEN json_type(s, '$.body') = 'ARRAY' THEN array_to_string(CAST(json_extract(s, '$.body') AS VARCHAR[]), chr(10)) ELSE json_extract_string(s, '$.body') END AS code FROM b)
SELECT file_id, replace(lower(name), ' ', '-') AS snippet_id, description, replace(replace(replace(code, chr(36) || '{{name}}', 'item'), chr(36) || '{{size}}', CAST(size AS VARCHAR)), chr(36) || '{{other}}', '') AS expanded FROM c""")
def snippets(spark, sf):
    """Snippet import: body as text or list of lines; placeholders take a value, else a default, else nothing."""
    from weftline.sources.manifests import expand, imported_snippets

    s = imported_snippets(derived(spark, sf, "snippet_files"), "content", ["file_id", "size"])
    values = F.create_map(F.lit("size"), F.col("size").cast("string"))
    defaults = F.create_map(F.lit("name"), F.lit("item"))
    return s.select("file_id", "snippet_id", "description", expand(F.col("code"), ["name", "size", "other"], values, defaults).alias("expanded"))
