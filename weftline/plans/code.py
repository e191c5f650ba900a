"""Code structure queries over the derived source files, and line metrics over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as tx
from weftline.operators import chunking, code
from weftline.operators.rows import unnest_fields, worked_out
from weftline.plans.corpus import cte, derived
from weftline.plans.rules import TRIM
from weftline.plans.sqltext import any_starts, in_list, q
from weftline.registry import query
from weftline.sources.tables import spread, table


def lines_sql(col: str) -> str:
    return f"CASE WHEN {col} = '' THEN [] ELSE string_split_regex(regexp_replace({col}, '\\r?\\n\\z', ''), '\\r?\\n') END"


def count_sql(col: str, token: str) -> str:
    return f"CAST((strlen({col}) - strlen(replace({col}, {q(token)}, ''))) / {len(token)} AS BIGINT)"


def complexity_sql(col: str) -> str:
    return "(1 + " + " + ".join(count_sql(col, t) for t in fixed.DECISION_TOKENS) + ")"


_SLASH, _HASH = in_list(fixed.SLASH_COMMENT_LANGUAGES), in_list(fixed.HASH_COMMENT_LANGUAGES)

# One row per line: trimmed text, nesting delta, comment toggles.
LINE_CTE = f"""{cte("src_files")}, ls AS (SELECT file_id, language, content, {lines_sql("content")} AS ls FROM src_files),
ln AS (SELECT file_id, language, len(ls) AS n, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM ls), tl AS (SELECT *, regexp_replace(line, {TRIM}) AS t FROM ln)"""

_METRICS_CTE = f"""m0 AS (SELECT *, strlen(regexp_replace(line, '[^{{(\\[]', '', 'g')) - strlen(regexp_replace(line, '[^}})\\]]', '', 'g')) AS delta,
 CASE WHEN language IN {_SLASH} THEN CASE WHEN t = '' THEN NULL WHEN ends_with(t, '*/') THEN 0 WHEN starts_with(t, '/*') THEN 1 END END AS toggle,
 CASE WHEN language IN {_HASH} AND (starts_with(t, '\"\"\"') OR starts_with(t, '''''''')) THEN 1 ELSE 0 END AS quote FROM tl),
m1 AS (SELECT *, coalesce(last_value(toggle IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY i), 0) AS in_block, sum(quote) OVER (PARTITION BY file_id ORDER BY i) % 2 AS in_quote,
 sum(delta) OVER (PARTITION BY file_id ORDER BY i) AS depth FROM m0),
m2 AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN CASE WHEN language IN {_SLASH} THEN ends_with(t, '*/') OR in_block = 1 OR starts_with(t, '//') WHEN language IN {_HASH} THEN quote = 1 OR in_quote = 1 OR starts_with(t, '#')
 ELSE starts_with(t, '//') OR starts_with(t, '#') END THEN 'comment' ELSE 'code' END AS cls FROM m1),
metrics AS (SELECT file_id, count(*) AS total_lines, count(*) FILTER (cls = 'code') AS code_lines, count(*) FILTER (cls = 'comment') AS comment_lines, count(*) FILTER (cls = 'blank') AS blank_lines,
 greatest(0, max(depth)) AS max_nesting FROM m2 GROUP BY file_id)"""

_KIND = f"""CASE WHEN language = 'Rust' THEN CASE WHEN {any_starts('t', ['pub fn ', 'fn ', 'pub async fn ', 'async fn '])} AND regexp_matches(t, 'fn [^(]*\\([^)]*\\)') THEN 'Function' WHEN {any_starts('t', ['pub struct ', 'struct '])} THEN 'Struct'
 WHEN {any_starts('t', ['pub enum ', 'enum '])} THEN 'Enum' WHEN {any_starts('t', ['pub trait ', 'trait '])} THEN 'Trait' WHEN starts_with(t, 'impl ') THEN 'Module' END
 WHEN language = 'Python' THEN CASE WHEN {any_starts('t', ['def ', 'async def '])} AND contains(t, '(') THEN 'Function' WHEN starts_with(t, 'class ') THEN 'Class' END
 ELSE CASE WHEN {any_starts('t', ['function ', 'async function'])} THEN 'Function' WHEN starts_with(t, 'const ') AND contains(t, ' = (') THEN 'Function' WHEN starts_with(t, 'class ') THEN 'Class' END END"""

# Symbols: every opening line joined with the braces (or lines) after it.
SYMBOL_CTE = f"""{LINE_CTE}, k AS (SELECT *, {_KIND} AS kind FROM tl), s0 AS (SELECT * FROM k WHERE kind IS NOT NULL),
s1 AS (SELECT file_id, language, i, n, line, t, kind, CASE WHEN language = 'Rust' AND kind = 'Function' THEN trim(regexp_extract(t, 'fn ([^(]*)\\(', 1)) WHEN kind = 'Struct' THEN regexp_extract(t, 'struct ([^<{{(;\\s]*)', 1)
 WHEN kind = 'Enum' THEN regexp_extract(t, 'enum ([^<{{\\s]*)', 1) WHEN kind = 'Trait' THEN regexp_extract(t, 'trait ([^<{{:\\s]*)', 1) WHEN kind = 'Module' THEN 'impl ' || rtrim(string_split(t, ' ')[2], '<{{')
 WHEN language = 'Python' AND kind = 'Function' THEN regexp_extract(t, 'def ([^(]*)\\(', 1) WHEN language = 'Python' THEN regexp_extract(t, 'class ([^(:]*)', 1)
 WHEN kind = 'Class' THEN regexp_extract(t, 'class ([^{{ ]*)', 1) WHEN starts_with(t, 'const ') THEN 'const' ELSE trim(regexp_extract(t, 'function([^(]*)\\(', 1)) END AS name FROM s0),
br AS (SELECT file_id, i, unnest(string_split(regexp_replace(line, '[^{{}}]', '', 'g'), '')) AS b, unnest(range(1, length(regexp_replace(line, '[^{{}}]', '', 'g')) + 1)) AS j FROM tl WHERE regexp_matches(line, '[{{}}]')),
bd AS (SELECT s1.file_id, s1.i AS s, br.i AS pos, br.b, sum(CASE WHEN b = '{{' THEN 1 ELSE -1 END) OVER w AS depth, sum(CASE WHEN b = '{{' THEN 1 ELSE 0 END) OVER w AS ups
 FROM s1 JOIN br ON br.file_id = s1.file_id AND br.i >= s1.i WINDOW w AS (PARTITION BY s1.file_id, s1.i ORDER BY br.i, br.j)),
be AS (SELECT file_id, s, min(pos) AS e FROM bd WHERE b = '}}' AND depth = 0 AND ups > 0 GROUP BY 1, 2),
pe AS (SELECT s1.file_id, s1.i AS s, min(tl.i) - 1 AS e FROM s1 JOIN tl ON tl.file_id = s1.file_id AND tl.i > s1.i AND s1.language = 'Python' AND tl.t <> ''
 AND strlen(tl.line) - strlen(tl.t) <= strlen(s1.line) - strlen(ltrim(s1.line)) GROUP BY 1, 2),
s2 AS (SELECT s1.*, CAST(CASE WHEN kind = 'Struct' AND contains(t, ';') THEN i WHEN language = 'Python' THEN coalesce(pe.e, n) ELSE coalesce(be.e, n) END AS BIGINT) AS line_end FROM s1
 LEFT JOIN be ON be.file_id = s1.file_id AND be.s = s1.i LEFT JOIN pe ON pe.file_id = s1.file_id AND pe.s = s1.i),
s3 AS (SELECT s2.*, array_to_string(ls.ls[i:line_end], chr(10)) AS block, CASE WHEN i > 1 THEN ls.ls[i - 1] ELSE '' END AS above FROM s2 JOIN ls ON ls.file_id = s2.file_id),
sym AS (SELECT file_id, language, kind, name, CASE WHEN language = 'Rust' AND kind <> 'Module' THEN CASE WHEN starts_with(t, 'pub') THEN 'Public' ELSE 'Private' END
 WHEN language = 'Python' AND kind = 'Function' AND starts_with(name, '_') AND NOT starts_with(name, '__') THEN 'Private' ELSE 'Public' END AS visibility,
 CASE WHEN language = 'Rust' AND kind = 'Function' THEN array_to_string(list_filter(list_transform(string_split(regexp_extract(t, 'fn [^(]*\\(([^)]*)\\)', 1), ','), lambda p: trim(p)), lambda p: p <> ''), '; ') ELSE '' END AS params,
 CASE WHEN language = 'Rust' AND kind = 'Function' AND contains(t, '->') THEN trim(regexp_extract(t, '->([^{{]*)', 1)) END AS return_type, i AS line_start, line_end,
 CASE WHEN kind = 'Function' THEN {complexity_sql("block")} ELSE 1 END AS complexity, t, block, above FROM s3)"""


def _files(spark, sf):
    return derived(spark, sf, "src_files")


@query("symbols", "CD3 CX3 WN6 WN7", f"""WITH {SYMBOL_CTE} SELECT file_id, kind, name, visibility, params, return_type, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, complexity FROM sym""")
def symbols(spark, sf):
    s = code.symbols(_files(spark, sf), ["file_id"])
    return s.select("file_id", "kind", "name", "visibility", F.array_join("params", "; ").alias("params"), "return_type", "line_start", "line_end", "complexity")


@query("file_metrics", "CD1 CD2 CD7 WN4 WN5", f"""WITH {SYMBOL_CTE}, {_METRICS_CTE}, f AS (SELECT file_id, count(*) FILTER (kind = 'Function') AS functions, count(*) FILTER (kind IN ('Class', 'Struct')) AS classes,
 coalesce(avg(line_end - line_start + 1) FILTER (kind = 'Function'), 0.0) AS avg_len FROM sym GROUP BY file_id)
SELECT m.file_id, CAST(total_lines AS INTEGER) AS total_lines, CAST(code_lines AS INTEGER) AS code_lines, CAST(comment_lines AS INTEGER) AS comment_lines, CAST(blank_lines AS INTEGER) AS blank_lines,
 CAST(max_nesting AS INTEGER) AS max_nesting, coalesce(functions, 0) AS functions, coalesce(classes, 0) AS classes, round(coalesce(avg_len, 0.0), 6) AS avg_function_length, {complexity_sql("content")} AS complexity
FROM metrics m LEFT JOIN f USING (file_id) JOIN ls USING (file_id)""")
def file_metrics(spark, sf):
    s = code.with_structure(_files(spark, sf)).withColumn("m", code.line_metrics(F.col("lines"), F.col("language")))
    functions = F.filter("symbols", lambda x: x["kind"] == "Function")
    total = F.aggregate(functions, F.lit(0), lambda a, x: a + x["line_end"] - x["line_start"] + 1)
    return s.select(
        "file_id", F.size("lines").alias("total_lines"), F.col("m.code").alias("code_lines"), F.col("m.comment").alias("comment_lines"), F.col("m.blank").alias("blank_lines"),
        "m.max_nesting", F.size(functions).cast("bigint").alias("functions"),
        F.size(F.filter("symbols", lambda x: x["kind"].isin("Class", "Struct"))).cast("bigint").alias("classes"),
        F.round(F.when(F.size(functions) > 0, total / F.size(functions)).otherwise(0.0), 6).alias("avg_function_length"), code.complexity(F.col("content")).alias("complexity"))


@query("text_complexity", "CD2 SC4 WN4", f"""SELECT 'd' || doc_id AS id, {complexity_sql("text")} AS complexity FROM documents UNION ALL SELECT 'p' || page_id, {complexity_sql("html")} FROM pages""")
def text_complexity(spark, sf):
    d = spread(table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text"))
    p = spread(table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text")))
    return d.unionByName(p).select("id", code.complexity(F.col("text")).alias("complexity"))


_IMPORT_SQL = """CASE WHEN language = 'Rust' AND starts_with(t, 'use ') THEN rtrim(regexp_replace(t, '^(use )+', ''), ';') WHEN language = 'Python' AND (starts_with(t, 'import ') OR starts_with(t, 'from ')) THEN string_split_regex(t, '\\s+')[2]
 WHEN language IN ('JavaScript', 'TypeScript') AND (starts_with(t, 'import ') OR contains(t, ' require(')) THEN CASE WHEN contains(t, 'from ') THEN trim(trim(regexp_extract(t, 'from (.*)$', 1)), '''";') ELSE trim(regexp_extract(t, 'require\\(([^)]*)\\)', 1), '''"') END END"""


@query("imports", "CD4", f"""WITH {LINE_CTE}, m AS (SELECT *, {_IMPORT_SQL} AS module FROM tl) SELECT file_id, CAST(i AS INTEGER) AS line, module,
 CASE language WHEN 'Rust' THEN NOT (starts_with(module, 'crate::') OR starts_with(module, 'self::') OR starts_with(module, 'super::')) WHEN 'Python' THEN NOT starts_with(module, '.') ELSE NOT contains(t, './') END AS external FROM m WHERE module IS NOT NULL""")
def imports(spark, sf):
    return code.imports(_files(spark, sf), "file_id")


@query("lint_issues", "CD5", f"""WITH {SYMBOL_CTE}
SELECT file_id, 'Warning' AS severity, 'long-function' AS rule, CAST(line_start AS INTEGER) AS line, 'Function ''' || name || ''' is too long (' || (line_end - line_start) || ' lines)' AS message FROM sym WHERE kind = 'Function' AND line_end - line_start > 50
UNION ALL SELECT file_id, 'Warning', 'high-complexity', CAST(line_start AS INTEGER), 'Function ''' || name || ''' has high complexity (' || complexity || ')' FROM sym WHERE kind = 'Function' AND complexity > 10
UNION ALL SELECT file_id, 'Info', 'todo-comment', CAST(i AS INTEGER), 'Found TODO/FIXME comment: ' || t FROM tl WHERE regexp_matches(line, 'TODO|FIXME|HACK')
UNION ALL SELECT file_id, 'Hint', 'unwrap-used', CAST(i AS INTEGER), 'Consider handling the error instead of unwrap()' FROM tl WHERE language = 'Rust' AND contains(line, 'unwrap()') AND NOT contains(line, '// ')
UNION ALL SELECT file_id, 'Hint', 'no-console', CAST(i AS INTEGER), 'Remove console.log before production' FROM tl WHERE language IN ('JavaScript', 'TypeScript') AND contains(line, 'console.log')""")
def lint_issues(spark, sf):
    return code.issues(_files(spark, sf), "file_id")


@query("function_calls", "CD6 CX3 AG15", f"""WITH {cte("src_files")} SELECT file_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(content, '([a-zA-Z_][a-zA-Z0-9_]*)\\s*\\(', 1), lambda x: x NOT IN {in_list(fixed.CALL_EXCLUSIONS)}))), ',') AS calls,
 array_to_string(CASE language WHEN 'Rust' THEN regexp_extract_all(content, 'let\\s+(mut\\s+)?([a-zA-Z_][a-zA-Z0-9_]*)', 2) WHEN 'Python' THEN regexp_extract_all(content, '\\A(\\s*)([a-zA-Z_][a-zA-Z0-9_]*)\\s*=', 2) ELSE regexp_extract_all(content, '(const|let|var)\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 2) END, ',') AS locals FROM src_files""")
def function_calls(spark, sf):
    return _files(spark, sf).select("file_id", F.array_join(code.calls(F.col("content")), ",").alias("calls"), F.array_join(code.local_names(F.col("content"), F.col("language")), ",").alias("locals"))


_DOC_CTE = f"""{LINE_CTE}, r0 AS (SELECT *, starts_with(t, '///') AS doc, {any_starts('t', ['pub fn ', 'fn '])} AS is_fn, {any_starts('t', ['pub struct ', 'struct '])} AS is_st FROM tl WHERE language = 'Rust'),
r1 AS (SELECT *, max(CASE WHEN t <> '' AND NOT starts_with(t, '//') THEN i END) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cleared FROM r0),
rust_docs AS (SELECT a.file_id, CASE WHEN a.is_fn THEN 'function' ELSE 'struct' END AS kind, CASE WHEN a.is_fn THEN trim(regexp_extract(a.t, 'fn ([^(]*)\\(', 1)) ELSE regexp_extract(a.t, 'struct ([^ {{(<]*)', 1) END AS name,
 coalesce(string_agg(trim(ltrim(d.t, '/')), ' ' ORDER BY d.i), '') AS description FROM r1 a LEFT JOIN r0 d ON d.file_id = a.file_id AND d.doc AND d.i < a.i AND d.i > coalesce(a.cleared, 0) WHERE a.is_fn OR a.is_st GROUP BY a.file_id, a.i, a.is_fn, a.t),
pd AS (SELECT a.file_id, a.i, a.t, b.t AS nxt FROM tl a LEFT JOIN tl b ON b.file_id = a.file_id AND b.i = a.i + 1 WHERE a.language = 'Python' AND (starts_with(a.t, 'def ') OR starts_with(a.t, 'class '))),
pq AS (SELECT pd.*, (SELECT min(l.i) FROM tl l WHERE l.file_id = pd.file_id AND l.i > pd.i + 1 AND contains(l.line, '\"\"\"')) AS stop FROM pd),
python_docs AS (SELECT file_id, CASE WHEN starts_with(t, 'def ') THEN 'function' ELSE 'class' END AS kind, CASE WHEN starts_with(t, 'def ') THEN regexp_extract(t, 'def ([^(]*)\\(', 1) ELSE regexp_extract(t, 'class ([^(:]*)', 1) END AS name,
 CASE WHEN NOT coalesce(starts_with(nxt, '\"\"\"'), false) THEN '' WHEN length(nxt) > 6 AND ends_with(nxt, '\"\"\"') THEN nxt[4:-4] ELSE trim(nxt[4:] || ' ' || (SELECT string_agg(CASE WHEN l.i = stop THEN trim(string_split(l.line, '\"\"\"')[1]) ELSE l.t END, ' ' ORDER BY l.i) FROM tl l WHERE l.file_id = pq.file_id AND l.i BETWEEN pq.i + 2 AND pq.stop)) END AS description FROM pq)"""


@query("doc_items", "CD14 WN9 CD21", f"""WITH {_DOC_CTE} SELECT file_id, kind, name, description FROM rust_docs UNION ALL SELECT file_id, kind, name, description FROM python_docs""")
def doc_items(spark, sf):
    return code.doc_items(_files(spark, sf).filter(F.col("language").isin("Rust", "Python")), "file_id").select("file_id", "kind", "name", "description")


@query("script_doc_items", "CD21")
def script_doc_items(spark, sf):
    return code.doc_items(_files(spark, sf).filter(F.col("language").isin("JavaScript", "TypeScript")), "file_id").select("file_id", "kind", "name", "description")


@query("doc_coverage", "CD14 AG8", f"""WITH {_DOC_CTE}, a AS (SELECT 'Rust' AS language, * FROM rust_docs UNION ALL SELECT 'Python', * FROM python_docs)
SELECT language, count(*) AS items, count(*) FILTER (description <> '') AS documented, round(CASE WHEN count(*) = 0 THEN 100.0 ELSE count(*) FILTER (description <> '') * 100.0 / count(*) END, 6) AS coverage FROM a GROUP BY language""")
def doc_coverage(spark, sf):
    items = code.doc_items(_files(spark, sf).filter(F.col("language").isin("Rust", "Python")), "file_id")
    done = F.count_if(F.col("description") != "")
    return items.groupBy("language").agg(F.count("*").alias("items"), done.alias("documented"),
                                         F.round(F.when(F.count("*") == 0, 100.0).otherwise(done * 100.0 / F.count("*")), 6).alias("coverage"))


@query("symbol_chunks", "CH3 CH4 CH5", f"""WITH {SYMBOL_CTE}, c AS (SELECT file_id, lower(kind) AS chunk_type, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, lower(kind) || ' `' || name || '` (lines ' || line_start || '-' || line_end || '): No documentation' AS summary, md5(block) AS text_md5 FROM sym WHERE language IN ('Rust', 'Python'))
SELECT * FROM c UNION ALL SELECT file_id, 'file', 1, CAST(len(ls) AS INTEGER), 'file chunk (lines 1-' || len(ls) || ', ' || len(ls) || ' lines)', md5(content) FROM ls WHERE file_id NOT IN (SELECT file_id FROM c)""")
def symbol_chunks(spark, sf):
    """Chunks by symbol for languages with a symbol extractor in use, else by line windows."""
    s = code.with_structure(_files(spark, sf))

    def piece(x):
        text = F.array_join(F.slice("lines", x["line_start"], F.greatest(x["line_end"] - x["line_start"] + 1, F.lit(0))), "\n")
        kind = F.lower(x["kind"])
        span = F.concat(F.lit("` (lines "), x["line_start"].cast("string"), F.lit("-"), x["line_end"].cast("string"), F.lit("): No documentation"))
        return F.struct(kind.alias("chunk_type"), x["line_start"].alias("line_start"), x["line_end"].alias("line_end"), F.concat(kind, F.lit(" `"), x["name"], span).alias("summary"),
                        F.md5(text).alias("text_md5"))

    def by_line(x):
        summary = chunking.chunk_summary("file", x["line_start"], x["line_end"], x["line_end"] - x["line_start"] + 1)
        return F.struct(F.lit("file").alias("chunk_type"), x["line_start"].alias("line_start"), x["line_end"].alias("line_end"), summary.alias("summary"), F.md5(x["text"]).alias("text_md5"))

    by_symbol = F.col("language").isin("Rust", "Python") & (F.size("symbols") > 0)
    pieces = F.when(by_symbol, F.transform("symbols", piece)).otherwise(F.transform(chunking.line_pieces(F.col("content"), F.col("lines")), by_line))
    return unnest_fields(s, ["file_id"], pieces)


_REVIEW_KEYWORD = "regexp_extract_all(block, '\\b(if|match|while|loop|for)\\b')"


@query("review_grade", "CD10 CD11 CD12 CD13 JN9", f"""WITH {SYMBOL_CTE}, r AS (SELECT * FROM sym WHERE language = 'Rust'),
inner_fn AS (SELECT DISTINCT f.file_id, f.line_start FROM r f JOIN r b ON b.file_id = f.file_id AND f.kind = 'Function' AND b.kind IN ('Module', 'Trait') AND f.line_start > b.line_start AND f.line_start <= b.line_end),
top AS (SELECT r.* FROM r WHERE kind = 'Function' AND (file_id, line_start) NOT IN (SELECT (file_id, line_start) FROM inner_fn)),
cx AS (SELECT file_id, count(*) FILTER (1 + len({_REVIEW_KEYWORD}) > 10) AS complex_issues FROM top GROUP BY file_id),
pm AS (SELECT file_id, count(*) FILTER (len(string_split(params, '; ')) > 5) AS long_params FROM top GROUP BY file_id),
gc AS (SELECT m.file_id, m.line_start, count(*) AS items FROM r m JOIN r f ON f.file_id = m.file_id AND m.kind = 'Module' AND f.kind = 'Function' AND f.line_start > m.line_start AND f.line_start <= m.line_end GROUP BY 1, 2),
mg AS (SELECT file_id, len(list_filter(regexp_extract_all(content, '[A-Za-z0-9_.]+'), lambda w: regexp_matches(w, '^[0-9]+$') AND TRY_CAST(w AS BIGINT) NOT IN (0, 1))) AS magic FROM ls WHERE language = 'Rust'),
ts AS (SELECT file_id, name FROM top WHERE regexp_matches(trim(above), '^#\\[(test|tokio)')), pl AS (SELECT file_id, name, line_start FROM top WHERE NOT regexp_matches(trim(above), '^#\\[(test|tokio)') AND NOT starts_with(name, '_')),
un AS (SELECT pl.file_id, count(*) AS untested FROM pl WHERE NOT EXISTS (SELECT 1 FROM ts WHERE ts.file_id = pl.file_id AND contains(ts.name, pl.name)) GROUP BY 1),
st AS (SELECT file_id, greatest(0, 100 - len(list_filter(ls, lambda x: ends_with(x, ' ') OR ends_with(x, chr(9)))) - len(list_filter(ls, lambda x: strlen(x) > 100))) AS style FROM ls WHERE language = 'Rust'),
v AS (SELECT st.file_id, style, coalesce(complex_issues, 0) AS complex_issues, coalesce(long_params, 0) + coalesce(magic, 0) + coalesce((SELECT count(*) FROM gc WHERE gc.file_id = st.file_id AND items > 20), 0) AS smells, coalesce(untested, 0) AS untested
 FROM st LEFT JOIN cx USING (file_id) LEFT JOIN pm USING (file_id) LEFT JOIN mg USING (file_id) LEFT JOIN un USING (file_id)),
z AS (SELECT *, style * CAST(0.3 AS DOUBLE) + (100 - least(complex_issues * 10, 100)) * CAST(0.3 AS DOUBLE) + (100 - least(smells * 15, 100)) * CAST(0.2 AS DOUBLE) + (100 - least(untested * 20, 100)) * CAST(0.2 AS DOUBLE) AS score FROM v)
SELECT file_id, CAST(style AS INTEGER) AS style, CAST(complex_issues AS BIGINT) AS complex_issues, CAST(smells AS BIGINT) AS smells, CAST(untested AS BIGINT) AS untested, round(score, 6) AS score,
 CASE WHEN floor(score) >= 90 THEN 'A' WHEN floor(score) >= 80 THEN 'B' WHEN floor(score) >= 70 THEN 'C' WHEN floor(score) >= 60 THEN 'D' ELSE 'F' END AS grade,
 CAST(complex_issues + smells + CASE WHEN untested > 0 THEN 1 ELSE 0 END + CASE WHEN style < 80 THEN 1 ELSE 0 END AS BIGINT) AS suggestions FROM z""")
def review_grade(spark, sf):
    from weftline.operators.review import review

    r = review(_files(spark, sf).filter(F.col("language") == "Rust"))
    return r.select("file_id", "style", F.size("complex").cast("bigint").alias("complex_issues"), "smells", F.size("untested").cast("bigint").alias("untested"),
                    F.round("score", 6).alias("score"), "grade", F.size("suggestions").cast("bigint").alias("suggestions"))


@query("review_suggestions", "CD13 CD10")
def review_suggestions(spark, sf):
    from weftline.operators.review import review

    r = review(_files(spark, sf).filter(F.col("language") == "Rust"))
    return unnest_fields(r, ["file_id"], "suggestions")


@query("control_nesting", "CD10")
def control_nesting(spark, sf):
    """Functions whose control blocks nest deeper than four."""
    s = code.with_structure(_files(spark, sf).filter(F.col("language") == "Rust"))

    def measured(x):
        text = F.array_join(F.slice("lines", x["line_start"], F.greatest(x["line_end"] - x["line_start"] + 1, F.lit(0))), "\n")
        return F.struct(x["name"].alias("name"), code.control_depth(text).alias("depth"))

    functions = F.filter("symbols", lambda x: x["kind"] == "Function")
    return unnest_fields(s, ["file_id"], F.transform(functions, measured)).withColumn("too_deep", F.col("depth") > 4)


def _snapshots(spark, sf):
    """Documents before and after an edit."""
    return spread(table(spark, sf, "documents").selectExpr("doc_id", "text AS old", _EDIT + " AS new"))


_EDIT = "CASE doc_id % 5 WHEN 0 THEN replace(text, 'the ', 'THE ') WHEN 1 THEN text || chr(10) || 'added' WHEN 2 THEN substr(text, 1 + instr(text, chr(10))) WHEN 3 THEN '' ELSE text END"
_DIFF_CTE = f"""d AS (SELECT doc_id, text AS old, {_EDIT} AS new FROM documents), a AS (SELECT doc_id, old, new, {lines_sql("old")} AS o, {lines_sql("new")} AS n FROM d),
ix AS (SELECT doc_id, o, n, unnest(range(1, greatest(len(o), len(n)) + 1)) AS i FROM a), p AS (SELECT doc_id, i, CASE WHEN i <= len(o) THEN o[i] END AS x, CASE WHEN i <= len(n) THEN n[i] END AS y FROM ix)"""


@query("diff_stats", "CD15 CX12", f"""WITH {_DIFF_CTE}, c AS (SELECT doc_id, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND x <> y) AS changed FROM p GROUP BY 1)
SELECT a.doc_id, CAST(greatest(len(n) - len(o), 0) + coalesce(changed, 0) AS INTEGER) AS additions, CAST(greatest(len(o) - len(n), 0) + coalesce(changed, 0) AS INTEGER) AS deletions, old = '' AND new <> '' AS is_new, old <> '' AND new = '' AS is_deleted, old <> new AS has_changes FROM a LEFT JOIN c USING (doc_id)""")
def diff_stats(spark, sf):
    d = _snapshots(spark, sf)
    plus, minus = code.diff_stats(tx.lines(F.col("old")), tx.lines(F.col("new")))
    return d.select("doc_id", plus.alias("additions"), minus.alias("deletions"), ((F.col("old") == "") & (F.col("new") != "")).alias("is_new"),
                    ((F.col("old") != "") & (F.col("new") == "")).alias("is_deleted"), (F.col("old") != F.col("new")).alias("has_changes"))


def _diff_sql(limit: str) -> str:
    return f"""WITH {_DIFF_CTE}, f AS (SELECT doc_id, coalesce(min(i) FILTER (x <> y), 1) AS first FROM p GROUP BY 1), w AS (SELECT p.*, first, greatest(first - 3, 1) AS start, o, n FROM p JOIN f USING (doc_id) JOIN a USING (doc_id)),
e AS (SELECT *, CASE WHEN x = y THEN ' ' || x WHEN x IS NOT NULL AND y IS NOT NULL THEN '-' || x || chr(10) || '+' || y WHEN x IS NOT NULL THEN '-' || x ELSE '+' || y END AS txt, CASE WHEN x <> y THEN 2 ELSE 1 END AS k FROM w WHERE i >= first),
cum AS (SELECT *, first - start + coalesce(sum(k) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e), kept AS (SELECT * FROM cum {limit}),
g AS (SELECT doc_id, any_value(start) AS start, any_value(first) AS first, max(i) AS last, any_value(len(o)) AS no, any_value(len(n)) AS nn, any_value(o) AS o, string_agg(txt, chr(10) ORDER BY i) AS body FROM kept GROUP BY 1),
h AS (SELECT doc_id, '@@ -' || start || ',' || (least(last, no) - start + 1) || ' +' || start || ',' || (least(last, nn) - start + 1) || ' @@' || chr(10) || CASE WHEN first > start THEN array_to_string(list_transform(o[start:first - 1], lambda z: ' ' || z), chr(10)) || chr(10) ELSE '' END || body AS diff FROM g WHERE no > 0 AND nn > 0
 UNION ALL SELECT doc_id, '@@ -1,' || len(o) || ' +0,0 @@' || chr(10) || array_to_string(list_transform(o, lambda z: '-' || z), chr(10)) FROM a WHERE len(n) = 0 AND len(o) > 0
 UNION ALL SELECT doc_id, '@@ -0,0 +1,' || len(n) || ' @@' || chr(10) || array_to_string(list_transform(n, lambda z: '+' || z), chr(10)) FROM a WHERE len(o) = 0 AND len(n) > 0)
SELECT doc_id, '--- a/' || doc_id || chr(10) || '+++ b/' || doc_id || chr(10) || diff || chr(10) AS diff FROM h"""


def _diff_texts(spark, sf, most):
    d = _snapshots(spark, sf).select("doc_id", tx.lines(F.col("old")).alias("o"), tx.lines(F.col("new")).alias("n"))
    h = worked_out(d, ["doc_id"], code.diff_hunk(F.col("o"), F.col("n"), most), "h").filter(F.col("h").isNotNull())
    key = F.col("doc_id").cast("string")
    head = F.format_string("@@ -%d,%d +%d,%d @@", "h.old_start", "h.old_count", "h.new_start", "h.new_count")
    return h.select("doc_id", F.concat(F.lit("--- a/"), key, F.lit("\n+++ b/"), key, F.lit("\n"), head, F.lit("\n"), F.array_join("h.lines", "\n"), F.lit("\n")).alias("diff"))


@query("diff_text", "CD15 CX12 SC32", _diff_sql("WHERE before <= 50"))
def diff_text(spark, sf):
    """The preview, which stops after 50 lines."""
    return _diff_texts(spark, sf, 50)


@query("diff_text_whole", "CD15 CX12 SC32", _diff_sql(""))
def diff_text_whole(spark, sf):
    return _diff_texts(spark, sf, None)


@query("extract_code", "SC36", f"""WITH {cte("src_files")}, e AS (SELECT file_id, regexp_extract(path, '\\.([^.]*)$', 1) AS ext, array_to_string(({lines_sql("content")})[2:3], chr(10)) AS code FROM src_files)
SELECT file_id, CASE ext WHEN 'rs' THEN 'fn part() {{' || chr(10) || '    ' || replace(code, chr(10), chr(10) || '    ') || chr(10) || '}}' WHEN 'py' THEN 'def part():' || chr(10) || '    ' || replace(code, chr(10), chr(10) || '    ')
 ELSE 'function part() {{' || chr(10) || '    ' || replace(code, chr(10), chr(10) || '    ') || chr(10) || '}}' END AS as_function, CASE ext WHEN 'rs' THEN 'let part = ' || code || ';' WHEN 'py' THEN 'part = ' || code ELSE 'const part = ' || code || ';' END AS as_variable,
 CASE ext WHEN 'rs' THEN 'const PART: _ = ' || code || ';' WHEN 'py' THEN 'PART = ' || code ELSE 'const PART = ' || code || ';' END AS as_constant FROM e""")
def extract_code(spark, sf):
    f = _files(spark, sf).select("file_id", tx.extension(F.col("path")).alias("ext"), F.array_join(F.slice(tx.lines(F.col("content")), 2, 2), "\n").alias("code"))
    return f.select("file_id", *[code.extracted(F.col("code"), "part", F.col("ext"), form).alias(f"as_{form}") for form in ("function", "variable", "constant")])


@query("inline_definition", "SC37", f"""WITH {LINE_CTE}, v AS (SELECT file_id, i, t, CASE WHEN contains(t, '=') AND (starts_with(t, 'let ') OR starts_with(t, 'const ')) AND contains(string_split(t, '=')[1], 'total') THEN rtrim(trim(substr(t, instr(t, '=') + 1)), ';')
 WHEN contains(t, '=') AND trim(string_split(t, '=')[1]) = 'total' THEN trim(substr(t, instr(t, '=') + 1)) END AS val FROM tl), f AS (SELECT file_id, arg_min(val, i) AS val FROM v WHERE val IS NOT NULL GROUP BY 1)
SELECT file_id, val AS definition, md5(regexp_replace(regexp_replace(content, '(^|[^A-Za-z0-9_])total($|[^A-Za-z0-9_])', '\\1' || val || '\\2', 'g'), '(^|[^A-Za-z0-9_])total($|[^A-Za-z0-9_])', '\\1' || val || '\\2', 'g')) AS new_md5 FROM f JOIN ls USING (file_id) WHERE NOT contains(val, 'total')""")
def inline_definition(spark, sf):
    f = worked_out(_files(spark, sf), ["file_id", "content"], code.definition_of(tx.lines(F.col("content")), "total"), "definition").filter(~F.contains("definition", F.lit("total")))
    literal = F.replace(F.replace("definition", F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return f.select("file_id", "definition", F.md5(F.regexp_replace("content", F.lit(tx.unicode_regex(r"\btotal\b")), literal)).alias("new_md5"))


@query("signature_edits", "SC38", f"""WITH {LINE_CTE}, e AS (SELECT file_id, language, i, line, CASE WHEN contains(line, 'fn size') OR contains(line, 'def size') OR contains(line, 'function size') THEN 'NEW' ELSE line END AS changed,
 CASE WHEN contains(line, 'fn area(') OR contains(line, 'def _weigh(') OR contains(line, 'function weigh_') THEN 1 ELSE 0 END AS hit,
 CASE WHEN (contains(line, 'fn area(') OR contains(line, 'def area(') OR contains(line, 'function area(')) THEN regexp_replace(line, '^([^(]*\\(.*)(\\)[^)]*)$', '\\1, extra: i64\\2') ELSE line END AS added,
 CASE WHEN (contains(line, 'fn _weigh(') OR contains(line, 'def _weigh(') OR contains(line, 'function _weigh(')) AND contains(line, 'self') THEN replace(replace(replace(regexp_replace(line, ',?\\s*self[^,)]*,?', ''), '(,', '('), ',)', ')'), ',,', ',') ELSE line END AS removed FROM ln)
SELECT file_id, md5(string_agg(changed, chr(10) ORDER BY i)) AS changed, md5(string_agg(added, chr(10) ORDER BY i)) AS added, md5(string_agg(removed, chr(10) ORDER BY i)) AS removed FROM e GROUP BY file_id""")
def signature_edits(spark, sf):
    f = _files(spark, sf).select("file_id", tx.lines(F.col("content")).alias("ls"))
    ls = F.col("ls")
    return f.select("file_id", F.md5(code.change_signature(ls, "size", "NEW")).alias("changed"), F.md5(code.add_parameter(ls, "area", F.lit("extra: i64"))).alias("added"),
                    F.md5(code.remove_parameter(ls, "_weigh", "self")).alias("removed"))


@query("python_ast_symbols", "CD8 CD9")
def python_ast_symbols(spark, sf):
    from weftline.operators.pyast import python_symbols

    return python_symbols(_files(spark, sf).filter(F.col("language") == "Python"), "file_id", "content")
