"""Project summaries, related files, context assembly, files and sessions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as tx
from weftline.operators import history, project, relational, retrieval, rules, search
from weftline.operators.chunking import line_chunks
from weftline.operators.ordered import time_bucket
from weftline.operators.rules import first_match
from weftline.plans.code import SYMBOL_CTE, lines_sql
from weftline.plans.corpus import cte, derived
from weftline.plans.rules import WS
from weftline.plans.sqltext import cases, q
from weftline.plans.text import LINES
from weftline.plans.vectors import SIMS
from weftline.registry import query
from weftline.session import scratch_path, shared_dir
from weftline.sources import files as fs
from weftline.sources.tables import spread, table

_PROJECT = r"^(.*)/[^/]*$"
_COUNTS_CTE = f"""{SYMBOL_CTE}, pf AS (SELECT s.file_id, regexp_extract(s.path, '{_PROJECT}', 1) AS project, s.language, len(ls.ls) AS lines, strlen(s.content) AS bytes FROM src_files s JOIN ls ON ls.file_id = s.file_id),
sc AS (SELECT file_id, count(*) AS n, sum(complexity) AS complexity, count(*) FILTER (visibility = 'Public') AS public, count(*) FILTER (complexity > 10) AS complex, count(*) FILTER (complexity > 15) AS very_complex,
 count(*) FILTER (starts_with(trim(above), '///')) AS documented, count(*) FILTER (visibility = 'Public' AND NOT starts_with(trim(above), '///')) AS undocumented, count(*) FILTER (trim(above) = '#[test]') AS tests, count(*) FILTER (contains(t, 'async ')) AS asyncs,
 count(*) FILTER (kind = 'Function') AS functions FROM sym GROUP BY file_id),
pl AS (SELECT project, language, sum(lines) AS language_lines FROM pf JOIN sc USING (file_id) GROUP BY 1, 2), pk AS (SELECT pf.*, language_lines, (-language_lines, language) AS main_key FROM pf JOIN pl USING (project, language)),
pc AS (SELECT project, count(*) AS files, count(*) FILTER (bytes > 10000) AS large, arg_min(language, main_key) AS language, max(language_lines) AS main_lines, sum(lines) AS lines, sum(n) AS n, sum(complexity) AS complexity, sum(public) AS public, sum(complex) AS complex, sum(very_complex) AS very_complex, sum(documented) AS documented,
 sum(undocumented) AS undocumented, sum(tests) AS tests, sum(asyncs) AS asyncs, sum(functions) AS functions FROM pk JOIN sc USING (file_id) GROUP BY project),
pm AS (SELECT *, least(greatest((CAST(complexity AS DOUBLE) / n - 1.0) * 10.0, 0.0), 100.0) AS score FROM pc), pr AS (SELECT *, greatest(100.0 - least(lines / 1000, 30.0) - score / 2.0, 0.0) AS maintainability FROM pm)"""


def _counts(spark, sf):
    return project.project_metrics(project.project_counts(derived(spark, sf, "src_files"), F.regexp_extract("path", _PROJECT, 1)))


@query("project_metrics", "AG4 AG5 AG6 AG7 AG8", f"""WITH {_COUNTS_CTE} SELECT project, files, CAST(lines AS BIGINT) AS lines, CAST(n AS BIGINT) AS symbols, round(score, 6) AS complexity_score, round(maintainability, 6) AS maintainability,
 round(documented * 100.0 / n, 6) AS doc_coverage, round(tests * 100.0 / functions, 6) AS test_coverage FROM pr""")
def project_metrics(spark, sf):
    return _counts(spark, sf).select("project", "files", "lines", F.col("n").alias("symbols"), F.round("complexity_score", 6).alias("complexity_score"), F.round("maintainability", 6).alias("maintainability"),
                                     F.round("doc_coverage", 6).alias("doc_coverage"), F.round("test_coverage", 6).alias("test_coverage"))


@query("project_insights", "CD19 AG5 CX1", f"""WITH {_COUNTS_CTE} SELECT project, CAST(main_lines * 100 // lines AS BIGINT) || '% del código está en ' || language || '|' || CASE WHEN complex > 0 THEN complex || ' funciones con complejidad alta detectadas' ELSE 'Complejidad general del código es manejable' END || '|' || CAST(documented * 100 // n AS BIGINT) || '% de símbolos documentados'
 || CASE WHEN tests > 0 THEN '|' || tests || ' tests detectados' ELSE '' END || CASE WHEN asyncs > 0 THEN '|' || asyncs || ' funciones asíncronas (uso de async/await)' ELSE '' END || '|' || CASE WHEN maintainability >= 70 THEN 'Índice de mantenibilidad: Alto (código fácil de mantener)'
 WHEN maintainability >= 50 THEN 'Índice de mantenibilidad: Medio' ELSE 'Índice de mantenibilidad: Bajo (considerar refactoring)' END AS insights,
 coalesce(nullif(concat_ws('|', CASE WHEN undocumented > 0 THEN 'Agregar documentación a ' || undocumented || ' símbolos públicos sin documentar' END, CASE WHEN very_complex > 0 THEN 'Refactorizar ' || very_complex || ' funciones con complejidad muy alta (>15)' END,
 CASE WHEN large > 5 THEN 'Considerar dividir ' || large || ' archivos grandes (>10KB)' END, CASE WHEN maintainability < 50 THEN 'Mejorar índice de mantenibilidad mediante refactoring' END), ''), 'El proyecto está en buen estado general') AS recommendations FROM pr""")
def project_insights(spark, sf):
    return _counts(spark, sf).select("project", F.array_join(project.insights(), "|").alias("insights"), F.array_join(project.recommendations(), "|").alias("recommendations"))


_STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '')"


@query("related_files", "JN11 VR18 ST5 TK7", f"""WITH {cte("src_files", "side_files")}, src AS (SELECT path, content, {_STEM} AS stem FROM src_files WHERE ends_with(path, '.rs')), known AS (SELECT path FROM src_files UNION SELECT path FROM side_files),
m AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, 'use\\s+(crate::[a-zA-Z0-9_:]+)', 1)) AS module FROM src), b AS (SELECT path, 'src/' || replace(substr(module, 8), '::', '/') AS base FROM m),
i AS (SELECT b.path, CASE WHEN base || '.rs' IN (SELECT path FROM known) THEN base || '.rs' WHEN base || '/mod.rs' IN (SELECT path FROM known) THEN base || '/mod.rs' END AS related FROM b),
t AS (SELECT path AS related, regexp_extract(path, '([^/]*)$', 1) AS name FROM known WHERE starts_with(path, 'tests/'))
SELECT path, related, 'import' AS relation, CAST(0.8 AS DOUBLE) AS confidence FROM i WHERE related IS NOT NULL
UNION ALL SELECT path, related, 'test', 0.85 FROM src JOIN t ON contains(name, stem) OR contains(stem || '_test.rs', name) OR contains('test_' || stem || '.rs', name) OR contains(stem || '_tests.rs', name) OR contains('tests/' || stem || '.rs', name)
UNION ALL SELECT s.path, k.path, 'documentation', 0.7 FROM src s JOIN known k ON k.path = regexp_extract(s.path, '{_PROJECT}', 1) || '/README.md'
UNION ALL SELECT s.path, 'Cargo.toml', 'dependency', 0.6 FROM src s WHERE 'Cargo.toml' IN (SELECT path FROM known)""")
def related_files(spark, sf):
    return project.related_files(derived(spark, sf, "src_files"), derived(spark, sf, "side_files"))


@query("priority_boost", "VR17 CL21", f"""WITH {cte("src_files", "changes")}, c AS (SELECT path, {cases([(f"line = '{k}'", str(p)) for k, (_, p) in fixed.WORKTREE_CODES.items()])} AS priority, nth FROM changes)
SELECT s.file_id, round(CAST(CASE WHEN c.priority IS NOT NULL THEN c.priority * 0.3 WHEN c.nth % 5 = 0 THEN 0.15 ELSE 0.0 END AS DOUBLE), 6) AS boost FROM src_files s LEFT JOIN c ON c.path = s.path""")
def priority_boost(spark, sf):
    """Uncommitted changes weigh 0.3 times their priority, recently touched files 0.15."""
    c = derived(spark, sf, "changes")
    priority = first_match([(F.col("line") == k, p) for k, (_, p) in fixed.WORKTREE_CODES.items()])
    c = c.select("path", priority.alias("priority"), (F.col("nth") % 5 == 0).alias("recent"))
    boost = F.when(F.col("priority").isNotNull(), F.col("priority") * 0.3).when(F.col("recent"), 0.15).otherwise(0.0)
    return derived(spark, sf, "src_files").select("file_id", "path").join(c, "path", "left").select("file_id", F.round(boost, 6).alias("boost"))


@query("token_budget", "VR19 SC14", """WITH s AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 2 WHEN 'assistant' THEN 1 ELSE 0 END AS rank, greatest(strlen(text) // 4, 1) AS tokens FROM conversations),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS total, coalesce(sum(CASE WHEN rank < 2 THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY rank, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT conv_id, turn, CAST(rank AS INTEGER) AS rank, tokens FROM r WHERE NOT (rank < 2 AND total - before > 150)""")
def token_budget(spark, sf):
    """Conversations cut to 150 tokens: user turns go first, then assistant turns, system turns stay."""
    rank = F.when(F.col("role") == "system", 2).when(F.col("role") == "assistant", 1).otherwise(0)
    s = table(spark, sf, "conversations").select("conv_id", "turn", rank.alias("rank"), tx.token_estimate(F.col("text")).alias("tokens"))
    return project.fit_budget(s, "conv_id", "turn", "rank", "tokens", 150)


@query("planning_context", "VR15 CX9 SC5", f"""WITH {SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rn FROM sims), t AS (SELECT r.query_id, string_agg('• ' || substr(d.text, 1, 800) || chr(10), '' ORDER BY rn) AS body FROM r JOIN documents d ON d.doc_id = r.vec_id WHERE rn <= 12 GROUP BY 1),
c AS (SELECT query_id, 'Fragmentos de código relevantes:' || chr(10) || body AS ctx FROM t), f AS (SELECT string_agg(substr(text, 1, 1200), chr(10) || '---' || chr(10) ORDER BY doc_id) AS extra FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 5))
SELECT query_id, CASE WHEN length(ctx) < 1000 THEN ctx || chr(10) || 'Contexto adicional del proyecto:' || chr(10) || extra ELSE ctx END AS context FROM c, f""")
def planning_context(spark, sf):
    """Twelve best chunks of at most 800 characters per query, with a fallback of five chunks when that is little."""
    emb, docs = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    asked = retrieval.query_vectors(emb, "vec_id", "embedding", [0, 1, 2, 3, 4])
    hits = retrieval.top_k(emb, "vec_id", "embedding", asked, 12).select("query_id", "rank", F.col("vec_id").alias("doc_id"))
    found = docs.select("doc_id", F.substring("text", 1, 800).alias("text")).join(F.broadcast(hits), "doc_id")
    listed = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.concat(F.lit("• "), x["text"], F.lit("\n"))), "")
    first = docs.select("doc_id", F.substring("text", 1, 1200).alias("text")).orderBy("doc_id").limit(5)
    extra = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n---\n")).scalar()
    c = listed.select("query_id", F.concat(F.lit("Fragmentos de código relevantes:\n"), body).alias("ctx")).withColumn("extra", extra)
    more = F.concat("ctx", F.lit("\nContexto adicional del proyecto:\n"), "extra")
    return c.select("query_id", F.when(F.length("ctx") < 1000, more).otherwise(F.col("ctx")).alias("context"))


@query("collected_context", "CX16 TK8 WN1 SC6", f"""WITH l AS (SELECT doc_id, {LINES} AS ls FROM documents), r AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l), m AS (SELECT doc_id, ls, i FROM r WHERE contains(ls[i], 'of that ') ORDER BY doc_id, i LIMIT 50),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS hit, dense_rank() OVER (ORDER BY doc_id) AS nth FROM m),
s AS (SELECT doc_id, string_agg(array_to_string(list_transform(ls[greatest(i - 3, 1):i - 1], lambda x: '  ' || x || chr(10)), '') || '  ' || i || ': ' || ls[i] || chr(10) || array_to_string(list_transform(ls[i + 1:i + 3], lambda x: '  ' || x || chr(10)), '') || chr(10), '' ORDER BY i) AS body FROM n WHERE hit <= 3 AND nth <= 6 GROUP BY 1)
SELECT doc_id, 'Archivo: ' || doc_id || chr(10) || body || '---' AS snippet FROM s""")
def collected_context(spark, sf):
    """Literal search: first 50 matches, at most six documents with three matches each, three context lines."""
    hits = search.grep(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", search.search_pattern("of that "), context=3)
    first = hits.orderBy("doc_id", "line_number").limit(50)
    kept = (first.withColumn("hit", F.row_number().over(W.partitionBy("doc_id").orderBy("line_number"))).withColumn("nth", F.dense_rank().over(W.orderBy("doc_id")))
            .filter("hit <= 3 AND nth <= 6"))

    def indented(c):
        return F.when(F.length(c) > 0, F.concat(F.regexp_replace(c, "(?m)^", "  "), F.lit("\n"))).otherwise("")

    shown = F.concat(indented(F.col("context_before")), F.lit("  "), F.col("line_number").cast("string"), F.lit(": "), F.col("line"), F.lit("\n"), indented(F.col("context_after")), F.lit("\n"))
    g = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_number", shown.alias("s")))), lambda x: x["s"]), "").alias("body"))
    return g.select("doc_id", F.concat(F.lit("Archivo: "), F.col("doc_id").cast("string"), F.lit("\n"), "body", F.lit("---")).alias("snippet"))


@query("largest_files", "TK8 TK6 CX16", f"""SELECT doc_id, strlen(text) AS size, array_to_string(({LINES})[1:200], chr(10)) AS head FROM documents ORDER BY strlen(text) DESC, doc_id LIMIT 8""")
def largest_files(spark, sf):
    """Eight largest documents, found by size first and read only then."""
    d = table(spark, sf, "documents")
    top = d.select("doc_id", F.octet_length("text").cast("bigint").alias("size")).orderBy(F.desc("size"), "doc_id").limit(8)
    return d.join(F.broadcast(top), "doc_id").select("doc_id", "size", F.array_join(F.slice(tx.lines(F.col("text")), 1, 200), "\n").alias("head"))


@query("group_summary", "VR16 SC5", """WITH g AS (SELECT conv_id, count(*) AS n, arg_min(text, turn) AS a, arg_max(text, turn) AS b, substr(string_agg(substr(string_split(text, chr(10))[1], 1, 100), ' | ' ORDER BY turn, text), 1, 300) AS heads FROM conversations GROUP BY 1)
SELECT conv_id, n, CASE WHEN n = 1 THEN substr(string_split(a, chr(10))[1], 1, 100) WHEN n = 2 THEN substr(string_split(a, chr(10))[1], 1, 100) || ' | ' || substr(string_split(b, chr(10))[1], 1, 100) ELSE heads END AS summary FROM g""")
def group_summary(spark, sf):
    """First lines joined: of one or two texts whole, of more cut at 300 characters, which stands in for a model's answer."""
    head = F.substring(F.substring_index("text", "\n", 1), 1, 100)
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", head.alias("head"))
    sizes = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    # A separator has three characters, so 300 characters hold the heads of 102 texts at most.
    first = c.withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "text"))).filter("k <= 102")
    heads = first.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "head"))), lambda x: x["head"]), " | ").alias("heads"))
    return sizes.join(heads, "conv_id").select("conv_id", "n", F.when(F.col("n") <= 2, F.col("heads")).otherwise(F.substring("heads", 1, 300)).alias("summary"))


@query("plan_markdown", "CX4 SC32", f"""WITH {cte("task_plans")}, l AS (SELECT plan_id, unnest(string_split(analysis, chr(10))) AS line, generate_subscripts(string_split(analysis, chr(10)), 1) AS i FROM task_plans),
d AS (SELECT plan_id, i, trim(regexp_replace(trim(line), '^[0-9.\\-* :]+', '')) AS d FROM l WHERE regexp_matches(trim(line), '^([0-9]|-|\\*|Task|Step)')), n AS (SELECT plan_id, d, row_number() OVER (PARTITION BY plan_id ORDER BY i) AS k FROM d WHERE strlen(d) > 5),
a AS (SELECT plan_id, k, d FROM n UNION ALL SELECT plan_id, 1, analysis FROM task_plans WHERE plan_id NOT IN (SELECT plan_id FROM n))
SELECT plan_id, '# Plan: ' || plan_id || chr(10) || chr(10) || '## Tasks:' || chr(10) || string_agg(k || '. ' || d, chr(10) ORDER BY k) AS markdown FROM a GROUP BY plan_id""")
def plan_markdown(spark, sf):
    t = rules.plan_tasks(derived(spark, sf, "task_plans"), "plan_id", "analysis")
    g = t.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("task_no", "description"))).alias("l"))
    lines = F.array_join(F.transform("l", lambda x: F.concat(x["task_no"].cast("string"), F.lit(". "), x["description"])), "\n")
    return g.select("plan_id", F.concat(F.lit("# Plan: "), F.col("plan_id").cast("string"), F.lit("\n\n## Tasks:\n"), lines).alias("markdown"))


@query("localised_labels", "SC35", """SELECT doc_id, CASE WHEN starts_with(lower(lang), 'es') THEN 'Buscar' ELSE 'Search' END AS label FROM documents""")
def localised_labels(spark, sf):
    texts = F.create_map(F.lit("es"), F.lit("Buscar"), F.lit("en"), F.lit("Search"))
    locale = F.when(F.startswith(F.lower("lang"), F.lit("es")), "es").otherwise("en")
    return table(spark, sf, "documents").select("doc_id", texts[locale].alias("label"))


@query("undo_history", "DM12")
def undo_history(spark, sf):
    """Clicks undo, errors redo, everything else pushes; logs keep ten entries."""
    op = F.when(F.col("event_type") == "click", "undo").when(F.col("event_type") == "error", "redo").otherwise("push")
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", op.alias("op"))
    return history.replay(e, "user_id", ["ts", "event_id"], "op", time_bucket(e, ["user_id"], "ts", 10_000)).drop("ts")


@query("reindex_report", "SM5 SM4 CH2", f"""WITH old AS (SELECT doc_id, 100 AS mtime FROM documents WHERE doc_id % 9 <> 0), new AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 200 ELSE 100 END AS mtime FROM documents WHERE doc_id % 7 <> 0),
c AS (SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' ELSE 'modified' END AS change, text FROM new n LEFT JOIN old o USING (doc_id) WHERE o.doc_id IS NULL OR n.mtime > o.mtime)
SELECT change, count(*) AS files, CAST(sum(greatest(1, (len({LINES}) + 19) // 20)) AS BIGINT) AS chunks FROM c GROUP BY 1 UNION ALL SELECT 'deleted', count(*), 0 FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)""")
def reindex_report(spark, sf):
    """Only changed documents are chunked again."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    old = d.filter("doc_id % 9 <> 0").select("doc_id", F.lit(100).alias("mtime"))
    new = d.filter("doc_id % 7 <> 0").select("doc_id", F.expr("CASE WHEN doc_id % 5 = 0 THEN 200 ELSE 100 END").alias("mtime"))
    diff = relational.snapshot_diff(old, new, "doc_id", "mtime")
    chunks = line_chunks(d.join(diff.filter("change <> 'deleted'"), "doc_id", "left_semi"), "doc_id", "text", 20).groupBy("doc_id").agg(F.count("*").alias("n"))
    return diff.join(chunks, "doc_id", "left").groupBy("change").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("chunks"))


@query("index_snapshot", "SNK1 SNK2 FLT10", "SELECT lang, count(*) AS files FROM documents GROUP BY lang")
def index_snapshot(spark, sf):
    """Saved under a hashed project path in the shared folder and loaded again."""
    path = fs.save_snapshot({"documents": table(spark, sf, "documents").select("doc_id", "lang")}, scratch_path(spark, "snapshot"), sf)
    return fs.load_snapshot(spark, path, "documents").groupBy("lang").agg(F.count("*").alias("files"))


@query("session_files", "SRC7 SNK5", "SELECT role, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def session_files(spark, sf):
    path = scratch_path(spark, "sessions")
    fs.write_sessions(table(spark, sf, "conversations"), path)
    return fs.read_sessions(spark, path).groupBy("role").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))


@query("data_files", "SRC1 SRC2 SRC5")
def data_files(spark, sf):
    """The table files themselves, listed without reading them."""
    return fs.visible(fs.listing(spark, sf), ["parquet"], max_depth=3).select("path", "name", "size", "depth")
