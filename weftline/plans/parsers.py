"""Tool output and manifest queries over derived texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as tx
from weftline.operators import parsers
from weftline.operators.rules import first_match
from weftline.plans.corpus import cte, derived
from weftline.plans.sqltext import cases, q
from weftline.registry import query
from weftline.sources import manifests as mf
from weftline.sources.tables import table


def exploded(name: str, key: str, col: str) -> str:
    """``name`` with one row per line: ``ln(key, i, line)``."""
    return f"{cte(name)}, ln AS (SELECT {key}, unnest(string_split({col}, chr(10))) AS line, generate_subscripts(string_split({col}, chr(10)), 1) AS i FROM {name})"


@query("git_log", "SRC11", f"""WITH {cte("git_log")}, p AS (SELECT row_id, string_split(line, '|') AS p FROM git_log)
SELECT row_id, p[1] AS hash, p[2] AS short_hash, p[3] AS author, p[4] AS email, p[5] AS date, array_to_string(p[6:], '|') AS message FROM p WHERE len(p) >= 6""")
def git_log(spark, sf):
    return parsers.git_log(derived(spark, sf, "git_log"), "row_id", "line")


_CHANGE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CHANGE_TYPES.items()) + " ELSE 'Modified' END"


@query("git_status", "SRC11 CL21 VR17", f"""WITH {cte("git_status")}, c AS (SELECT row_id, substr(line, 1, 1) AS a, substr(line, 2, 1) AS b, substr(line, 1, 2) AS code, substr(line, 4) AS path FROM git_status WHERE strlen(line) >= 3)
SELECT row_id, path, CASE WHEN a NOT IN (' ', '?') THEN {_CHANGE.format('a')} END AS staged, CASE WHEN b NOT IN (' ', '?') THEN {_CHANGE.format('b')} END AS unstaged, a = '?' AS untracked,
 {cases([(f"code = '{k}'", q(t)) for k, (t, _) in fixed.WORKTREE_CODES.items()])} AS worktree_type, CAST({cases([(f"code = '{k}'", str(p)) for k, (_, p) in fixed.WORKTREE_CODES.items()])} AS DOUBLE) AS priority FROM c""")
def git_status(spark, sf):
    return parsers.git_status(derived(spark, sf, "git_status"), "row_id", "line")


@query("change_counts", "AG17 ST4", f"""WITH {cte("git_status")}, c AS (SELECT row_id, {cases([(f"substr(line, 1, 2) = '{k}'", q(t)) for k, (t, _) in fixed.WORKTREE_CODES.items()])} AS kind, substr(line, 4) AS path FROM git_status),
r AS (SELECT kind, path, row_id, row_number() OVER (PARTITION BY kind ORDER BY row_id) AS rn, count(*) OVER (PARTITION BY kind) AS n FROM c WHERE kind IS NOT NULL)
SELECT kind, max(n) AS files, string_agg(path, ', ' ORDER BY row_id) || CASE WHEN max(n) > 5 THEN ' +' || (max(n) - 5) ELSE '' END AS shown FROM r WHERE rn <= 5 GROUP BY kind""")
def change_counts(spark, sf):
    """Counts per kind with the first five paths; only those five travel to the final group."""
    from weftline.operators.relational import last_n

    c = parsers.git_status(derived(spark, sf, "git_status"), "row_id", "line").filter(F.col("worktree_type").isNotNull()).select(F.col("worktree_type").alias("kind"), "row_id", "path")
    counts = c.groupBy("kind").agg(F.count("*").alias("files"))
    first = last_n(c, ["kind"], F.col("row_id"), 5).groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("row_id", "path"))).alias("p"))
    shown = F.array_join(F.transform("p", lambda x: x["path"]), ", ")
    more = F.when(F.col("files") > 5, F.concat(F.lit(" +"), (F.col("files") - 5).cast("string"))).otherwise("")
    return counts.join(first, "kind").select("kind", "files", F.concat(shown, more).alias("shown"))


@query("git_branches", "SRC11", f"""WITH {exploded("git_branches", "row_id", "output")}, w AS (SELECT row_id, line, list_filter(string_split(regexp_replace(line, '^[* ]+', ''), ' '), lambda x: x <> '') AS w FROM ln)
SELECT row_id, w[1] AS name, starts_with(line, '*') AS is_current, starts_with(w[1], 'remotes/') AS is_remote, w[2] AS last_commit FROM w WHERE len(w) > 0""")
def git_branches(spark, sf):
    return parsers.git_branches(derived(spark, sf, "git_branches"), "row_id", "output")


_DIFF_CTE = f"""{exploded("git_diffs", "diff_id", "output")},
f AS (SELECT *, sum(CASE WHEN starts_with(line, 'diff --git') THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY i) AS file_no, sum(CASE WHEN starts_with(line, '@@') THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY i) AS all_hunks FROM ln),
h AS (SELECT *, all_hunks - min(all_hunks) OVER (PARTITION BY diff_id, file_no) AS hunk_no, first_value(line) OVER (PARTITION BY diff_id, file_no ORDER BY i) AS head FROM f WHERE file_no > 0),
g AS (SELECT diff_id, file_no, hunk_no, any_value(regexp_extract(head, ' b/(\\S+)$', 1)) AS path, max(CASE WHEN starts_with(line, '@@') THEN line END) AS hh, count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++')) AS additions,
 count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '---')) AS deletions, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT starts_with(line, '@@')), '') AS content FROM h WHERE hunk_no > 0 GROUP BY 1, 2, 3)"""


@query("git_diff_hunks", "SRC11 SC31 WN8", f"""WITH {_DIFF_CTE} SELECT diff_id, path, CAST(hunk_no AS INTEGER) AS hunk_no, CAST(regexp_extract(hh, '-(\\d+)', 1) AS INTEGER) AS old_start, coalesce(TRY_CAST(nullif(regexp_extract(hh, '-\\d+,(\\d+)', 1), '') AS INTEGER), 1) AS old_lines,
 CAST(regexp_extract(hh, '\\+(\\d+)', 1) AS INTEGER) AS new_start, coalesce(TRY_CAST(nullif(regexp_extract(hh, '\\+\\d+,(\\d+)', 1), '') AS INTEGER), 1) AS new_lines, CAST(additions AS INTEGER) AS additions, CAST(deletions AS INTEGER) AS deletions, content FROM g""")
def git_diff_hunks(spark, sf):
    return parsers.git_diff_hunks(derived(spark, sf, "git_diffs"), "diff_id", "output")


@query("git_diff_totals", "AG16", f"""WITH {_DIFF_CTE} SELECT CASE WHEN grouping(path) = 1 THEN '(total)' ELSE path END AS path, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions FROM g GROUP BY ROLLUP (path)""")
def git_diff_totals(spark, sf):
    h = parsers.git_diff_hunks(derived(spark, sf, "git_diffs"), "diff_id", "output")
    return h.rollup("path").agg(F.grouping("path").alias("whole"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")).withColumn("path", F.when(F.col("whole") == 1, "(total)").otherwise(F.col("path"))).drop("whole")


@query("git_blame", "SRC11 WN8", f"""WITH {exploded("git_blames", "blame_id", "output")}, m AS (SELECT *, CASE WHEN regexp_matches(line, '^[0-9a-f]{{40}}$') THEN substr(line, 1, 8) END AS c, CASE WHEN starts_with(line, 'author ') THEN substr(line, 8) END AS a,
 CASE WHEN starts_with(line, 'author-time ') THEN substr(line, 13) END AS d FROM ln), w AS (SELECT *, last_value(c IGNORE NULLS) OVER z AS commit, coalesce(last_value(a IGNORE NULLS) OVER z, '') AS author, last_value(d IGNORE NULLS) OVER z AS date FROM m WINDOW z AS (PARTITION BY blame_id ORDER BY i))
SELECT blame_id, CAST(row_number() OVER (PARTITION BY blame_id ORDER BY i) AS INTEGER) AS line_number, commit, author, date, substr(line, 2) AS content FROM w WHERE starts_with(line, chr(9))""")
def git_blame(spark, sf):
    return parsers.git_blame(derived(spark, sf, "git_blames"), "blame_id", "output")


@query("recent_files", "ST2 ST3 ST5", f"""WITH {cte("file_paths")} SELECT DISTINCT path FROM (SELECT path FROM file_paths WHERE file_id % 2 = 0 UNION ALL SELECT path FROM file_paths WHERE file_id % 3 = 0)""")
def recent_files(spark, sf):
    f = derived(spark, sf, "file_paths")
    return f.filter("file_id % 2 = 0").select("path").unionByName(f.filter("file_id % 3 = 0").select("path")).distinct()


_CASES_CTE = f"""{cte("test_runs")}, ln AS (SELECT run_id, framework, unnest(string_split(output, chr(10))) AS line FROM test_runs),
cs AS (SELECT run_id, framework, CASE framework WHEN 'cargo' THEN regexp_extract(line, '^test (.*) \\.\\.\\. ', 1) WHEN 'go' THEN string_split(line, ' ')[3] ELSE regexp_extract(line, '^(.*) (PASSED|FAILED|SKIPPED)', 1) END AS name,
 CASE WHEN framework = 'cargo' THEN CASE regexp_extract(line, ' \\.\\.\\. (\\w+)$', 1) WHEN 'ok' THEN 'Passed' WHEN 'FAILED' THEN 'Failed' WHEN 'ignored' THEN 'Skipped' END
 WHEN framework = 'go' THEN CASE WHEN starts_with(line, '--- PASS:') THEN 'Passed' WHEN starts_with(line, '--- FAIL:') THEN 'Failed' END
 WHEN framework = 'pytest' THEN CASE WHEN contains(line, 'PASSED') THEN 'Passed' WHEN contains(line, 'FAILED') THEN 'Failed' WHEN contains(line, 'SKIPPED') THEN 'Skipped' END END AS status FROM ln)"""


@query("test_cases", "CD16", f"WITH {_CASES_CTE} SELECT run_id, framework, name, status FROM cs WHERE status IS NOT NULL")
def test_cases(spark, sf):
    return parsers.test_cases(derived(spark, sf, "test_runs"), "run_id", "framework", "output")


@query("test_totals", "CD16 AG18", f"""WITH {_CASES_CTE}, a AS (SELECT run_id, framework, count(*) FILTER (status <> 'Skipped' OR framework <> 'pytest') AS total, count(*) FILTER (status = 'Passed') AS passed, count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (status = 'Skipped') AS skipped
 FROM cs WHERE status IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT run_id, framework, CAST(json_extract(output, '$.numPassedTests') AS BIGINT) + CAST(json_extract(output, '$.numFailedTests') AS BIGINT), CAST(json_extract(output, '$.numPassedTests') AS BIGINT), CAST(json_extract(output, '$.numFailedTests') AS BIGINT), 0 FROM test_runs WHERE framework = 'jest')
SELECT *, failed = 0 AS success FROM a""")
def test_totals(spark, sf):
    return parsers.test_summary(derived(spark, sf, "test_runs"), "run_id", "framework", "output")


@query("diagnostics", "CD16", f"""WITH {exploded("compiler_runs", "run_id", "output")}, d AS (SELECT run_id, line, CASE WHEN contains(lower(line), 'error') AND NOT contains(lower(line), 'aborting') THEN 'error' WHEN contains(lower(line), 'warning:') THEN 'warning' END AS level, string_split(string_split(line, ': ')[1], ':') AS p, contains(line, ': ') AS s FROM ln)
SELECT run_id, level, CASE WHEN s THEN trim(substr(line, instr(line, ': ') + 2)) ELSE line END AS message, CASE WHEN s AND len(p) >= 2 THEN p[1] END AS file, CASE WHEN s AND len(p) >= 2 THEN TRY_CAST(p[2] AS INTEGER) END AS line, CASE WHEN s AND len(p) >= 3 THEN TRY_CAST(p[3] AS INTEGER) END AS "column" FROM d WHERE level IS NOT NULL""")
def diagnostics(spark, sf):
    return parsers.diagnostics(derived(spark, sf, "compiler_runs"), "run_id", "output")


_REQ_NAME = cases([(f"contains(t, '{o}')", f"trim(string_split(t, '{o}')[1])") for o in fixed.REQUIREMENT_OPERATORS], "t")
_REQ_VERSION = cases([(f"contains(t, '{o}')", f"substr(t, instr(t, '{o}'))") for o in fixed.REQUIREMENT_OPERATORS], "'*'")


@query("requirements", "SRC8 SC30", f"""WITH {exploded("requirements", "project_id", "content")}, r AS (SELECT project_id, trim(line) AS t FROM ln WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#'))
SELECT project_id, {_REQ_NAME} AS name, {_REQ_VERSION} AS version FROM r""")
def requirements(spark, sf):
    return mf.requirements(derived(spark, sf, "requirements"), "project_id", "content")


@query("go_requires", "SRC8", f"""WITH {exploded("go_mods", "project_id", "content")}, m AS (SELECT *, trim(line, ' ' || chr(9)) AS t FROM ln), b AS (SELECT *, coalesce(last_value(CASE WHEN starts_with(t, 'require (') THEN 1 WHEN t = ')' THEN 0 END IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY i), 0) AS inside FROM m),
w AS (SELECT project_id, string_split(replace(t, 'require ', ''), ' ') AS w FROM b WHERE NOT starts_with(t, 'require (') AND t <> ')' AND (inside = 1 OR starts_with(t, 'require '))) SELECT project_id, w[1] AS name, w[2] AS version FROM w WHERE len(w) >= 2""")
def go_requires(spark, sf):
    return mf.go_requires(derived(spark, sf, "go_mods"), "project_id", "content")


@query("package_dependencies", "SRC8 CD18", f"""WITH {cte("package_jsons")}, v AS (SELECT project_id, CAST(content AS JSON) AS j FROM package_jsons WHERE json_valid(content)),
k AS (SELECT project_id, j, 'dependencies' AS part, unnest(json_keys(j, '$.dependencies')) AS name FROM v UNION ALL SELECT project_id, j, 'devDependencies', unnest(json_keys(j, '$.devDependencies')) FROM v)
SELECT project_id, name, json_extract_string(j, '$.' || part || '.' || name) AS version, part = 'devDependencies' AS is_dev FROM k""")
def package_dependencies(spark, sf):
    return mf.package_dependencies(derived(spark, sf, "package_jsons"), "project_id", "content")


@query("cargo_dependencies", "SRC8 CD18", f"""WITH {exploded("cargo_tomls", "project_id", "content")}, s AS (SELECT *, last_value(CASE WHEN starts_with(line, '[') THEN line END IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY i) AS section FROM ln)
SELECT project_id, regexp_extract(line, '^(\\S+) = ', 1) AS name, CASE WHEN contains(line, '{{') THEN coalesce(nullif(regexp_extract(line, 'version = "([^"]*)"', 1), ''), '*') ELSE regexp_extract(line, '"(.*)"', 1) END AS version, section = '[dev-dependencies]' AS is_dev, contains(line, 'optional = true') AS is_optional,
 replace(replace(regexp_extract(line, 'features = \\[(.*)\\]', 1), '"', ''), ' ', '') AS features, CASE WHEN contains(line, 'git = ') THEN 'Git' WHEN contains(line, 'path = ') THEN 'Path' ELSE 'Registry' END AS source,
 CASE WHEN contains(line, 'git = ') THEN regexp_extract(line, 'git = "([^"]*)"', 1) WHEN contains(line, 'path = ') THEN regexp_extract(line, 'path = "([^"]*)"', 1) ELSE 'crates.io' END AS location
FROM s WHERE section IN ('[dependencies]', '[dev-dependencies]') AND contains(line, ' = ')""")
def cargo_dependencies(spark, sf):
    return mf.cargo_dependencies(derived(spark, sf, "cargo_tomls"), "project_id", "content")


def _fw_sql(col: str, checks: dict[str, str]) -> str:
    parts = ", ".join(f"CASE WHEN contains({col}, {q(k)}) THEN {q(v)} END" for k, v in checks.items())
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',')"


@query("frameworks", "CD20 CD17", f"""WITH {cte("cargo_tomls", "package_jsons", "requirements")}
SELECT 'rust' AS kind, project_id, {_fw_sql("content", fixed.RUST_FRAMEWORKS)} AS frameworks, CASE WHEN contains(content, '[[bin]]') THEN CASE WHEN contains(content, 'clap') THEN 'Cli' ELSE 'Binary' END WHEN contains(content, '[lib]') THEN 'Library' ELSE 'Unknown' END AS project_type FROM cargo_tomls
UNION ALL SELECT 'script', project_id, {_fw_sql("content", fixed.SCRIPT_FRAMEWORKS)}, CASE WHEN regexp_matches(content, 'next|nuxt|react') THEN 'WebApp' WHEN regexp_matches(content, 'express|fastify|koa') THEN 'Api' ELSE 'Unknown' END FROM package_jsons
UNION ALL SELECT 'python', project_id, {_fw_sql("lower(content)", fixed.PYTHON_FRAMEWORKS)}, 'Unknown' FROM requirements""")
def frameworks(spark, sf):
    c = F.col("content")
    rust = derived(spark, sf, "cargo_tomls").select(F.lit("rust").alias("kind"), "project_id", F.array_join(mf.frameworks(c, fixed.RUST_FRAMEWORKS), ",").alias("frameworks"), mf.rust_project_type(c).alias("project_type"))
    script = derived(spark, sf, "package_jsons").select(F.lit("script").alias("kind"), "project_id", F.array_join(mf.frameworks(c, fixed.SCRIPT_FRAMEWORKS), ",").alias("frameworks"), mf.script_project_type(c).alias("project_type"))
    python = derived(spark, sf, "requirements").select(F.lit("python").alias("kind"), "project_id", F.array_join(mf.frameworks(c, fixed.PYTHON_FRAMEWORKS, True), ",").alias("frameworks"), F.lit("Unknown").alias("project_type"))
    return rust.unionByName(script).unionByName(python)


@query("important_files", "CD20 CX6", f"""WITH {cte("file_paths")} SELECT file_id, path, {cases([(f"path = {q(p)}", q(t)) for p, (t, _) in fixed.IMPORTANT_FILES.items()])} AS file_type, {cases([(f"path = {q(p)}", q(d)) for p, (_, d) in fixed.IMPORTANT_FILES.items()])} AS description,
 CASE path WHEN 'Cargo.toml' THEN 'cargo' WHEN 'package.json' THEN 'jest' WHEN 'setup.py' THEN 'pytest' WHEN 'go.mod' THEN 'go' END AS test_framework FROM file_paths WHERE path IN ({", ".join(q(p) for p in fixed.IMPORTANT_FILES)}, 'setup.py')""")
def important_files(spark, sf):
    path = F.col("path")
    markers = {"Cargo.toml": "cargo", "package.json": "jest", "setup.py": "pytest", "go.mod": "go"}
    f = derived(spark, sf, "file_paths").filter(path.isin(*fixed.IMPORTANT_FILES, "setup.py"))
    return f.select("file_id", "path", first_match([(path == p, t) for p, (t, _) in fixed.IMPORTANT_FILES.items()]).alias("file_type"),
                    first_match([(path == p, d) for p, (_, d) in fixed.IMPORTANT_FILES.items()]).alias("description"), first_match([(path == p, t) for p, t in markers.items()]).alias("test_framework"))


@query("http_responses", "SRC10 SC24", f"""WITH {cte("responses")}, r AS (SELECT page_id, url, body, json_valid(body) AS ok FROM responses) SELECT page_id, url, strlen(body) AS body_bytes, ok AS is_json,
 CASE WHEN ok AND starts_with(body, '{{') THEN json_extract_string(body, '$.page') END AS json_page, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, contains(url, '#') OR contains(url, '?') AS has_suffix FROM r""")
def http_responses(spark, sf):
    parsed = F.try_parse_json("body")
    r = derived(spark, sf, "responses")
    return r.select("page_id", "url", F.octet_length("body").cast("bigint").alias("body_bytes"), parsed.isNotNull().alias("is_json"), F.get_json_object("body", "$.page").alias("json_page"),
                    F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), (F.contains("url", F.lit("#")) | F.contains("url", F.lit("?"))).alias("has_suffix"))


@query("pretty_json", "SC39", """SELECT event_id, '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS pretty, true AS changed FROM events""")
def pretty_json(spark, sf):
    from weftline.functions.documents import pretty

    return table(spark, sf, "events").select("event_id", pretty(F.col("props"), 2).alias("pretty"), (pretty(F.col("props"), 2) != F.col("props")).alias("changed"))


@query("calculated", "SC22", """WITH e AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_linenumber AS b, l_suppkey AS c FROM lineitem)
, v AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN a * b + c WHEN 1 THEN (a - c) / b WHEN 2 THEN pow(b, 3) + abs(-c) ELSE sqrt(c) + floor(a / 7) END AS v FROM e)
SELECT l_orderkey, l_linenumber, CASE WHEN v = floor(v) AND abs(v) < 10000000000 THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.6f', v), '0'), '.') END AS result FROM v""")
def calculated(spark, sf):
    from weftline.functions.documents import calculate

    text = F.expr("CASE l_orderkey % 4 WHEN 0 THEN CAST(l_quantity AS STRING) || '*' || l_linenumber || '+' || l_suppkey WHEN 1 THEN '(' || CAST(l_quantity AS STRING) || '-' || l_suppkey || ')/' || l_linenumber "
                  "WHEN 2 THEN l_linenumber || '^3+abs(-' || l_suppkey || ')' ELSE 'sqrt(' || l_suppkey || ')+floor(' || CAST(l_quantity AS STRING) || '/7)' END")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", calculate(text).alias("result"))
