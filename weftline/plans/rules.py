"""Rule classification over requests, commands, replies and the texts of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as tx
from weftline.operators import rules
from weftline.operators.ordered import running_sum, time_bucket
from weftline.plans.corpus import cte, derived
from weftline.plans.sqltext import any_contains, any_matches, any_starts, cases, in_list, q
from weftline.registry import query
from weftline.sources.tables import spread, table

_WORDS = r"\p{L}\p{M}\p{N}_"
WS = tx.WS
TRIM = rf"'^{WS}+|{WS}+$', '', 'g'"


def re2(pattern: str) -> str:
    """A pattern as RE2 needs it to see Unicode words."""
    return pattern.replace(r"[\w/]", rf"[{_WORDS}/]").replace(r"[\w./\-]", rf"[{_WORDS}./\-]").replace(r"[\w]", rf"[{_WORDS}]").replace(r"\w", rf"[{_WORDS}]")


def phrases(spark, sf):
    """Every request, message and benchmark text."""
    r = derived(spark, sf, "requests").select(F.concat(F.lit("r"), F.col("req_id").cast("string")).alias("id"), F.col("request").alias("text"))
    c = table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"), "text")
    b = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text")
    return r.unionByName(c).unionByName(b)


PHRASES = f"""{cte("requests")}, phrases AS (SELECT 'r' || req_id AS id, request AS text FROM requests UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations
 UNION ALL SELECT 'b' || item_id, text FROM benchmark), low AS (SELECT id, text, lower(text) AS l, regexp_replace(lower(text), {TRIM}) AS t FROM phrases)"""



def risk_re2(pattern: str) -> str:
    """A risk pattern with Unicode words, boundaries and white space spelled out for RE2."""
    outside = rf"[^{_WORDS}]"
    if pattern.startswith(r"\b"):
        pattern = f"(^|{outside})" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"({outside}|$)"
    return pattern.replace(r"[^\s]", "[^" + WS[1:]).replace(r"\s", WS).replace(r"\w", f"[{_WORDS}]")


_RISK_SQL = cases([(any_matches("lower(command)", map(risk_re2, ps)), q(level)) for level, ps in fixed.RISK.items()], q("Safe"))
_RISK_CI_SQL = cases([(any_matches("lower(command)", ["(?i)" + risk_re2(p) for p in ps]), q(level)) for level, ps in fixed.RISK.items()], q("Safe"))


@query("command_risk", "CL10 CL11", f"""WITH {cte("commands")}, r AS (SELECT cmd_id, command, {_RISK_SQL} AS risk, {_RISK_CI_SQL} AS risk_any_case FROM commands)
SELECT cmd_id, risk, risk_any_case, risk <> 'Safe' AS confirm, risk IN ('High', 'Critical') AS password, risk = 'Critical' AS blocked, {any_contains("command", fixed.BLOCKED_COMMANDS)} AS refused,
 regexp_extract(command, '^\\s*(\\S+)', 1) IN ('ls', 'cat', 'git') OR regexp_matches(regexp_extract(command, '^\\s*(\\S+)', 1), '/(ls|cat|git)$') AS allowed FROM r""")
def command_risk(spark, sf):
    c = derived(spark, sf, "commands")
    risk = F.col("risk")
    return (c.withColumn("risk", rules.command_risk(F.col("command"))).select(
        "cmd_id", "risk", rules.command_risk(F.col("command"), True).alias("risk_any_case"), (risk != "Safe").alias("confirm"),
        risk.isin("High", "Critical").alias("password"), (risk == "Critical").alias("blocked"), rules.blocked(F.col("command")).alias("refused"),
        rules.allowed(F.col("command"), ["ls", "cat", "git"]).alias("allowed")))


@query("text_command_risk", "CL10", f"""WITH c AS (SELECT doc_id AS cmd_id, text AS command FROM documents) SELECT risk, count(*) AS n FROM (SELECT {_RISK_SQL} AS risk FROM c) GROUP BY risk""")
def text_command_risk(spark, sf):
    return spread(table(spark, sf, "documents").select("text")).select(rules.command_risk(F.col("text")).alias("risk")).groupBy("risk").agg(F.count("*").alias("n"))


_ACTION_SQL = cases([(f"(t = {q(w)} OR starts_with(t, {q(w + ' ')}))", q(a)) for w, a in fixed.SIMPLE_COMMANDS.items()])
_LANG_SQL = cases([(any_contains("t", w), q(g)) for g, w in fixed.REQUEST_LANGUAGES.items()], q("unknown"))
_PATHS_SQL = ("list_filter(string_split_regex(text, '" + WS + "+'), lambda w: w <> '' AND contains(w, '.') AND (contains(w, '/') OR "
              + " OR ".join(f"ends_with(w, {q(e)})" for e in fixed.REQUEST_PATH_ENDS) + "))")


@query("task_type", "CL1 CL3 CL4", f"""WITH {PHRASES}, k AS (SELECT id, text, t, {_ACTION_SQL} AS action, {any_contains("t", fixed.GENERATE_WORDS)} AND {any_contains("t", fixed.GENERATED_THINGS)} AS gen,
 {_PATHS_SQL} AS paths FROM low)
SELECT id, CASE WHEN action IS NOT NULL THEN 'SimpleCommand' WHEN gen THEN 'CodeGeneration' ELSE 'SimpleChat' END AS task, CASE WHEN action IS NOT NULL THEN action WHEN gen THEN {_LANG_SQL} END AS detail,
 action IS NULL AND gen AS heavy, CAST(CASE WHEN action IS NOT NULL THEN 1 WHEN gen THEN 60 ELSE 5 END AS INTEGER) AS seconds, CAST(30 + 10 * len(paths) AS INTEGER) AS review_seconds, array_to_string(paths, ',') AS paths FROM k""")
def task_type(spark, sf):
    text = F.col("text")
    p = phrases(spark, sf).select("id", "text", rules.simple_action(text).alias("action"), rules.asks_generation(text).alias("gen"), rules.request_paths(text).alias("paths"))
    command, gen = F.col("action").isNotNull(), F.col("gen")
    return p.select(
        "id", F.when(command, "SimpleCommand").when(gen, "CodeGeneration").otherwise("SimpleChat").alias("task"),
        F.when(command, F.col("action")).when(gen, rules.request_language(text)).alias("detail"), (~command & gen).alias("heavy"),
        F.when(command, 1).when(gen, 60).otherwise(5).alias("seconds"), (F.size("paths") * 10 + 30).alias("review_seconds"), F.array_join("paths", ",").alias("paths"))


@query("complexity_class", "CL2", f"""WITH {PHRASES}, k AS (SELECT id, t, {any_contains("t", fixed.CODE_WORDS)} AS code, {any_contains("t", fixed.PROJECT_WORDS)} AS project, strlen(t) AS n FROM low)
SELECT id, CASE WHEN regexp_matches(t, '[0-9]') AND regexp_matches(t, '[-+*/=^%]') AND NOT code AND n < 50 THEN 'General' WHEN {any_starts("t", fixed.CASUAL_STARTS)} AND n < 30 THEN 'General'
 WHEN {any_contains("t", fixed.DEFINITION_WORDS)} AND NOT code AND NOT project THEN 'General' ELSE 'CodeContext' END AS complexity FROM k""")
def complexity_class(spark, sf):
    return phrases(spark, sf).select("id", rules.complexity_class(F.col("text")).alias("complexity"))


_INTENT_SQL = cases([(any_contains("l", w), q(i)) for i, w in fixed.INTENTS], q("Chat"))
_PATH_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {q(re2(p))}), '')" for p in fixed.REQUEST_PATHS) + ")"


@query("intent_plan", "CL5 CL6 CL7 SC7", f"""WITH {PHRASES}, k AS (SELECT id, {_INTENT_SQL} AS intent, {_PATH_SQL} AS path FROM low)
SELECT id, intent, path, CAST(CASE intent WHEN 'SearchCode' THEN 0.9 WHEN 'ReadCode' THEN CASE WHEN path IS NULL THEN 0.7 ELSE 0.95 END WHEN 'AnalyzeCode' THEN CASE WHEN path IS NULL THEN 0.8 ELSE 0.9 END
 WHEN 'BrowseFiles' THEN 0.9 WHEN 'Explain' THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence,
 CASE intent WHEN 'SearchCode' THEN 'semantic_search' WHEN 'ReadCode' THEN CASE WHEN path IS NULL THEN 'semantic_search>reasoning' ELSE 'read_file' END
 WHEN 'AnalyzeCode' THEN CASE WHEN path IS NULL THEN 'project_context' ELSE 'analyze_code' END WHEN 'BrowseFiles' THEN 'list_directory' WHEN 'Explain' THEN 'semantic_search>reasoning' ELSE 'reasoning' END AS steps FROM k""")
def intent_plan(spark, sf):
    path = rules.first_pattern(F.col("text"), [(tx.unicode_regex(p), needs) for p, needs in zip(fixed.REQUEST_PATHS, (".", "src/", "/"))])
    p = phrases(spark, sf).select("id", rules.intent(F.col("text")).alias("intent"), path.alias("path"))
    has = F.col("path").isNotNull()
    return p.select("id", "intent", "path", rules.plan_confidence(F.col("intent"), has).alias("confidence"), F.array_join(rules.plan_steps(F.col("intent"), has), ">").alias("steps"))


@query("intent_counts", "CL5 AG11", f"WITH {PHRASES} SELECT {_INTENT_SQL} AS intent, count(*) AS n FROM low GROUP BY 1")
def intent_counts(spark, sf):
    return phrases(spark, sf).groupBy(rules.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


@query("explain_route", "CL8", f"WITH {PHRASES} SELECT id, CASE WHEN {any_contains('l', fixed.EXPLAIN_PHRASES)} THEN 'RepositoryAnalysis' ELSE 'ask_model' END AS route FROM low")
def explain_route(spark, sf):
    asks = tx.contains_any(F.lower("text"), fixed.EXPLAIN_PHRASES)
    return phrases(spark, sf).select("id", F.when(asks, "RepositoryAnalysis").otherwise("ask_model").alias("route"))


_ROUTES = in_list(["RepositoryAnalysis", "DirectResponse", "ToolExecution", "FullPipeline"])


@query("model_route", "CL8 SC24", f"""WITH {cte("replies")}, b AS (SELECT conv_id, turn, nullif(regexp_extract(reply, '(?s)\\{{.*\\}}'), '') AS body FROM replies),
j AS (SELECT *, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.route') END AS r, CASE WHEN json_valid(body) THEN try_cast(json_extract_string(body, '$.confidence') AS DOUBLE) END AS c,
 CASE WHEN json_valid(body) THEN json_extract_string(body, '$.mode') END AS m FROM b WHERE body IS NOT NULL),
k AS (SELECT conv_id, turn, CASE WHEN r IS NOT NULL AND c IS NOT NULL THEN r ELSE 'ToolExecution' END AS r, CASE WHEN r IS NOT NULL AND c IS NOT NULL THEN c ELSE 0.5 END AS c, CASE WHEN m IN ('Build', 'Plan') THEN m ELSE 'Ask' END AS m FROM j)
SELECT conv_id, turn, CASE WHEN c >= 0.8 AND r IN {_ROUTES} THEN r ELSE 'ToolExecution' END AS route, CASE WHEN c < 0.8 OR r NOT IN {_ROUTES} THEN 'Ask' WHEN r = 'ToolExecution' THEN m END AS mode, round(c, 6) AS confidence FROM k""")
def model_route(spark, sf):
    r = derived(spark, sf, "replies").select("conv_id", "turn", rules.routed(F.col("reply")).alias("d")).filter(F.col("d").isNotNull())
    return r.select("conv_id", "turn", "d.route", "d.mode", F.round("d.confidence", 6).alias("confidence"))


@query("vague_answers", "CL22 CL20", f"""WITH {cte("replies")} SELECT conv_id, turn, {any_contains("lower(reply)", fixed.VAGUE_PHRASES)} AS vague, NOT starts_with(reply, 'Error') AND NOT starts_with(reply, '❌') AS success FROM replies""")
def vague_answers(spark, sf):
    reply = F.col("reply")
    return derived(spark, sf, "replies").select("conv_id", "turn", tx.contains_any(F.lower(reply), fixed.VAGUE_PHRASES).alias("vague"),
                                                (~tx.starts_with_any(reply, ["Error", "❌"])).alias("success"))


@query("tool_calls", "CL23 SC34", f"""WITH {cte("replies")}, b AS (SELECT *, instr(reply, '<tool_call>') AS s, instr(reply, '</tool_call>') AS e FROM replies),
j AS (SELECT *, CASE WHEN s > 0 AND e > s THEN trim(substr(reply, s + 11, e - s - 11)) END AS body FROM b)
SELECT conv_id, turn, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.name') END AS tool, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.arguments.path') END AS path,
 regexp_replace(regexp_replace(reply, '(?s)<tool_call>.*?</tool_call>', '', 'g'), {TRIM}) AS content, regexp_replace(reply, '(?s)<think>.*?</think>', '', 'g') AS spoken,
 CASE WHEN regexp_matches(reply, '(?m)^TOOL:') AND regexp_matches(reply, '(?m)^ARGS:') THEN regexp_replace(regexp_extract(reply, '(?m)^TOOL:(.*)$', 1), {TRIM}) END AS plain_tool FROM j""")
def tool_calls(spark, sf):
    reply = F.col("reply")
    r = derived(spark, sf, "replies").withColumn("call", rules.tool_call(reply))
    tool_line = F.try_element_at(F.filter(tx.lines(reply), lambda x: F.startswith(x, F.lit("TOOL:"))), F.lit(1))
    args_line = F.try_element_at(F.filter(tx.lines(reply), lambda x: F.startswith(x, F.lit("ARGS:"))), F.lit(1))
    plain = F.when(args_line.isNotNull(), tx.trim(F.replace(tool_line, F.lit("TOOL:"), F.lit(""))))
    return r.select("conv_id", "turn", F.col("call.name").alias("tool"), F.get_json_object("call.arguments", "$.path").alias("path"),
                    rules.without_tool_calls(reply).alias("content"), rules.without_thoughts(reply).alias("spoken"), plain.alias("plain_tool"))


_MPATH = (f"coalesce(nullif(regexp_extract(text, {q(re2(fixed.MESSAGE_PATHS[0]))}), ''), nullif(regexp_extract(text, {q(fixed.MESSAGE_PATHS[1])}, 1), ''), "
          f"list_filter(regexp_extract_all(text, {q(re2(fixed.MESSAGE_PATHS[2]))}, 1), lambda m: contains(m, '/') OR m = 'src' OR m = '.')[1])")
_MCMD = cases([(any_contains("l", w), q(c)) for c, w in fixed.MESSAGE_COMMANDS]
              + [("contains(l, 'npm run')", "'npm run ' || coalesce(nullif(regexp_extract(text, '(?is)npm run.\\s*(\\S+)', 1), ''), 'dev')")],
              f"coalesce(nullif(regexp_extract(text, {q(fixed.QUOTED_COMMAND)}, 1), ''), 'cargo build')")
_GIT = cases([(any_contains("l", w), q(c)) for c, w in fixed.GIT_COMMANDS], q("git status"))
_NL_ARMS = [
    (f"({any_contains('l', fixed.ACTION_READ)} OR {any_starts('l', fixed.ACTION_READ_STARTS)}) AND path IS NOT NULL", "'read_file|' || path"),
    (any_contains("l", fixed.ACTION_LIST), "'list_directory|' || coalesce(path, '.')"),
    (any_contains("l", fixed.ACTION_EXEC), "'execute_shell|' || cmd"),
    (any_contains("l", fixed.ACTION_TEST), "'execute_shell|cargo test'"),
    (any_contains("l", fixed.ACTION_GIT), f"'execute_shell|' || {_GIT}"),
    (f"{any_contains('l', fixed.ACTION_SEARCH)} AND term <> ''", "'search_files|' || term"),
    (any_contains("l", fixed.ACTION_STRUCTURE), "'list_directory|.'"),
    (f"{any_contains('l', fixed.ACTION_ANALYSE)} AND {any_contains('l', fixed.ACTION_ANALYSE_OBJECTS)}", "'run_linter|.'"),
    (any_contains("l", fixed.ACTION_DEPENDENCIES), "'read_file|Cargo.toml'"),
    (any_contains("l", fixed.ACTION_MAIN), "'read_file|src/main.rs'"),
    (any_contains("l", fixed.ACTION_DOCS), "'read_file|README.md'"),
]


@query("nl_action", "CL24 CL25", f"""WITH {PHRASES}, k AS (SELECT id, text, l, {_MPATH} AS path, {_MCMD} AS cmd,
 array_to_string(list_filter(string_split_regex(text, '{WS}+'), lambda w: w <> '')[2:], ' ') AS term FROM low), a AS (SELECT id, {cases(_NL_ARMS)} AS v FROM k)
SELECT id, string_split(v, '|')[1] AS action, substr(v, instr(v, '|') + 1) AS argument FROM a""")
def nl_action(spark, sf):
    call = rules.message_action(F.col("text"), ("Cargo.toml", "src/main.rs", "README.md"))
    return phrases(spark, sf).select("id", call.alias("c")).select("id", "c.action", "c.argument")


_TT = cases([(any_contains("dl", w), q(k)) for k, w in fixed.TASK_TYPES.items()], q("Implementation"))
_TOOL = cases([(f"task_type = {q(k)}" + ("" if w is None else f" AND {any_contains('dl', w)}"), q(t)) for k, w, t in fixed.TASK_TOOLS])
_EFFORT = cases([(any_contains("dl", fixed.EFFORT_COMPLEX), q("Complex")), (any_contains("dl", fixed.EFFORT_LARGE), q("Large"))]
                + [(f"task_type = {q(k)}", q(e)) for k, e in fixed.EFFORT_BY_TYPE.items()]
                + [(f"len(list_filter(string_split_regex(description, '{WS}+'), lambda w: w <> '')) > 20", q("Large"))], q("Medium"))


@query("plan_tasks", "CL12 WN11", f"""WITH {cte("task_plans")}, l AS (SELECT plan_id, unnest(string_split(analysis, chr(10))) AS line, generate_subscripts(string_split(analysis, chr(10)), 1) AS i FROM task_plans),
s AS (SELECT plan_id, i, regexp_replace(line, {TRIM}) AS line FROM l), d AS (SELECT plan_id, i, trim(regexp_replace(line, '^[0-9.\\-* :]+', '')) AS description FROM s WHERE regexp_matches(line, '^([0-9]|-|\\*|Task|Step)')),
n AS (SELECT plan_id, description, lower(description) AS dl, row_number() OVER (PARTITION BY plan_id ORDER BY i) AS task_no FROM d WHERE strlen(description) > 5),
t AS (SELECT *, {_TT} AS task_type FROM n)
SELECT plan_id, task_no, description, task_type, {_TOOL} AS tool, {_EFFORT} AS effort, CASE WHEN task_no > 1 THEN 'task_' || (task_no - 1) END AS depends_on, greatest(100 - task_no, 1) AS priority FROM t
UNION ALL SELECT plan_id, 1, analysis, 'Implementation', NULL, 'Medium', NULL, 100 FROM task_plans WHERE plan_id NOT IN (SELECT plan_id FROM n)""")
def plan_tasks(spark, sf):
    return rules.plan_tasks(derived(spark, sf, "task_plans"), "plan_id", "analysis")


@query("simplified_prompts", "CL16 SC5", f"""WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Context: ' || doc_id || ' Question: ' || text || ' Example: x' ELSE text || ' Example: ' || text END AS prompt FROM documents),
c AS (SELECT doc_id, string_split(substr(prompt, 1, 2000), 'Example:')[1] AS cut FROM p)
SELECT doc_id, regexp_replace(CASE WHEN contains(cut, 'Context:') AND contains(cut, 'Question:') THEN substr(cut, instr(cut, 'Question:')) ELSE cut END, {TRIM}) AS prompt FROM c""")
def simplified_prompts(spark, sf):
    p = table(spark, sf, "documents").selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Context: ' || doc_id || ' Question: ' || text || ' Example: x' ELSE text || ' Example: ' || text END AS prompt")
    return p.select("doc_id", rules.simplify_prompt(F.col("prompt")).alias("prompt"))


@query("slash_commands", "SC33", f"""WITH {cte("replies")}, t AS (SELECT conv_id, turn, regexp_replace(reply, {TRIM}) AS r FROM replies)
SELECT conv_id, turn, regexp_extract(r, '^/(\\S*)', 1) AS command, regexp_extract(r, '(?s)^/\\S*\\s*(.*)$', 1) AS args FROM t WHERE starts_with(r, '/')""")
def slash_commands(spark, sf):
    r = derived(spark, sf, "replies").select("conv_id", "turn", tx.trim(F.col("reply")).alias("r")).filter(F.startswith("r", F.lit("/")))
    return r.select("conv_id", "turn", F.regexp_extract("r", r"^/(\S*)", 1).alias("command"), F.regexp_extract("r", r"(?s)^/\S*\s*(.*)\z", 1).alias("args"))


_TOOL_CLASS = "CASE event_type WHEN 'signup' THEN 'shell' WHEN 'error' THEN 'shell' WHEN 'click' THEN 'git' WHEN 'purchase' THEN 'write:' || json_extract_string(props, '$.k') END"


@query("tool_groups", "CL19", f"""WITH e AS (SELECT user_id, event_id, ts, {_TOOL_CLASS} AS cls FROM events),
lead AS (SELECT user_id, arg_min(coalesce(cls, ''), (ts, event_id)) AS leader FROM e GROUP BY user_id)
SELECT user_id, event_id, CASE WHEN cls = leader THEN row_number() OVER (PARTITION BY user_id, cls ORDER BY ts, event_id) ELSE 1 END AS group_no FROM e JOIN lead USING (user_id)""")
def tool_groups(spark, sf):
    """Greedy parallel groups: only requests that conflict with the first request leave its group, each into its own."""
    conflict = (F.when(F.col("event_type").isin("signup", "error"), "shell").when(F.col("event_type") == "click", "git")
                .when(F.col("event_type") == "purchase", F.concat(F.lit("write:"), F.get_json_object("props", "$.k"))))
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", conflict.alias("cls"))
    leader = e.groupBy("user_id").agg(F.min_by(F.coalesce("cls", F.lit("")), F.struct("ts", "event_id")).alias("leader"))
    same = F.coalesce(F.col("cls") == F.col("leader"), F.lit(False))
    counted = running_sum(e.join(leader, "user_id"), ["user_id"], ["ts", "event_id"], time_bucket(e, ["user_id"], "ts"), same.cast("bigint"), "nth")
    return counted.select("user_id", "event_id", F.when(same, F.col("nth")).otherwise(F.lit(1)).cast("bigint").alias("group_no"))
