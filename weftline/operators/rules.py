"""Ordered keyword and pattern rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as tx
from weftline.operators.rows import unnest_fields


def first_match(arms, default=None) -> Column:
    """Value of the first true condition."""
    out = F
    for condition, value in arms:
        out = out.when(condition, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def by_keywords(text: Column, groups, default=None) -> Column:
    return first_match([(tx.contains_any(text, words), label) for label, words in groups], default)


def error_type(message: Column) -> Column:
    return by_keywords(F.lower(message), fixed.ERROR_TYPES.items(), "Other")


def command_risk(command: Column, case_insensitive: bool = False) -> Column:
    """Most severe level whose pattern occurs in the lower-cased command.

    Patterns with capitals cannot match lower-cased text; ``case_insensitive`` lets them.
    """
    lowered = F.lower(command)
    return first_match(
        [(tx.matches_any(lowered, [tx.unicode_regex(p, case_insensitive) for p in ps]), level) for level, ps in fixed.RISK.items()], "Safe"
    )


def blocked(command: Column) -> Column:
    return tx.contains_any(command, fixed.BLOCKED_COMMANDS)


def allowed(command: Column, names: list[str]) -> Column:
    """First word is an allowed name, bare or at the end of a path."""
    head = F.coalesce(F.try_element_at(tx.words(command), F.lit(1)), F.lit(""))
    found = F.lit(False)
    for name in names:
        found = found | (head == name) | F.endswith(head, F.lit("/" + name))
    return found


def simple_action(request: Column) -> Column:
    """Action of a leading command word, else null."""
    text = tx.trim(F.lower(request))
    return first_match([((text == w) | F.startswith(text, F.lit(w + " ")), a) for w, a in fixed.SIMPLE_COMMANDS.items()])


def asks_generation(request: Column) -> Column:
    text = tx.trim(F.lower(request))
    return tx.contains_any(text, fixed.GENERATE_WORDS) & tx.contains_any(text, fixed.GENERATED_THINGS)


def request_language(request: Column) -> Column:
    return by_keywords(tx.trim(F.lower(request)), fixed.REQUEST_LANGUAGES.items(), "unknown")


def request_paths(request: Column):
    """Words that look like file paths."""

    def looks(word):
        ends = F.lit(False)
        for end in fixed.REQUEST_PATH_ENDS:
            ends = ends | F.endswith(word, F.lit(end))
        return F.contains(word, F.lit(".")) & (ends | F.contains(word, F.lit("/")))

    return F.filter(tx.words(request), looks)


def complexity_class(request: Column) -> Column:
    """General for pure arithmetic, short greetings and definitions without code words; else CodeContext."""
    text = tx.trim(F.lower(request))
    code = tx.contains_any(text, fixed.CODE_WORDS)
    project = tx.contains_any(text, fixed.PROJECT_WORDS)
    size = F.octet_length(text)
    arithmetic = text.rlike("[0-9]") & text.rlike(r"[-+*/=^%]") & ~code & (size < 50)
    greeting = tx.starts_with_any(text, fixed.CASUAL_STARTS) & (size < 30)
    definition = tx.contains_any(text, fixed.DEFINITION_WORDS) & ~code & ~project
    return F.when(arithmetic | greeting | definition, "General").otherwise("CodeContext")


def intent(request: Column) -> Column:
    return by_keywords(F.lower(request), fixed.INTENTS, "Chat")


def first_pattern(text: Column, patterns) -> Column:
    """Match of the first (pattern, literal it needs) that occurs, else null; the literal spares most texts the regex."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(needs)), tx.blank_to_null(F.regexp_extract(text, p, 0))) for p, needs in patterns])


def plan_confidence(label: Column, has_path: Column) -> Column:
    return (
        F.when(label == "SearchCode", 0.9)
        .when(label == "ReadCode", F.when(has_path, 0.95).otherwise(0.7))
        .when(label == "AnalyzeCode", F.when(has_path, 0.9).otherwise(0.8))
        .when(label == "BrowseFiles", 0.9)
        .when(label == "Explain", 0.7)
        .otherwise(0.5)
    )


def plan_steps(label: Column, has_path: Column) -> Column:
    """Step names of the plan for an intent."""
    return (
        F.when(label == "SearchCode", F.array(F.lit("semantic_search")))
        .when(label == "ReadCode", F.when(has_path, F.array(F.lit("read_file"))).otherwise(F.array(F.lit("semantic_search"), F.lit("reasoning"))))
        .when(label == "AnalyzeCode", F.when(has_path, F.array(F.lit("analyze_code"))).otherwise(F.array(F.lit("project_context"))))
        .when(label == "BrowseFiles", F.array(F.lit("list_directory")))
        .when(label == "Explain", F.array(F.lit("semantic_search"), F.lit("reasoning")))
        .otherwise(F.array(F.lit("reasoning")))
    )


def message_path(message: Column) -> Column:
    """Path named in a message: a dotted name, a word after a preposition, or a slashed path; else null."""
    slashed = F.filter(
        F.regexp_extract_all(message, F.lit(tx.unicode_regex(fixed.MESSAGE_PATHS[2])), F.lit(1)),
        lambda m: F.contains(m, F.lit("/")) | (m == "src") | (m == "."),
    )
    return F.coalesce(
        F.when(F.contains(message, F.lit(".")), tx.blank_to_null(F.regexp_extract(message, tx.unicode_regex(fixed.MESSAGE_PATHS[0]), 0))),
        tx.blank_to_null(F.regexp_extract(message, tx.unicode_regex(fixed.MESSAGE_PATHS[1]), 1)),
        F.try_element_at(slashed, F.lit(1)),
    )


def message_command(message: Column) -> Column:
    """Shell command meant by a message; building is the default."""
    lowered = F.lower(message)
    script = F.coalesce(tx.blank_to_null(F.regexp_extract(message, r"(?is)npm run.\s*(\S+)", 1)), F.lit("dev"))
    quoted = tx.blank_to_null(F.regexp_extract(message, fixed.QUOTED_COMMAND, 1))
    arms = [(tx.contains_any(lowered, words), command) for command, words in fixed.MESSAGE_COMMANDS]
    arms.append((F.contains(lowered, F.lit("npm run")), F.concat(F.lit("npm run "), script)))
    return first_match(arms, F.coalesce(quoted, F.lit("cargo build")))


def message_action(message: Column, project_files: tuple[str, ...]) -> Column:
    """Tool call meant by a message as ``struct(action, argument)``, null when nothing fits.

    ``project_files`` are the files known to exist, which decides what the manifest, entry point and guide groups read.
    """
    lowered = F.lower(message)
    path = message_path(message)

    def call(action: str, argument):
        return F.struct(F.lit(action).alias("action"), (argument if isinstance(argument, Column) else F.lit(argument)).alias("argument"))

    def has(words):
        return tx.contains_any(lowered, words)

    def read_first(candidates):
        known = [c for c in candidates if c in project_files]
        return call("read_file", known[0]) if known else None

    term = F.array_join(F.slice(tx.words(message), 2, 1_000_000_000), " ")
    git = by_keywords(lowered, fixed.GIT_COMMANDS, "git status")
    reads = has(fixed.ACTION_READ) | tx.starts_with_any(lowered, fixed.ACTION_READ_STARTS)
    arms = [
        (reads & path.isNotNull(), call("read_file", path)),
        (has(fixed.ACTION_LIST), call("list_directory", F.coalesce(path, F.lit(".")))),
        (has(fixed.ACTION_EXEC), call("execute_shell", message_command(message))),
        (has(fixed.ACTION_TEST), call("execute_shell", "cargo test")),
        (has(fixed.ACTION_GIT), call("execute_shell", git)),
        (has(fixed.ACTION_SEARCH) & (term != ""), call("search_files", term)),
        (has(fixed.ACTION_STRUCTURE), call("list_directory", ".")),
        (has(fixed.ACTION_ANALYSE) & has(fixed.ACTION_ANALYSE_OBJECTS), call("run_linter", ".")),
    ]
    for words, files in (
        (fixed.ACTION_DEPENDENCIES, ["Cargo.toml", "package.json"]),
        (fixed.ACTION_MAIN, ["src/main.rs", "main.py", "index.js"]),
        (fixed.ACTION_DOCS, ["README.md", "README"]),
    ):
        target = read_first(files)
        if target is not None:
            arms.append((has(words), target))
    return first_match(arms)


def task_type(description: Column) -> Column:
    return by_keywords(F.lower(description), fixed.TASK_TYPES.items(), "Implementation")


def task_tool(description: Column, kind: Column) -> Column:
    lowered = F.lower(description)
    arms = [(kind == k if words is None else (kind == k) & tx.contains_any(lowered, words), tool) for k, words, tool in fixed.TASK_TOOLS]
    return first_match(arms)


def task_effort(description: Column, kind: Column) -> Column:
    lowered = F.lower(description)
    long_text = F.size(tx.words(description)) > 20
    arms = [(tx.contains_any(lowered, fixed.EFFORT_COMPLEX), "Complex"), (tx.contains_any(lowered, fixed.EFFORT_LARGE), "Large")]
    arms += [(kind == k, effort) for k, effort in fixed.EFFORT_BY_TYPE.items()]
    return first_match(arms, F.when(long_text, "Large").otherwise("Medium"))


def plan_tasks(plans: DataFrame, key: str, text: str) -> DataFrame:
    """Tasks of each plan text, in order, each depending on the one before; a text without any is one task."""
    listed = F.filter(F.transform(tx.lines(F.col(text)), tx.trim), lambda line: line.rlike(r"^([0-9]|-|\*|Task|Step)"))
    described = F.filter(F.transform(listed, lambda line: tx.trim(F.regexp_replace(line, r"^[0-9.\-* :]+", ""))), lambda d: F.octet_length(d) > 5)
    base = plans.select(key, F.col(text).alias("_text"), described.alias("_tasks"))
    rows = unnest_fields(base, [key], F.transform("_tasks", lambda d, i: F.struct(i.alias("_pos"), d.alias("description"))))
    kind = task_type(F.col("description"))
    tasks = rows.withColumn("task_type", kind).select(
        key, (F.col("_pos") + 1).cast("bigint").alias("task_no"), "description", "task_type",
        task_tool(F.col("description"), F.col("task_type")).alias("tool"), task_effort(F.col("description"), F.col("task_type")).alias("effort"),
        F.when(F.col("_pos") > 0, F.concat(F.lit("task_"), F.col("_pos").cast("string"))).alias("depends_on"),
        F.greatest(99 - F.col("_pos"), F.lit(1)).cast("bigint").alias("priority"))
    whole = base.filter(F.size("_tasks") == 0).select(
        key, F.lit(1).cast("bigint").alias("task_no"), F.col("_text").alias("description"), F.lit("Implementation").alias("task_type"),
        F.lit(None).cast("string").alias("tool"), F.lit("Medium").alias("effort"), F.lit(None).cast("string").alias("depends_on"),
        F.lit(100).cast("bigint").alias("priority"))
    return tasks.unionByName(whole)


def tool_call(reply: Column) -> Column:
    """``struct(name, arguments)`` of the first tool call block, null when absent or not valid JSON with a name."""
    start, end = F.locate("<tool_call>", reply), F.locate("</tool_call>", reply)
    body = F.when((start > 0) & (end >= start + 11), tx.trim(F.substr(reply, start + 11, end - start - 11)))
    return F.from_json(body, "struct<name:string,arguments:string>")


def without_tool_calls(reply: Column) -> Column:
    return tx.trim(F.regexp_replace(reply, r"(?s)<tool_call>.*?</tool_call>", ""))


def without_thoughts(reply: Column) -> Column:
    return F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")


def simplify_prompt(prompt: Column) -> Column:
    """At most 2000 characters, cut before an example, reduced to the question when context and question are given."""
    cut = F.substring_index(F.substring(prompt, 1, 2000), "Example:", 1)
    asks = F.contains(cut, F.lit("Context:")) & F.contains(cut, F.lit("Question:"))
    return tx.trim(F.when(asks, F.substr(cut, F.locate("Question:", cut))).otherwise(cut))


def routed(reply: Column, min_confidence: float = 0.8) -> Column:
    """Decision from a model reply holding JSON somewhere; null when it holds no braces.

    Unreadable JSON and low confidence both fall back to read-only tool execution.
    """
    schema = "struct<route:string,confidence:double,mode:string>"
    body = tx.blank_to_null(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    parsed = F.from_json(body, schema)
    readable = parsed["route"].isNotNull() & parsed["confidence"].isNotNull()
    confidence = F.when(readable, parsed["confidence"]).otherwise(F.lit(0.5))
    route = F.when(readable, parsed["route"]).otherwise("ToolExecution")
    mode = F.when(readable & parsed["mode"].isin("Build", "Plan"), parsed["mode"]).otherwise("Ask")
    sure = confidence >= min_confidence
    known = route.isin("RepositoryAnalysis", "DirectResponse", "ToolExecution", "FullPipeline")
    return F.when(body.isNotNull(), F.struct(
        F.when(sure & known, route).otherwise("ToolExecution").alias("route"),
        F.when(sure & (route == "ToolExecution"), mode).when(sure & known, F.lit(None)).otherwise("Ask").alias("mode"),
        confidence.alias("confidence")))
