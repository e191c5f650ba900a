"""Code structure and metrics. A file is one row, so everything works inside the row's line array, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as tx
from weftline.operators.rows import unnest_fields

SYMBOL = ("struct<kind:string,name:string,visibility:string,params:array<string>,return_type:string,line_start:int,line_end:int,"
          "complexity:bigint,head:string,above:string>")


def style_score(text: Column) -> Column:
    """100 less one per line with trailing blanks and one per line over 100 bytes, at least 0."""
    lines = tx.lines(text)
    trailing = F.filter(lines, lambda x: F.endswith(x, F.lit(" ")) | F.endswith(x, F.lit("\t")))
    long_lines = F.filter(lines, lambda x: F.octet_length(x) > 100)
    return F.greatest(F.lit(0), 100 - F.size(trailing) - F.size(long_lines))


def complexity(text: Column) -> Column:
    """One plus every occurrence of a decision token; ``else if`` also counts its ``if``."""
    total = F.lit(1).cast("bigint")
    for token in fixed.DECISION_TOKENS:
        total = total + tx.count_of(text, token)
    return total


def line_metrics(lines: Column, language: Column) -> Column:
    """``struct(code, comment, blank, max_nesting)`` from one pass over the lines."""
    zero = F.struct(F.lit(False).alias("open"), *[F.lit(0).alias(n) for n in ("code", "comment", "blank", "depth", "max_nesting")])
    slash, hashed = language.isin(fixed.SLASH_COMMENT_LANGUAGES), language.isin(fixed.HASH_COMMENT_LANGUAGES)

    def brackets(line, chars):
        return F.octet_length(line) - F.octet_length(F.translate(line, chars, ""))

    def step(state, pair):
        line, body = pair["line"], pair["body"]
        blank = body == ""
        opened = state["open"] | F.startswith(body, F.lit("/*"))
        closes = F.endswith(body, F.lit("*/"))
        quote = F.startswith(body, F.lit('"""')) | F.startswith(body, F.lit("'''"))
        is_open = (F.when(blank, state["open"]).when(slash, opened & ~closes)
                   .when(hashed, F.when(quote, ~state["open"]).otherwise(state["open"])).otherwise(state["open"]))
        comment = (F.when(slash, closes | opened | F.startswith(body, F.lit("//")))
                   .when(hashed, quote | state["open"] | F.startswith(body, F.lit("#")))
                   .otherwise(F.startswith(body, F.lit("//")) | F.startswith(body, F.lit("#"))))
        depth = state["depth"] + brackets(line, "{([") - brackets(line, "})]")

        def one(condition):
            return condition.cast("int")

        return F.struct(
            is_open.alias("open"), (state["code"] + one(~blank & ~comment)).alias("code"), (state["comment"] + one(~blank & comment)).alias("comment"),
            (state["blank"] + one(blank)).alias("blank"), depth.alias("depth"), F.greatest(state["max_nesting"], depth).alias("max_nesting"))

    return F.aggregate(F.transform(lines, lambda x: F.struct(x.alias("line"), tx.trim(x).alias("body"))), zero, step)


def braces(lines: Column) -> Column:
    """Every curly brace as ``struct(at, mark)`` with its 0-based line."""

    def of_line(line, at):
        marks = F.filter(F.split(F.regexp_replace(line, "[^{}]", ""), ""), lambda c: c != "")
        return F.transform(marks, lambda c: F.struct(at.alias("at"), c.alias("mark")))

    return F.flatten(F.transform(lines, of_line))


def block_end(marks: Column, start: Column, count: Column) -> Column:
    """1-based line where the block opened at or after 0-based line ``start`` closes; the last line when it never does."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("started"), F.lit(None).cast("int").alias("end"))

    def step(state, mark):
        up = mark["mark"] == "{"
        depth = state["depth"] + F.when(up, 1).otherwise(-1)
        ends = state["end"].isNull() & ~up & state["started"] & (depth == 0)
        return F.struct(depth.alias("depth"), (state["started"] | up).alias("started"), F.when(ends, mark["at"] + 1).otherwise(state["end"]).alias("end"))

    return F.coalesce(F.aggregate(F.filter(marks, lambda b: b["at"] >= start), zero, step)["end"], count)


def indent_end(lines: Column, start: Column, line: Column, count: Column) -> Column:
    """Line count before the first later non-blank line indented no deeper than 0-based line ``start``."""
    own = F.octet_length(line) - F.octet_length(F.regexp_replace(line, rf"\A{tx.WS}+", ""))

    def outside(other, at):
        body = tx.trim(other)
        return F.when((at > start) & (body != "") & (F.octet_length(other) - F.octet_length(body) <= own), at)

    return F.coalesce(F.array_min(F.transform(lines, outside)), count)


def _heads_of(t: Column, language: Column) -> Column:
    """What a trimmed line defines: ``struct(kind, name, visibility, params, return_type, ends)``, null for nothing.

    ``ends`` says how the block ends: by brace, by indent, or on its own line.
    """

    def heads(*words):
        return tx.starts_with_any(t, words)

    def part(pattern):
        return tx.trim(F.regexp_extract(t, pattern, 1))

    no_params = F.array().cast("array<string>")
    no_return = F.lit(None).cast("string")

    def symbol(kind, name, visibility="Public", ends="brace", params=no_params, returns=no_return):
        cols = {"kind": kind, "name": name, "visibility": visibility, "params": params, "return_type": returns, "ends": ends}
        return F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in cols.items()])

    public = F.when(F.startswith(t, F.lit("pub")), "Public").otherwise("Private")
    params = F.filter(F.transform(F.split(F.regexp_extract(t, r"^.*?fn [^(]*\(([^)]*)\)", 1), ","), tx.trim), lambda p: p != "")
    returns = F.when(F.contains(t, F.lit("->")), part(r"->([^{]*)"))
    def_name = part(r"^.*?def ([^(]*)\(")
    hidden = F.startswith(def_name, F.lit("_")) & ~F.startswith(def_name, F.lit("__"))
    script_name = part(r"function\s*([^(]*)\(")
    declared = F.regexp_extract(t, "^(const|let) ", 1)
    plain = heads("function ", "async function")
    assigned = (F.startswith(t, F.lit("const ")) & F.contains(t, F.lit(" = ("))) | F.contains(t, F.lit(" function "))
    rust = (
        F.when(heads("pub fn ", "fn ", "pub async fn ", "async fn ") & t.rlike(r"fn [^(]*\([^)]*\)"),
               symbol("Function", part(r"^.*?fn ([^(]*)\("), public, params=params, returns=returns))
        .when(heads("pub struct ", "struct "), symbol("Struct", part(r"^.*?struct ([^<{(;\s]*)"), public,
                                                     F.when(F.contains(t, F.lit(";")), "line").otherwise("brace")))
        .when(heads("pub enum ", "enum "), symbol("Enum", part(r"^.*?enum ([^<{\s]*)"), public))
        .when(heads("pub trait ", "trait "), symbol("Trait", part(r"^.*?trait ([^<{:\s]*)"), public))
        .when(heads("impl ") & t.rlike(r"^impl\s+\S"), symbol("Module", F.concat(F.lit("impl "), F.regexp_replace(part(r"^impl\s+(\S+)"), "[<{]+$", ""))))
    )
    python = (
        F.when(heads("def ", "async def ") & t.rlike(r"def [^(]*\("), symbol("Function", def_name, F.when(hidden, "Private").otherwise("Public"), "indent"))
        .when(heads("class "), symbol("Class", part(r"^.*?class ([^(:]*)"), ends="indent"))
    )
    script = (
        F.when(plain & t.rlike(r"function[^(]*\(") & (script_name != ""), symbol("Function", script_name))
        .when(~plain & (declared != "") & assigned, symbol("Function", declared))
        .when(heads("class "), symbol("Class", part(r"^.*?class ([^{ ]*)")))
    )
    return F.when(language == "Rust", rust).when(language == "Python", python).when(language.isin("JavaScript", "TypeScript"), script)


def with_structure(files: DataFrame, text: str = "content", language: str = "language") -> DataFrame:
    """Add ``lines`` and ``symbols`` (found by line prefix, in line order).

    Built up in steps so that every part is worked out once per symbol.
    """
    lang, lines, marks = F.col(language), F.col("lines"), F.col("_marks")
    df = files.withColumn("lines", tx.lines(F.col(text))).withColumn("_marks", braces(lines)).withColumn("_count", F.size(lines))
    trimmed = F.transform(lines, tx.trim)
    seen = F.transform(trimmed, lambda t, at: F.struct(at.alias("at"), t.alias("t"), _heads_of(t, lang).alias("s")))
    df = df.withColumn("_found", F.filter(seen, lambda c: c["s"].isNotNull()))

    def ended(c):
        at, s = c["at"], c["s"]
        end = (F.when(s["ends"] == "line", at + 1).when(s["ends"] == "indent", indent_end(lines, at, F.element_at(lines, at + 1), F.col("_count")))
               .otherwise(block_end(marks, at, F.col("_count"))))
        above = F.when(at > 0, F.try_element_at(lines, F.greatest(at, F.lit(1)))).otherwise("")
        return F.struct(s.alias("s"), at.alias("at"), c["t"].alias("head"), end.alias("end"), above.alias("above"))

    def blocked(c):
        block = F.when(c["s"]["kind"] == "Function", F.array_join(F.slice(lines, c["at"] + 1, F.greatest(c["end"] - c["at"], F.lit(0))), "\n"))
        return F.struct(c.alias("c"), block.alias("block"))

    def finished(b):
        c, s = b["c"], b["c"]["s"]
        score = F.when(b["block"].isNull(), F.lit(1)).otherwise(complexity(b["block"])).cast("bigint")
        return F.struct(
            s["kind"].alias("kind"), s["name"].alias("name"), s["visibility"].alias("visibility"), s["params"].alias("params"), s["return_type"].alias("return_type"),
            (c["at"] + 1).alias("line_start"), c["end"].alias("line_end"), score.alias("complexity"), c["head"].alias("head"), c["above"].alias("above"))

    staged = F.transform(F.transform(F.transform(F.col("_found"), ended), blocked), finished)
    return df.withColumn("symbols", staged.cast(f"array<{SYMBOL}>")).drop("_marks", "_count", "_found")


def symbols(files: DataFrame, key: list[str]) -> DataFrame:
    """One row per symbol."""
    return unnest_fields(with_structure(files), key, "symbols")


def imports(files: DataFrame, key: str) -> DataFrame:
    """``(key, line, module, external)``."""
    language = F.col("language")

    def at_line(t, at):
        rust = F.regexp_replace(F.regexp_replace(t, "^(use )+", ""), ";+$", "")
        python = F.coalesce(F.try_element_at(tx.words(t), F.lit(2)), F.lit(""))
        quoted = F.regexp_replace(tx.trim(F.regexp_extract(t, "from (.*)$", 1)), "^[\"';]+|[\"';]+$", "")
        required = F.regexp_replace(F.regexp_extract(t, r"require\(([^)]*)\)", 1), "^[\"']+|[\"']+$", "")
        script = F.when(F.contains(t, F.lit("from ")), quoted).otherwise(required)
        inner = tx.starts_with_any(rust, ["crate::", "self::", "super::"])
        hit = F
        for condition, module, external in (
            ((language == "Rust") & F.startswith(t, F.lit("use ")), rust, ~inner),
            ((language == "Python") & tx.starts_with_any(t, ["import ", "from "]), python, ~F.startswith(python, F.lit("."))),
            (language.isin("JavaScript", "TypeScript") & (F.startswith(t, F.lit("import ")) | F.contains(t, F.lit(" require("))), script, ~F.contains(t, F.lit("./"))),
        ):
            hit = hit.when(condition, F.struct((at + 1).alias("line"), module.alias("module"), external.alias("external")))
        return hit

    trimmed = F.transform(tx.lines(F.col("content")), tx.trim)
    return unnest_fields(files, [key], F.filter(F.transform(trimmed, at_line), lambda s: s.isNotNull()))


def issues(files: DataFrame, key: str) -> DataFrame:
    """Lint issues ``(key, severity, rule, line, message)``, all from one pass over the structure."""
    s = with_structure(files)
    language = F.col("language")

    def issue(severity, rule, line, message):
        return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), line.alias("line"), message.alias("message"))

    def of_symbol(x):
        size = x["line_end"] - x["line_start"]
        function = x["kind"] == "Function"
        too_long = F.concat(F.lit("Function '"), x["name"], F.lit("' is too long ("), size.cast("string"), F.lit(" lines)"))
        too_complex = F.concat(F.lit("Function '"), x["name"], F.lit("' has high complexity ("), x["complexity"].cast("string"), F.lit(")"))
        return F.array(F.when(function & (size > 50), issue("Warning", "long-function", x["line_start"], too_long)),
                       F.when(function & (x["complexity"] > 10), issue("Warning", "high-complexity", x["line_start"], too_complex)))

    def of_line(x, at):
        unwraps = (language == "Rust") & F.contains(x, F.lit("unwrap()")) & ~F.contains(x, F.lit("// "))
        logs = language.isin("JavaScript", "TypeScript") & F.contains(x, F.lit("console.log"))
        return F.array(
            F.when(tx.contains_any(x, ["TODO", "FIXME", "HACK"]), issue("Info", "todo-comment", at + 1, F.concat(F.lit("Found TODO/FIXME comment: "), tx.trim(x)))),
            F.when(unwraps, issue("Hint", "unwrap-used", at + 1, F.lit("Consider handling the error instead of unwrap()"))),
            F.when(logs, issue("Hint", "no-console", at + 1, F.lit("Remove console.log before production"))))

    found = F.concat(F.flatten(F.transform("symbols", of_symbol)), F.flatten(F.transform("lines", of_line)))
    return unnest_fields(s, [key], F.array_compact(found))


def calls(content: Column) -> Column:
    """Sorted distinct names followed by an opening parenthesis."""
    names = F.regexp_extract_all(content, F.lit(r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\("), F.lit(1))
    return F.sort_array(F.array_distinct(F.filter(names, lambda n: ~n.isin(fixed.CALL_EXCLUSIONS))))


def local_names(content: Column, language: Column) -> Column:
    def found(pattern):
        return F.regexp_extract_all(content, F.lit(pattern), F.lit(2))

    return (F.when(language == "Rust", found(r"let\s+(mut\s+)?([a-zA-Z_][a-zA-Z0-9_]*)"))
            .when(language == "Python", found(r"\A(\s*)([a-zA-Z_][a-zA-Z0-9_]*)\s*="))
            .when(language.isin("JavaScript", "TypeScript"), found(r"(const|let|var)\s+([a-zA-Z_][a-zA-Z0-9_]*)"))
            .otherwise(F.array().cast("array<string>")))


def rust_docs(lines: Column) -> Column:
    """``array(struct(kind, name, description))``: doc lines collected since the last other code line."""
    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("doc"), F.array().cast("array<struct<kind:string,name:string,description:string>>").alias("items"))

    def step(state, t):
        doc = F.startswith(t, F.lit("///"))
        function, structure = tx.starts_with_any(t, ["pub fn ", "fn "]), tx.starts_with_any(t, ["pub struct ", "struct "])
        name = F.when(function, F.regexp_extract(t, r"^.*?fn ([^(]*)\(", 1)).otherwise(F.regexp_extract(t, r"^.*?struct ([^ {(<]*)", 1))
        item = F.struct(F.when(function, "function").otherwise("struct").alias("kind"), tx.trim(name).alias("name"), F.array_join(state["doc"], " ").alias("description"))
        keeps = (t == "") | F.startswith(t, F.lit("//"))
        text = tx.trim(F.regexp_replace(t, "^(///)+", ""))
        return F.struct(
            F.when(doc, F.array_append(state["doc"], text)).when(keeps, state["doc"]).otherwise(empty).alias("doc"),
            F.when(~doc & (function | structure), F.array_append(state["items"], item)).otherwise(state["items"]).alias("items"))

    return F.aggregate(F.transform(lines, tx.trim), zero, step)["items"]


def script_docs(lines: Column) -> Column:
    """As ``rust_docs`` for block comments opened by ``/**``; lines starting with ``@`` are left out."""
    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("doc"), F.lit(False).alias("open"), F.array().cast("array<struct<kind:string,name:string,description:string>>").alias("items"))

    def step(state, t):
        opens, closes = F.startswith(t, F.lit("/**")), F.contains(t, F.lit("*/")) & state["open"]
        text = tx.trim(F.regexp_replace(t, r"^\*+", ""))
        doc = (F.when(opens, empty).when(~closes & state["open"] & ~F.startswith(text, F.lit("@")), F.array_append(state["doc"], text)).otherwise(state["doc"]))
        function = tx.starts_with_any(t, ["function ", "export function ", "async function ", "export async function "]) | F.contains(t, F.lit("=> {"))
        bare = F.replace(F.replace(t, F.lit("export "), F.lit("")), F.lit("async "), F.lit(""))
        arrow = F.element_at(F.split(tx.trim(F.substring_index(bare, "=", 1)), r"\s+"), -1)
        name = F.when(F.contains(bare, F.lit("function ")), tx.trim(F.regexp_extract(bare, r"function ([^(]*)\(", 1))).otherwise(arrow)
        klass = tx.starts_with_any(t, ["class ", "export class "])
        class_name = tx.trim(F.regexp_extract(bare, r"class ([^ {<]*)", 1))

        def item(kind, label):
            return F.struct(F.lit(kind).alias("kind"), label.alias("name"), F.array_join(doc, " ").alias("description"))

        items = F.when(function & (name != ""), F.array_append(state["items"], item("function", name))).otherwise(state["items"])
        items = F.when(klass, F.array_append(items, item("class", class_name))).otherwise(items)
        return F.struct(F.when(function | klass, empty).otherwise(doc).alias("doc"), F.when(opens, True).when(closes, False).otherwise(state["open"]).alias("open"), items.alias("items"))

    return F.aggregate(F.transform(lines, tx.trim), zero, step)["items"]


def python_docs(lines: Column) -> Column:
    """``array(struct(kind, name, description))`` for ``def`` and ``class`` lines.

    The description is the docstring opening on the next line: one line, or several joined by blanks.
    """

    def named(t, at):
        function, klass = F.startswith(t, F.lit("def ")), F.startswith(t, F.lit("class "))
        name = F.when(function, F.regexp_extract(t, r"def ([^(]*)\(", 1)).otherwise(F.regexp_extract(t, r"class ([^(:]*)", 1))
        return F.when(function | klass, F.struct(F.when(function, "function").otherwise("class").alias("kind"), tx.trim(name).alias("name"), at.alias("at")))

    def opened(d):
        first = tx.trim(F.coalesce(F.try_element_at(lines, d["at"] + 2), F.lit("")))
        later = F.slice(lines, d["at"] + 3, F.greatest(F.size(lines), F.lit(1)))
        return F.struct(d["kind"].alias("kind"), d["name"].alias("name"), first.alias("first"), F.substring(first, 1, 3).alias("quote"), later.alias("later"))

    def closed(d):
        stop = F.array_min(F.transform(d["later"], lambda x, j: F.when(F.contains(x, d["quote"]), j)))
        return F.struct(d.alias("d"), F.coalesce(stop, F.size(d["later"])).alias("stop"))

    def finished(c):
        d, stop = c["d"], c["stop"]
        single = (F.octet_length(d["first"]) > 6) & F.endswith(d["first"], d["quote"])
        middle = F.transform(F.slice(d["later"], F.lit(1), stop), tx.trim)
        last = F.coalesce(F.try_element_at(d["later"], stop + 1), F.lit(""))
        head_of_last = tx.trim(F.substr(last, F.lit(1), F.position(d["quote"], last) - 1))
        tail = F.when(stop < F.size(d["later"]), F.array(head_of_last)).otherwise(F.array().cast("array<string>"))
        several = tx.trim(F.array_join(F.concat(F.array(F.substr(d["first"], F.lit(4))), middle, tail), " "))
        text = F.when(~d["quote"].isin('"""', "'''"), "").when(single, F.substr(d["first"], F.lit(4), F.length(d["first"]) - 6)).otherwise(several)
        return F.struct(d["kind"].alias("kind"), d["name"].alias("name"), text.alias("description"))

    found = F.filter(F.transform(F.transform(lines, tx.trim), named), lambda d: d.isNotNull())
    return F.transform(F.transform(F.transform(found, opened), closed), finished)


def doc_items(files: DataFrame, key: str) -> DataFrame:
    """``(key, language, kind, name, description)`` of documented kinds in every language."""
    lined = files.select(key, "language", tx.lines(F.col("content")).alias("lines"))
    language, lines = F.col("language"), F.col("lines")
    items = F.when(language == "Rust", rust_docs(lines)).when(language == "Python", python_docs(lines)).when(language.isin("JavaScript", "TypeScript"), script_docs(lines))
    return unnest_fields(lined, [key, "language"], items)


def control_depth(block: Column) -> Column:
    """Deepest nesting of control-flow blocks; each ``else if`` nests one deeper than the branch before it."""
    tokens = F.regexp_extract_all(block, F.lit(r"(\belse\s+if\b|\belse\b|\b(?:if|match|while|loop|for)\b|[{};])"), F.lit(1))
    zero = F.struct(F.array().cast("array<int>").alias("stack"), *[F.lit(0).alias(n) for n in ("pending", "last", "depth", "deepest")])

    def step(state, token):
        opens, closes = token == "{", (token == "}") & (F.size(state["stack"]) > 0)
        top = F.coalesce(F.try_element_at(state["stack"], F.lit(-1)), F.lit(0))
        stack = (F.when(opens, F.array_append(state["stack"], state["pending"]))
                 .when(closes, F.slice(state["stack"], F.lit(1), F.size(state["stack"]) - 1)).otherwise(state["stack"]))
        pending = (F.when(F.startswith(token, F.lit("else ")), state["last"] + 1).when(token == "else", state["last"])
                   .when(token.isin("{", "}", ";"), F.lit(0)).otherwise(F.lit(1)))
        depth = state["depth"] + F.when(opens, state["pending"]).when(closes, -top).otherwise(0)
        return F.struct(stack.alias("stack"), pending.alias("pending"), F.when(closes, top).otherwise(state["last"]).alias("last"), depth.alias("depth"),
                        F.greatest(state["deepest"], depth).alias("deepest"))

    return F.aggregate(F.transform(tokens, lambda t: F.regexp_replace(t, r"\s+", " ")), zero, step)["deepest"]


def review_score(style: Column, complex_issues: Column, smells: Column, untested: Column) -> Column:
    complexity_part = 100.0 - F.least(complex_issues * 10, F.lit(100))
    smell_part = 100.0 - F.least(smells * 15, F.lit(100))
    coverage = 100.0 - F.least(untested * 20, F.lit(100))
    return style * 0.3 + complexity_part * 0.3 + smell_part * 0.2 + coverage * 0.2


def grade(score: Column) -> Column:
    whole = F.floor(score)
    return F.when(whole >= 90, "A").when(whole >= 80, "B").when(whole >= 70, "C").when(whole >= 60, "D").otherwise("F")


def diff_stats(old: Column, new: Column) -> tuple[Column, Column]:
    """Positional additions and deletions between two line arrays."""
    changed = F.size(F.filter(F.arrays_zip(old.alias("a"), new.alias("b")), lambda z: (z["a"] != z["b"]) & z["a"].isNotNull() & z["b"].isNotNull()))
    grown = F.size(new) - F.size(old)
    return F.greatest(grown, F.lit(0)) + changed, F.greatest(-grown, F.lit(0)) + changed


def diff_hunk(old: Column, new: Column, most: int | None, context: int = 3) -> Column:
    """``struct(old_start, old_count, new_start, new_count, lines)`` from the first differing position on, null for no lines.

    The printed hunk stops once it holds more than ``most`` lines (none: never); the statistics never do.
    """

    def hunk(a, b, c, d, lines):
        return F.struct(*[(F.lit(v) if isinstance(v, int) else v).cast("int").alias(n) for v, n in zip((a, b, c, d), ("old_start", "old_count", "new_start", "new_count"))],
                        lines.alias("lines"))

    def marked(lines, sign):
        return F.transform(lines, lambda x: F.concat(F.lit(sign), x))

    n_old, n_new = F.size(old), F.size(new)
    pairs = F.transform(F.arrays_zip(old.alias("a"), new.alias("b")), lambda z, i: F.struct(z["a"].alias("a"), z["b"].alias("b"), i.alias("i")))

    def printed(z):
        return (F.when(z["a"] == z["b"], F.array(F.concat(F.lit(" "), z["a"])))
                .when(z["b"].isNull(), F.array(F.concat(F.lit("-"), z["a"]))).when(z["a"].isNull(), F.array(F.concat(F.lit("+"), z["b"])))
                .otherwise(F.array(F.concat(F.lit("-"), z["a"]), F.concat(F.lit("+"), z["b"]))))

    def from_first(zipped, first):
        start = F.greatest(first - context, F.lit(0))
        lead = F.transform(F.slice(zipped, start + 1, first - start), lambda z: F.concat(F.lit(" "), z["a"]))
        if most is None:
            rest = F.size(zipped) - first
            body = F.concat(lead, F.flatten(F.transform(F.slice(zipped, first + 1, rest), printed)))
            return hunk(start + 1, F.greatest(n_old - start, F.lit(0)), start + 1, F.greatest(n_new - start, F.lit(0)), body)
        steps = F.transform(F.slice(zipped, first + 1, F.lit(most + 1)), printed)
        zero = F.struct(lead.alias("lines"), F.lit(0).alias("taken"))

        def take(state, step):
            full = F.size(state["lines"]) > most
            return F.struct(F.when(full, state["lines"]).otherwise(F.concat(state["lines"], step)).alias("lines"), (state["taken"] + (~full).cast("int")).alias("taken"))

        return tx.let(F.aggregate(steps, zero, take), lambda body: hunk(
            start + 1, F.least(first + body["taken"], n_old) - start, start + 1, F.least(first + body["taken"], n_new) - start, body["lines"]))

    differs = lambda z: z["a"].isNotNull() & z["b"].isNotNull() & (z["a"] != z["b"])
    general = tx.let(pairs, lambda zipped: tx.let(
        F.coalesce(F.array_min(F.transform(F.filter(zipped, differs), lambda z: z["i"])), F.lit(0)), lambda first: from_first(zipped, first)))
    return (F.when((n_old == 0) & (n_new == 0), F.lit(None)).when(n_old == 0, hunk(0, 0, 1, n_new, marked(new, "+")))
            .when(n_new == 0, hunk(1, n_old, 0, 0, marked(old, "-"))).otherwise(general))


def extracted(code: Column, name: str, ext: Column, form: str) -> Column:
    """Source text that wraps ``code`` as a function, variable or constant for a file extension; null when unsupported."""
    body = F.replace(code, F.lit("\n"), F.lit("\n    "))
    upper = name.upper()
    forms = {
        "function": {"rs": F.concat(F.lit(f"fn {name}() {{\n    "), body, F.lit("\n}")), "py": F.concat(F.lit(f"def {name}():\n    "), body),
                     "js": F.concat(F.lit(f"function {name}() {{\n    "), body, F.lit("\n}"))},
        "variable": {"rs": F.concat(F.lit(f"let {name} = "), code, F.lit(";")), "py": F.concat(F.lit(f"{name} = "), code), "js": F.concat(F.lit(f"const {name} = "), code, F.lit(";"))},
        "constant": {"rs": F.concat(F.lit(f"const {upper}: _ = "), code, F.lit(";")), "py": F.concat(F.lit(f"{upper} = "), code), "js": F.concat(F.lit(f"const {upper} = "), code, F.lit(";"))},
    }[form]
    return F.when(ext == "rs", forms["rs"]).when(ext == "py", forms["py"]).when(ext.isin("js", "ts"), forms["js"])


def definition_of(lines: Column, name: str) -> Column:
    """Value of the first line that defines ``name``, else null."""

    def value(line):
        t = tx.trim(line)
        at = F.instr(t, "=")
        left, right = F.substr(t, F.lit(1), at - 1), tx.trim(F.substr(t, at + 1))
        bound = tx.starts_with_any(t, ["let ", "const "]) & F.contains(left, F.lit(name))
        return F.when((at > 0) & bound, F.regexp_replace(right, ";+$", "")).when((at > 0) & (tx.trim(left) == name), right)

    return F.try_element_at(F.filter(F.transform(lines, value), lambda v: v.isNotNull()), F.lit(1))


def _edited(lines: Column, hit, change) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.when(hit(x), change(x)).otherwise(x)), "\n")


def _heads(x, function: str, tail: str = ""):
    return tx.contains_any(x, [f"fn {function}{tail}", f"def {function}{tail}", f"function {function}{tail}"])


def change_signature(lines: Column, function: str, signature: str) -> Column:
    return _edited(lines, lambda x: _heads(x, function), lambda x: F.lit(signature))


def add_parameter(lines: Column, function: str, parameter: Column) -> Column:
    """Insert before the last closing parenthesis of the defining line."""

    def change(x):
        inner = F.regexp_extract(x, r"^[^(]*\((.*)\)[^)]*$", 1)
        first = F.concat(F.regexp_extract(x, r"^([^(]*\().*\)[^)]*$", 1), parameter, F.regexp_extract(x, r"(\)[^)]*)$", 1))
        more = F.concat(F.regexp_extract(x, r"^(.*)\)[^)]*$", 1), F.lit(", "), parameter, F.regexp_extract(x, r"(\)[^)]*)$", 1))
        return F.when(tx.trim(inner) == "", first).otherwise(more)

    return _edited(lines, lambda x: _heads(x, function, "(") & F.contains(x, F.lit(")")), change)


def remove_parameter(lines: Column, function: str, parameter: str) -> Column:
    pattern = rf"^(.*?),?\s*{tx.regex_escape(parameter)}[^,)]*,?"

    def change(x):
        out = F.regexp_replace(x, pattern, "$1")
        for bad, good in (("(,", "("), (",)", ")"), (",,", ",")):
            out = F.replace(out, F.lit(bad), F.lit(good))
        return out

    return _edited(lines, lambda x: _heads(x, function, "(") & F.contains(x, F.lit(parameter)), change)
