"""Parsers of tool output. One output text is one row, so each works inside its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as tx
from weftline.operators.rows import unnest_fields
from weftline.operators.rules import first_match


def git_log(lines: DataFrame, key: str, line: str) -> DataFrame:
    """``hash|short|author|email|date|message`` rows; the message may hold bars, shorter rows are dropped."""
    parts = lines.select(key, F.split(line, r"\|", 6).alias("_p")).filter(F.size("_p") == 6)
    names = ["hash", "short_hash", "author", "email", "date", "message"]
    return parts.select(key, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])


def change_type(letter: Column) -> Column:
    return first_match([(letter == k, v) for k, v in fixed.CHANGE_TYPES.items()], "Modified")


def git_status(lines: DataFrame, key: str, line: str) -> DataFrame:
    """Staged, unstaged and untracked changes of porcelain rows, with the priority of known codes."""
    raw = F.col(line)
    index, tree, path = F.substring(raw, 1, 1), F.substring(raw, 2, 1), F.substr(raw, F.lit(4))
    code = F.substring(raw, 1, 2)
    kind = first_match([(code == c, t) for c, (t, _) in fixed.WORKTREE_CODES.items()])
    priority = first_match([(code == c, p) for c, (_, p) in fixed.WORKTREE_CODES.items()])
    return lines.filter(F.octet_length(raw) >= 3).select(
        key, path.alias("path"), F.when(~index.isin(" ", "?"), change_type(index)).alias("staged"),
        F.when(~tree.isin(" ", "?"), change_type(tree)).alias("unstaged"), (index == "?").alias("untracked"), kind.alias("worktree_type"), priority.alias("priority"))


def git_branches(outputs: DataFrame, key: str, output: str) -> DataFrame:
    def branch(line):
        words = tx.words(F.regexp_replace(line, r"^[* ]+", ""))
        name = F.try_element_at(words, F.lit(1))
        return F.when(name.isNotNull(), F.struct(name.alias("name"), F.startswith(line, F.lit("*")).alias("is_current"),
                                                 F.startswith(name, F.lit("remotes/")).alias("is_remote"), F.try_element_at(words, F.lit(2)).alias("last_commit")))

    return unnest_fields(outputs, [key], F.array_compact(F.transform(tx.lines(F.col(output)), branch)))


def _range(text: Column, sign: str) -> tuple[Column, Column]:
    start = F.coalesce(F.regexp_extract(text, rf" \{sign}(\d+)", 1).try_cast("int"), F.lit(0))
    count = F.coalesce(F.regexp_extract(text, rf" \{sign}\d*,(\d+)", 1).try_cast("int"), F.lit(1))
    return start, count


def git_diff_hunks(outputs: DataFrame, key: str, output: str) -> DataFrame:
    """``(key, path, hunk_no, old_start, old_lines, new_start, new_lines, additions, deletions, content)``."""
    files = F.slice(F.split(F.concat(F.lit("\n"), F.col(output)), "\ndiff --git "), F.lit(2), F.lit(1_000_000_000))

    def of_file(part):
        first = F.substring_index(part, "\n", 1)
        path = F.regexp_replace(F.element_at(F.split(tx.trim(first), r"\s+"), -1), "^(b/)+", "")
        hunks = F.slice(F.split(part, "\n@@"), F.lit(2), F.lit(1_000_000_000))

        def of_hunk(text, at):
            head = F.substring_index(text, "\n", 1)
            body = F.when(F.contains(text, F.lit("\n")), F.substr(text, F.length(head) + 2)).otherwise("")
            (os, ol), (ns, nl) = _range(head, "-"), _range(head, "+")

            def counted(rows):
                added = F.filter(rows, lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++")))
                gone = F.filter(rows, lambda x: F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("---")))
                return F.struct(path.alias("path"), (at + 1).alias("hunk_no"), os.alias("old_start"), ol.alias("old_lines"), ns.alias("new_start"), nl.alias("new_lines"),
                                F.size(added).alias("additions"), F.size(gone).alias("deletions"), F.array_join(rows, "\n").alias("content"))

            return tx.let(tx.lines(body), counted)

        return F.transform(hunks, of_hunk)

    return unnest_fields(outputs, [key], F.flatten(F.transform(files, of_file)))


def git_blame(outputs: DataFrame, key: str, output: str) -> DataFrame:
    """Content lines with the commit, author and time last seen before them."""
    item = "array<struct<line_number:int,commit:string,author:string,date:string,content:string>>"
    zero = F.struct(*[F.lit("").alias(n) for n in ("commit", "author", "date")], F.array().cast(item).alias("out"))

    def step(state, line):
        row = F.struct((F.size(state["out"]) + 1).alias("line_number"), state["commit"].alias("commit"), state["author"].alias("author"),
                       state["date"].alias("date"), F.substr(line, F.lit(2)).alias("content"))
        commit = line.rlike("^[0-9a-fA-F]{40}$")
        return F.struct(
            F.when(commit, F.substring(line, 1, 8)).otherwise(state["commit"]).alias("commit"),
            F.when(F.startswith(line, F.lit("author ")), F.substr(line, F.lit(8))).otherwise(state["author"]).alias("author"),
            F.when(F.startswith(line, F.lit("author-time ")), F.substr(line, F.lit(13))).otherwise(state["date"]).alias("date"),
            F.when(F.startswith(line, F.lit("\t")), F.array_append(state["out"], row)).otherwise(state["out"]).alias("out"))

    return unnest_fields(outputs, [key], F.aggregate(tx.lines(F.col(output)), zero, step)["out"])


def test_cases(runs: DataFrame, key: str, framework: str, output: str) -> DataFrame:
    """``(key, framework, name, status)`` of cargo, pytest and go runs; skipped pytest cases are kept with their status."""
    kind = F.col(framework)

    def case(line):
        cargo = F.startswith(line, F.lit("test ")) & line.rlike(r"^.* \.\.\. (ok|FAILED|ignored)")
        mark = F.regexp_extract(line, r" \.\.\. (\w+)", 1)

        def row(name, status):
            return F.struct(tx.trim(name).alias("name"), (F.lit(status) if isinstance(status, str) else status).alias("status"))

        cargo_row = row(F.regexp_replace(F.substring_index(line, " ... ", 1), "^(test )+", ""), first_match([(mark == "ok", "Passed"), (mark == "FAILED", "Failed"), (mark == "ignored", "Skipped")], "Error"))
        go_name = F.coalesce(F.try_element_at(tx.words(line), F.lit(3)), F.lit(""))
        return (F.when((kind == "cargo") & cargo, cargo_row)
                .when((kind == "pytest") & F.contains(line, F.lit("PASSED")), row(F.substring_index(line, "PASSED", 1), "Passed"))
                .when((kind == "pytest") & F.contains(line, F.lit("FAILED")), row(F.substring_index(line, "FAILED", 1), "Failed"))
                .when((kind == "pytest") & F.contains(line, F.lit("SKIPPED")), row(F.substring_index(line, "SKIPPED", 1), "Skipped"))
                .when((kind == "go") & F.startswith(line, F.lit("--- PASS:")), row(go_name, "Passed"))
                .when((kind == "go") & F.startswith(line, F.lit("--- FAIL:")), row(go_name, "Failed")))

    return unnest_fields(runs, [key, framework], F.array_compact(F.transform(tx.lines(F.col(output)), case)))


def test_summary(runs: DataFrame, key: str, framework: str, output: str) -> DataFrame:
    """Totals per run; jest runs carry their totals as JSON. Skipped pytest cases count as skipped, not in the total."""
    cases = test_cases(runs.filter(F.col(framework) != "jest"), key, framework, output)
    status = F.col("status")
    counted = cases.groupBy(key, framework).agg(
        F.count_if((status != "Skipped") | (F.col(framework) != "pytest")).alias("total"), F.count_if(status == "Passed").alias("passed"),
        F.count_if(status == "Failed").alias("failed"), F.count_if(status == "Skipped").alias("skipped"))
    j = F.from_json(output, "struct<numPassedTests:bigint,numFailedTests:bigint>")
    jest = runs.filter(F.col(framework) == "jest").select(key, framework, F.coalesce(j["numPassedTests"], F.lit(0)).alias("passed"), F.coalesce(j["numFailedTests"], F.lit(0)).alias("failed"))
    jest = jest.select(key, framework, (F.col("passed") + F.col("failed")).alias("total"), "passed", "failed", F.lit(0).cast("bigint").alias("skipped"))
    return counted.unionByName(jest).withColumn("success", F.col("failed") == 0)


def diagnostics(outputs: DataFrame, key: str, output: str) -> DataFrame:
    """``(key, level, message, file, line, column)`` of compiler output."""

    def of_line(line):
        low = F.lower(line)
        level = F.when(F.contains(low, F.lit("error")) & ~F.contains(low, F.lit("aborting")), "error").when(F.contains(low, F.lit("warning:")), "warning")
        split = F.contains(line, F.lit(": "))
        place = F.split(F.substring_index(line, ": ", 1), ":")
        located = split & (F.size(place) >= 2)
        message = F.when(split, tx.trim(F.substr(line, F.instr(line, ": ") + 2))).otherwise(line)
        return F.when(level.isNotNull(), F.struct(
            level.alias("level"), message.alias("message"), F.when(located, place[0]).alias("file"), F.when(located, F.try_element_at(place, F.lit(2)).try_cast("int")).alias("line"),
            F.when(located & (F.size(place) >= 3), F.try_element_at(place, F.lit(3)).try_cast("int")).alias("column")))

    return unnest_fields(outputs, [key], F.array_compact(F.transform(tx.lines(F.col(output)), of_line)))
