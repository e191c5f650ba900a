"""Inputs derived from the supplied tables.

The supplied tables hold prose and facts, not source code or tool output. Each entry below turns every row of a
supplied table into one such input with expressions that Spark and DuckDB read alike, so both engines see the same
rows and the work grows with the table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.tables import spread, table


def template(text: str) -> str:
    """SQL string expression for ``text``; ``<<expr>>`` is spliced in, newlines and the like become chr(n)."""
    parts = []
    for piece in re.split(r"(<<.*?>>|\n|'|\t|\r|\$)", text):
        if not piece:
            continue
        if piece.startswith("<<"):
            parts.append(f"CAST({piece[2:-2]} AS STRING)")
        elif piece in "\n'\t\r$":
            parts.append(f"chr({ord(piece)})")
        else:
            parts.append(f"'{piece}'")
    return "(" + " || ".join(parts) + ")" if parts else "''"


def choose(selector: str, options: list[str]) -> str:
    """One template per value of ``selector`` modulo the number of options."""
    arms = " ".join(f"WHEN {i} THEN {template(o)}" for i, o in enumerate(options))
    return f"(CASE ({selector}) % {len(options)} {arms} END)"


def repeated(text: str, times: str) -> str:
    return f"repeat({template(text)}, CAST({times} AS INT))"


_K = "p_partkey"

RUST_FILE = (
    template(
        """//! Unit <<p_partkey>>
use std::collections::HashMap;
use crate::mod<<(p_partkey + 4) % 37>>::unit_<<p_partkey + 4>>;
use super::shared;

/// Holds part <<p_partkey>>
/// of brand <<p_brand>>
pub struct Part<<p_partkey>> {
    size: i64, // field
}

/* block
   comment */
enum Kind<<p_partkey % 7>> { A, B }

/// Weighs a part.
pub fn weigh_<<p_partkey>>(a: i64, b: &str) -> Result<i64, String> {
    let mut total = 0;
"""
    )
    + " || "
    + repeated("    if a > <<p_size>> && total < 9 { total += 1; }\n", "p_size % 14")
    + " || "
    + repeated("    total += step(total);\n", "CASE WHEN p_partkey % 20 = 0 THEN 56 ELSE 1 END")
    + " || "
    + template(
        """    for i in 0..3 {
        match i { 1 => { total += 42; } _ => {} }
    }
    let v = lookup(b).unwrap();
    Ok(total + v)
}

impl Part<<p_partkey>> {
    fn size(&self) -> i64 { self.size }
}

trait Shape<<p_partkey % 3>>: Sized {
    fn area(&self) -> i64;
}

async fn load_<<p_partkey>>() {
    // TODO load <<p_name>>
    let x = 1;
}

#[test]
fn test_weigh_<<p_partkey - p_partkey % 3>>() {
    assert_eq!(weigh(1), 7);
}
"""
    )
)

PYTHON_FILE = (
    template(
        """\"\"\"Unit <<p_partkey>>.
Second line.
\"\"\"
import os
from .mod<<p_partkey % 37>> import helper

# FIXME sizes of <<p_brand>>
class Part<<p_partkey>>(Base):
    \"\"\"Box of <<p_name>>.\"\"\"
    def __init__(self, size):
        self.size = size

    def _weigh(self, a):
        \"\"\"Weighs
        things <<p_partkey>>.
        \"\"\"
        total = 0
"""
    )
    + " || "
    + repeated("        if a > <<p_size>>:\n            total = total + 1\n", "p_size % 9")
    + " || "
    + template(
        """        return total


async def load_<<p_partkey>>(path):
    while True:
        if path and os.path.exists(path):
            return helper(path)

limit_<<p_partkey>> = 3
"""
    )
)

SCRIPT_FILE = (
    template(
        """import { join } from 'path';
import local<<p_partkey>> from './mod<<p_partkey % 37>>';
const fs = require('fs');

/**
 * Weighs a part.
 * @param a value
 */
function weigh_<<p_partkey>>(a) {
  let total = 0;
"""
    )
    + " || "
    + repeated("  if (a > <<p_size>> || total === 3) { total += 1; }\n", "p_size % 8")
    + " || "
    + template(
        """  console.log(total);
  return total;
}

const twice = (x) => {
  return x ? x * 2 : 0;
};

class Box<<p_partkey>> {
  size() { return 1; }
}
"""
    )
)

FILE_NAMES = [
    "src/unit_<<p_partkey>>.rs", "lib/tool_<<p_partkey>>.py", "web/page_<<p_partkey>>.ts", "web/view.js", "README.md",
    "Cargo.toml", "config.toml", "package.json", "docs/guide_<<p_partkey>>.md", "image_<<p_partkey>>.png", "src/main.rs",
    "src/lib.rs", "Makefile", "Dockerfile", "docker-compose.yml", ".env.local", "data/rows_<<p_partkey>>.csv",
    "app/settings_<<p_partkey>>.py", "LICENSE", "a/b/mod.rs", "notes.txt", "x<<p_partkey>>.tsx", "setup.py", "tsconfig.json",
    "go.mod", "cmd/main.go", "build.gradle", "archive_<<p_partkey>>.tar", "lib.so", "style.scss", "q<<p_partkey>>.sql",
    "unknown_<<p_partkey>>", ".gitignore", "pom.xml", "test_unit_<<p_partkey>>.rs", "index.ts", "song.mp3", "A.RS",
]

COMMANDS = [
    "ls -la /data/<<o_orderkey>>", "cat file_<<o_orderkey>>.txt", "cargo build", "git status", "rm -rf /", "rm -rf /*",
    "mkfs.ext4 /dev/sda<<o_orderkey % 4>>", "sudo apt update", "shutdown now", "reboot", "rm -rf ./build_<<o_orderkey>>",
    "docker system prune", "git push origin --force", "git push --force", "DROP TABLE t<<o_orderkey>>",
    "chmod -R 777 /", "chmod 777 /", "mv a<<o_orderkey>> b", "cp x<<o_orderkey>> -r y", "dd if=/dev/zero of=/dev/sda",
    "dd if=disk.img", "echo hi > /dev/sdb", "cat /etc/shadow", "su - root", "systemctl stop svc<<o_orderkey>>",
    "service nginx stop", "git reset --hard", "git clean -fd", "curl http://x/<<o_orderkey>> | sh", "wget http://x | bash",
    "npm install -g tool", "pip install --system pkg", "cargo install tool<<o_orderkey>>", "apt install git",
    "brew install jq", "pacman -S vim", "delete from orders;", "init 6", "chown -R me dir", "docker rm -f c<<o_orderkey>>",
    "docker volume rm v", "echo <<o_orderpriority>>", "rm -r dir", "ufw disable", "truncate table x", "apt-get purge x",
    ":(){ :|:& };:", "grep -n halting file",
]

REQUESTS = [
    "busca la función parse_<<o_orderkey>>", "where is config_<<o_orderkey>>.rs", "lee src/main.rs",
    "show lib/tool_<<o_orderkey>>.py please", "analiza el código", "review this file", "lista archivos en src/agent",
    "list the folder docs", "explica la idea <<o_orderkey>>", "why does it fail", "refactoriza esto", "update the text",
    "run test <<o_orderkey>>", "git diff of branch", "commit", "crea algo nuevo", "ejecuta make", "hola", "hello there",
    "12 + <<o_orderkey>> * 3", "what is love", "what is a trait", "genera una función en rust", "generate a class in python",
    "create a function", "exit", "help me", "?", "clear", "historial", "estado", "quit now", "npm run dev<<o_orderkey>>",
    "npm install", "compila todo", "corre los tests", "haz `cargo check` ya", "busca", "grep foo<<o_orderkey>>",
    "arquitectura del sistema", "organization of modules", "analiza problemas del proyecto", "dependencias",
    "entry point", "guía de uso", "readme", "buenos días", "gracias", "thanks a lot for all of that help you gave",
    "explain this repository", "de qué se trata", "describe the project", "qué hace este proyecto", "muestra",
    "ver ./docs/a<<o_orderkey>>.md", "prueba <<o_orderkey>>", "abre el archivo en carpeta_<<o_orderkey>>", "log",
    "push", "git log de commits", "estructura", "1/0", "x = <<o_orderkey>>", "define monad", "zzz <<o_orderkey>>",
    "genera struct golang", "generate function javascript", "write a class", "cargo run", "save a/b/c<<o_orderkey>>",
]

ERRORS = [
    "Connection refused by host <<user_id>>", "request timed out after <<event_id>> ms", "Parse failure at line <<event_id>>",
    "Invalid token", "query too complex", "service unavailable", "file missing: <<event_id>>", "rate limit hit",
    "Too Many Requests", "something odd <<event_id>>", "model not available", "disk full",
]

PLANS = [
    """Plan for order <<o_orderkey>>
1. Analyze the code of order <<o_orderkey>>
2. Read the file list and find entries
- Write the new report for <<o_orderpriority>>
* Test and lint everything
Step 5: build and install the package
notes only
3. ok
4. Refactor the old and clean parts
- Document the readme""",
    """- Search the project index for <<o_orderkey>>
- Plan the layout
* Execute the shell command <<o_orderkey>>
Task review function <<o_orderkey>> class and git depend""",
    "No list here for <<o_orderkey>>",
    """1. Look around the directories of <<o_orderkey>>
2) Implement a create new thing
3. Fix it with many words a b c d e f g h i j k l m n o p q r s t u v w
-- Optimize the slow run""",
]

DIFFS = [
    """diff --git a/src/f<<o_orderkey>>.rs b/src/f<<o_orderkey>>.rs
index 1..2 100644
--- a/src/f<<o_orderkey>>.rs
+++ b/src/f<<o_orderkey>>.rs
@@ -1,3 +1,4 @@
 keep
-old <<o_orderkey>>
+new <<o_orderkey>>
+more
@@ -10 +11,2 @@
+tail
diff --git a/docs/g.md b/docs/g.md
@@ -5,2 +5 @@
-gone
-gone too <<o_orderpriority>>
+here""",
    """diff --git a/lib/h<<o_orderkey % 50>>.py b/lib/h<<o_orderkey % 50>>.py
@@ -0,0 +1,2 @@
+a
+b""",
    "nothing to see",
]

BLAMES = [
    """<<md5(CAST(o_orderkey AS STRING))>>01234567
author Ann <<o_custkey>>
author-time <<1700000000 + o_orderkey>>
\tfirst line <<o_orderkey>>
\tsecond line
<<md5(CAST(o_orderkey + 1 AS STRING))>>89abcdef
author Bob
\tthird line""",
    """<<md5(CAST(o_custkey AS STRING))>>00000000
author-time <<o_orderkey>>
\tonly line""",
]

STATUSES = [
    "M  src/a<<o_orderkey>>.rs", " M src/b<<o_orderkey>>.rs", "A  new<<o_orderkey>>.py", "MM both<<o_orderkey>>.ts", "D  gone<<o_orderkey>>",
    "?? draft<<o_orderkey>>.md", "R  moved<<o_orderkey>>", "C  copied<<o_orderkey>>", " D lost<<o_orderkey>>", "UU clash<<o_orderkey>>", "x",
]

BRANCHES = [
    """* main <<md5(CAST(s_suppkey AS STRING))>> last work
  feature/x<<s_suppkey>> 1a2b3c4 other
  remotes/origin/main 5d6e7f8 far""",
    "  only<<s_suppkey>>",
]

STREAM_LINES = [
    '{"model":"m","created_at":"t","message":{"role":"assistant","content":"w<<event_id>> "},"done":false}',
    '{"model":"m","created_at":"t","message":{"role":"assistant","content":"<think>"},"done":false}',
    '{"model":"m","created_at":"t","message":{"role":"assistant","content":"x<<value>>"},"done":true}',
    '{"model":"m","created_at":"t","message":{"role":"assistant","content":"</think>"},"done":false}',
    '{broken <<event_id>>', '', '{"model":"m","created_at":"t","message":{"role":"assistant","content":""},"done":false}',
]

PAGES = ["<<html>>", '{"page": <<page_id>>, "tags": ["a", "b"]}', "[1, <<page_id>>]", "not json {<<page_id>>}"]

TEST_RUNS = [
    """running 3 tests
test a::t<<p_partkey>> ... ok
test a::u<<p_partkey>> ... FAILED
test b::v ... ignored
test result: FAILED""",
    """tests/test_<<p_partkey>>.py::test_a PASSED
tests/test_<<p_partkey>>.py::test_b FAILED
tests/test_c.py::test_c SKIPPED
done""",
    """=== RUN Test<<p_partkey>>
--- PASS: Test<<p_partkey>> (0.00s)
--- FAIL: TestOther<<p_partkey>> (0.01s)
ok""",
    '{"numPassedTests": <<p_size>>, "numFailedTests": <<p_partkey % 3>>}',
]

COMPILER_RUNS = [
    """src/a<<p_partkey>>.rs:<<p_size>>:5: error: mismatched types
warning: unused variable
error: aborting due to 1 previous error""",
    """lib/b.rs:<<p_size>>: warning: odd name <<p_partkey>>
ERROR happened
all fine""",
]

REQUIREMENTS = [
    """# pinned
requests==2.28.<<p_size>>
flask>=2.0

numpy
django~=4.<<p_size>>
torch!=1.<<p_partkey % 9>>
pandas<<'<'>>3""",
    """fastapi<<'>'>>0.<<p_size>>
sqlalchemy<=2.0
-r other.txt""",
]

GO_MODS = [
    """module example.org/m<<s_suppkey>>

go 1.21

require (
\tgithub.com/a/b v1.<<s_suppkey>>.0
\tgithub.com/c/d v0.2.0 // indirect
)
require github.com/e/f v3.0.<<s_suppkey>>""",
    "module example.org/n<<s_suppkey>>",
]

CARGO_TOMLS = [
    """[package]
name = "p<<s_suppkey>>"
version = "0.1.0"

[lib]

[dependencies]
tokio = { version = "1.<<s_suppkey>>", features = ["full", "rt"] }
serde = "1.0"
fork = { git = "https://example.org/f<<s_suppkey>>.git", branch = "main" }
near = { path = "../near", optional = true }

[dev-dependencies]
axum = "0.7"
""",
    """[package]
name = "q<<s_suppkey>>"

[[bin]]
name = "q"

[dependencies]
clap = "4"
sqlx = { version = "0.<<s_suppkey>>" }
""",
]

PACKAGE_JSONS = [
    '{"name": "web<<s_suppkey>>", "version": "1.0.0", "dependencies": {"react": "^18.<<s_suppkey>>", "express": "4"}, "devDependencies": {"jest": "29"}}',
    '{"name": "tool<<s_suppkey>>", "dependencies": {"vue": "3"}}',
    '{"broken": ',
]

SNIPPET_FILES = [
    '{"For Loop <<p_partkey>>": {"prefix": "for", "body": ["for (;;) {", "  ${size}", "}"], "description": "loop"}}',
    '{"Print <<p_partkey>>": {"prefix": "pr", "body": "print(${name}, ${size}, ${other})"}}',
]

REPLIES = [
    "<<text>>", "I cannot do that. <<text>>", "No sé. <<text>>", "<tool_call>{\"name\": \"read_file\", \"arguments\": {\"path\": \"f<<conv_id>>.rs\"}}</tool_call> <<text>>",
    "<<text>> <tool_call>not json</tool_call> tail", "before <tool_call> {\"name\": \"git\", \"arguments\": {}} </tool_call> mid <tool_call>{\"name\": \"b\"}</tool_call> end <<turn>>",
    "TOOL: list_directory\nARGS: {\"path\": \"d<<conv_id>>\"}", "<think>plan <<turn>></think><<text>>", "this is UNCLEAR <<turn>>",
    "Error: failed <<turn>>", "sure {\"route\": \"DirectResponse\", \"confidence\": 0.9} ok", "{\"route\": \"ToolExecution\", \"confidence\": 0.<<turn % 9>>, \"mode\": \"Plan\"}",
    "{broken} <<turn>>", "/search foo<<conv_id>> bar", "/help",
]

# name -> (base table, {column: expression})
DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "src_files": ("part", {
        "file_id": _K,
        "path": f"(CASE p_partkey % 4 WHEN 0 THEN {template('src/mod<<p_partkey % 37>>/unit_<<p_partkey>>.rs')} "
                f"WHEN 1 THEN {template('lib/mod<<p_partkey % 37>>/unit_<<p_partkey>>.py')} "
                f"WHEN 2 THEN {template('web/unit_<<p_partkey>>.ts')} ELSE {template('web/unit_<<p_partkey>>.js')} END)",
        "language": "(CASE p_partkey % 4 WHEN 0 THEN 'Rust' WHEN 1 THEN 'Python' WHEN 2 THEN 'TypeScript' ELSE 'JavaScript' END)",
        "content": f"(CASE p_partkey % 4 WHEN 0 THEN {RUST_FILE} WHEN 1 THEN {PYTHON_FILE} ELSE {SCRIPT_FILE} END)",
    }),
    "file_paths": ("part", {"file_id": _K, "path": choose("p_partkey", FILE_NAMES), "size": "p_size * p_partkey * 97"}),
    "side_files": ("part", {"file_id": _K, "path": choose("p_partkey", [
        "tests/unit_<<p_partkey * 4 % 400>>_test.rs", "tests/test_unit_<<p_partkey % 90 * 4>>.rs", "src/mod<<p_partkey % 30>>/README.md", "tests/common.rs", "tests/nit_<<p_partkey>>.rs", "Cargo.toml"])}),
    "changes": ("part", {"path": f"(CASE p_partkey % 4 WHEN 0 THEN {template('src/mod<<p_partkey % 37>>/unit_<<p_partkey>>.rs')} ELSE {template('lib/mod<<p_partkey % 37>>/unit_<<p_partkey>>.py')} END)",
                         "line": "(CASE p_partkey % 9 WHEN 0 THEN 'M ' WHEN 1 THEN ' M' WHEN 2 THEN 'A ' WHEN 3 THEN 'D ' WHEN 4 THEN '??' WHEN 5 THEN 'UU' ELSE 'MM' END)", "nth": "p_partkey"}),
    "commands": ("orders", {"cmd_id": "o_orderkey", "command": choose("o_orderkey", COMMANDS)}),
    "requests": ("orders", {"req_id": "o_orderkey", "request": choose("o_orderkey", REQUESTS)}),
    "error_log": ("events", {"event_id": "event_id", "user_id": "user_id", "ts": "ts", "is_error": "(event_type = 'error')",
                             "message": choose("event_id", ERRORS)}),
    "task_plans": ("orders", {"plan_id": "o_orderkey", "analysis": choose("o_orderkey", PLANS)}),
    "git_diffs": ("orders", {"diff_id": "o_orderkey", "output": choose("o_orderkey", DIFFS)}),
    "git_blames": ("orders", {"blame_id": "o_orderkey", "output": choose("o_orderkey", BLAMES)}),
    "git_status": ("orders", {"row_id": "o_orderkey", "line": choose("o_orderkey", STATUSES)}),
    "git_log": ("orders", {"row_id": "o_orderkey", "line": template(
        "<<md5(CAST(o_orderkey AS STRING))>>|<<substr(md5(CAST(o_orderkey AS STRING)), 1, 7)>>|Ann <<o_custkey>>|a<<o_custkey>>@x.org|2024-01-0<<o_orderkey % 9 + 1>>|fix <<o_orderkey>>")
        + f" || (CASE WHEN o_orderkey % 3 = 0 THEN {template(' | with bar')} ELSE '' END)"}),
    "git_branches": ("supplier", {"row_id": "s_suppkey", "output": choose("s_suppkey", BRANCHES)}),
    "stream_lines": ("events", {"event_id": "event_id", "user_id": "user_id", "ts": "ts", "line": choose("event_id", STREAM_LINES)}),
    "responses": ("pages", {"page_id": "page_id", "url": "url", "body": choose("page_id", PAGES)}),
    "test_runs": ("part", {"run_id": _K, "framework": "(CASE p_partkey % 4 WHEN 0 THEN 'cargo' WHEN 1 THEN 'pytest' WHEN 2 THEN 'go' ELSE 'jest' END)",
                           "output": choose("p_partkey", TEST_RUNS)}),
    "compiler_runs": ("part", {"run_id": _K, "output": choose("p_partkey", COMPILER_RUNS)}),
    "requirements": ("part", {"project_id": _K, "content": choose("p_partkey", REQUIREMENTS)}),
    "go_mods": ("supplier", {"project_id": "s_suppkey", "content": choose("s_suppkey", GO_MODS)}),
    "cargo_tomls": ("supplier", {"project_id": "s_suppkey", "content": choose("s_suppkey", CARGO_TOMLS)}),
    "package_jsons": ("supplier", {"project_id": "s_suppkey", "content": choose("s_suppkey", PACKAGE_JSONS)}),
    "snippet_files": ("part", {"file_id": _K, "size": "p_size", "content": choose("p_partkey", SNIPPET_FILES)}),
    "replies": ("conversations", {"conv_id": "conv_id", "turn": "turn", "reply": choose("conv_id + turn", REPLIES)}),
}


# Inputs of row-local work heavy enough to be worth rebalancing.
COSTLY = {"src_files", "requests", "commands", "task_plans", "git_diffs", "git_blames", "error_log"}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = DERIVED[name]
    rows = table(spark, sf_dir, base).selectExpr(*[f"{expr} AS {col}" for col, expr in columns.items()])
    return spread(rows) if name in COSTLY else rows


def cte(*names: str) -> str:
    """``name AS (SELECT ...)`` text for the oracle, comma separated."""
    out = []
    for name in names:
        base, columns = DERIVED[name]
        cols = ", ".join(f"{expr} AS {col}" for col, expr in columns.items())
        out.append(f"{name} AS (SELECT {cols} FROM {base})")
    return ", ".join(out)
