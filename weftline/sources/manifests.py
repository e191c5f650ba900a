"""Manifests, snippet files and other small structured texts."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as tx
from weftline.operators.rows import unnest_fields


def imported_snippets(files: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Editor snippet maps ``{name: {body: text or list, description}}`` as rows."""
    entries = F.from_json(F.col(content), "map<string,struct<body:string,description:string>>")
    rows = files.select(*keep, F.explode(entries).alias("name", "_s"))
    listed = F.from_json("_s.body", "array<string>")
    code = F.when(F.startswith("_s.body", F.lit("[")) & listed.isNotNull(), F.array_join(listed, "\n")).otherwise(F.col("_s.body"))
    return rows.select(*keep, F.translate(F.lower("name"), " ", "-").alias("snippet_id"), "name",
                       F.coalesce("_s.description", F.lit("")).alias("description"), code.alias("code"))


def expand(code: Column, placeholders: list[str], values: Column, defaults: Column) -> Column:
    """Replace each ``${name}`` by its value, else its default, else nothing."""
    for name in placeholders:
        value = F.coalesce(F.element_at(values, F.lit(name)), F.element_at(defaults, F.lit(name)), F.lit(""))
        code = F.replace(code, F.lit("${" + name + "}"), value)
    return code


def requirement(line: Column) -> Column:
    """``struct(name, version)`` of a requirement line; the first operator in list order that occurs splits it."""
    out = F.struct(line.alias("name"), F.lit("*").alias("version"))
    for op in reversed(fixed.REQUIREMENT_OPERATORS):
        at = F.instr(line, op)
        out = F.when(at > 0, F.struct(tx.trim(F.substr(line, F.lit(1), at - 1)).alias("name"), F.substr(line, at).alias("version"))).otherwise(out)
    return out


def requirements(files: DataFrame, key: str, content: str) -> DataFrame:
    """``(key, name, version)`` of requirement files; blank and comment lines are skipped."""
    kept = F.filter(F.transform(tx.lines(F.col(content)), tx.trim), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return unnest_fields(files, [key], F.transform(kept, requirement))


def go_requires(files: DataFrame, key: str, content: str) -> DataFrame:
    """``(key, name, version)`` of single and block requires."""
    item = "array<struct<name:string,version:string>>"
    zero = F.struct(F.lit(False).alias("inside"), F.array().cast(item).alias("out"))

    def step(state, line):
        opens, closes = F.startswith(line, F.lit("require (")), line == ")"
        parts = tx.words(F.regexp_replace(line, "^(require )+", ""))
        row = F.struct(F.try_element_at(parts, F.lit(1)).alias("name"), F.try_element_at(parts, F.lit(2)).alias("version"))
        hit = ~opens & ~closes & (state["inside"] | F.startswith(line, F.lit("require "))) & (F.size(parts) >= 2)
        return F.struct(F.when(opens, True).when(closes, False).otherwise(state["inside"]).alias("inside"), F.when(hit, F.array_append(state["out"], row)).otherwise(state["out"]).alias("out"))

    return unnest_fields(files, [key], F.aggregate(F.transform(tx.lines(F.col(content)), tx.trim), zero, step)["out"])


def package_dependencies(files: DataFrame, key: str, content: str) -> DataFrame:
    """``(key, name, version, is_dev)`` of package.json files; broken files give nothing."""
    parsed = F.from_json(F.col(content), "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")

    def entries(part, dev):
        rows = F.transform(F.map_entries(parsed[part]), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(dev).alias("is_dev")))
        return F.coalesce(rows, F.array().cast("array<struct<name:string,version:string,is_dev:boolean>>"))

    return unnest_fields(files, [key], F.concat(entries("dependencies", False), entries("devDependencies", True)))


CARGO_DEPENDENCY = "array<struct<name:string,version:string,is_dev:boolean,is_optional:boolean,features:string,source:string,location:string>>"


def cargo_rows(content: str) -> list[dict]:
    """Dependencies of one Cargo.toml; nothing when it is not valid TOML."""
    try:
        doc = tomllib.loads(content)
    except tomllib.TOMLDecodeError:
        return []
    out = []
    for section, dev in (("dependencies", False), ("dev-dependencies", True)):
        for name, spec in doc.get(section, {}).items():
            table = spec if isinstance(spec, dict) else {"version": spec if isinstance(spec, str) else "*"}
            source, place = "Registry", "crates.io"
            if "git" in table:
                source, place = "Git", table["git"]
            elif "path" in table:
                source, place = "Path", table["path"]
            out.append({"name": name, "version": table.get("version", "*"), "is_dev": dev, "is_optional": bool(table.get("optional", False)),
                        "features": ",".join(table.get("features", [])), "source": source, "location": place})
    return out


def cargo_dependencies(files: DataFrame, key: str, content: str) -> DataFrame:
    @F.pandas_udf(CARGO_DEPENDENCY)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cargo_rows(t or ""))

    return unnest_fields(files, [key], parse(F.col(content)))


def frameworks(content: Column, checks: dict[str, str], ignore_case: bool = False) -> Column:
    """Names whose substring occurs in a manifest, in list order."""
    text = F.lower(content) if ignore_case else content
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in checks.items()]))


def rust_project_type(content: Column) -> Column:
    has = lambda *ws: tx.contains_any(content, ws)
    return (F.when(has("[[bin]]", "[bin]") & has("clap", "structopt"), "Cli").when(has("[[bin]]", "[bin]"), "Binary").when(has("[lib]"), "Library")
            .when(has("actix", "axum", "rocket"), "Api").otherwise("Unknown"))


def script_project_type(content: Column) -> Column:
    has = lambda *ws: tx.contains_any(content, ws)
    return F.when(has("next", "nuxt", "react"), "WebApp").when(has("express", "fastify", "koa"), "Api").otherwise("Unknown")
