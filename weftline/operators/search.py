"""Line search, replacement and file filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as tx
from weftline.operators.rows import unnest_fields


def search_pattern(needle: str, is_regex: bool = False, ignore_case: bool = False) -> str:
    return tx.unicode_regex(needle if is_regex else tx.regex_escape(needle), ignore_case)


def grep(df: DataFrame, key: str, text: str, pattern: str, context: int = 2) -> DataFrame:
    """One row per matching line with its context; works inside each row's line array, so no shuffle.

    ``match_start`` and ``match_end`` are byte offsets of the first match in the line.
    """
    lined = df.select(key, tx.lines(F.col(text)).alias("_lines"))

    def hit(line, at):
        before = F.slice(F.col("_lines"), F.greatest(at - context, F.lit(0)) + 1, F.least(at, F.lit(context)))
        return F.when(line.rlike(pattern), F.struct((at + 1).alias("line_number"), line.alias("line"), F.array_join(before, "\n").alias("context_before"),
                                                    F.array_join(F.slice(F.col("_lines"), at + 2, F.lit(context)), "\n").alias("context_after")))

    hits = F.filter(F.transform(F.col("_lines"), hit), lambda h: h.isNotNull())
    found = unnest_fields(lined, [key], hits)
    lead = F.octet_length(F.substr("line", F.lit(1), F.regexp_instr("line", F.lit(pattern)) - 1))
    return found.select("*", lead.alias("match_start"), (lead + F.octet_length(F.regexp_extract("line", pattern, 0))).alias("match_end"))


def replace_counted(text: Column, pattern: str, replacement: str) -> tuple[Column, Column]:
    """The replaced text (no group expansion) and how many replacements were made."""
    return F.regexp_replace(text, pattern, tx.literal_replacement(replacement)), F.regexp_count(text, F.lit(pattern)).cast("bigint")


def rename(df: DataFrame, key: str, text: str, old: str, new: str) -> DataFrame:
    """Changed lines of a whole-word rename."""
    pattern = tx.unicode_regex(rf"\b{tx.regex_escape(old)}\b")
    lined = F.transform(tx.lines(F.col(text)), lambda line, at: F.struct((at + 1).alias("line_number"), line.alias("old_text")))
    changed = unnest_fields(df, [key], F.filter(lined, lambda s: s["old_text"].rlike(pattern)))
    return changed.withColumn("new_text", F.regexp_replace("old_text", pattern, tx.literal_replacement(new)))


def glob_match(name: Column, pattern: str) -> Column:
    """``*.ext``, one star anywhere, else plain containment."""
    if pattern.startswith("*."):
        return F.endswith(name, F.lit(pattern[1:]))
    if pattern.count("*") == 1:
        head, tail = pattern.split("*")
        return F.startswith(name, F.lit(head)) & F.endswith(name, F.lit(tail))
    return F.contains(name, F.lit(pattern))


def searchable(path: Column) -> Column:
    return ~F.lower(tx.extension(path)).isin(fixed.UNSEARCHED_EXTENSIONS)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Hidden, or matched by an ignore pattern (``*.ext``, a file name, or a substring of the path)."""
    name = tx.file_name(path)
    out = F.startswith(name, F.lit("."))
    for p in patterns:
        out = out | ((tx.extension(path) == p[2:]) if p.startswith("*.") else ((name == p) | F.contains(path, F.lit(p))))
    return out


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def language(path: Column) -> Column:
    """By file name, then by extension; null without an extension."""
    ext = tx.extension(path)
    known = F.coalesce(_lookup(fixed.LANGUAGE_BY_NAME, tx.file_name(path)), _lookup(fixed.LANGUAGE_BY_EXTENSION, F.lower(ext)))
    return F.when(F.contains(F.substr(tx.file_name(path), F.lit(2)), F.lit(".")), known)


def file_type(path: Column, lang: Column) -> Column:
    name, ext = F.lower(tx.file_name(path)), F.lower(tx.extension(path))
    config = (
        F.endswith(name, F.lit(".conf")) | F.endswith(name, F.lit(".config")) | tx.contains_any(name, fixed.CONFIG_NAME_PARTS)
        | ext.isin(fixed.CONFIG_EXTENSIONS) | name.isin(".env", "dockerfile") | F.startswith(name, F.lit(".env."))
    )
    return (
        F.when(config, "Config").when(ext.isin(fixed.DOC_EXTENSIONS) | name.isin(fixed.DOC_NAMES), "Documentation")
        .when(ext.isin(fixed.DATA_EXTENSIONS), "Data").when(ext.isin(fixed.BINARY_EXTENSIONS), "Binary")
        .when(lang.isNotNull(), "Source").otherwise("Other")
    )


def is_key_file(path: Column) -> Column:
    lowered = F.lower(path)
    ends = F.lit(False)
    for e in fixed.KEY_FILE_ENDS:
        ends = ends | F.endswith(lowered, F.lit(e))
    return lowered.isin(fixed.KEY_FILES) | ends | tx.contains_any(lowered, fixed.KEY_FILE_PARTS)


def byte_cut(text: Column, limit: int, suffix: str) -> Column:
    """At most ``limit`` bytes, never through a character, plus ``suffix`` when something was cut."""
    heads = [F.substring(text.cast("binary"), 1, limit - back).cast("string") for back in range(4)]
    cut = F.coalesce(*[F.when(F.is_valid_utf8(h), h) for h in heads])
    return F.when(F.octet_length(text) > limit, F.concat(cut, F.lit(suffix))).otherwise(text)
