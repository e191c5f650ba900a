"""String functions shared by the operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space and word characters as regex classes both Java and RE2 accept.
WS = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{M}\p{N}_]"
_SPACES = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS_CHARS = "".join(map(chr, _SPACES))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    """Lines without their terminators; a final newline adds no empty line, empty text has none."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def trim(text: Column) -> Column:
    """Trim all Unicode white space (Spark's own trim removes blanks only)."""
    return F.btrim(text, F.lit(WS_CHARS))


def words(text: Column) -> Column:
    """White-space separated words, none empty."""
    return F.array_remove(F.split(text, f"{WS}+"), "")


def normalise(text: Column) -> Column:
    """Lower-case with white space collapsed to single blanks."""
    return F.array_join(words(F.lower(text)), " ")


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping, case-sensitive occurrences of a literal."""
    shrunk = F.octet_length(F.replace(text, F.lit(needle), F.lit("")))
    return ((F.octet_length(text) - shrunk) / F.lit(len(needle.encode()))).cast("bigint")


def contains_any(text: Column, needles) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found


def starts_with_any(text: Column, heads) -> Column:
    found = F.lit(False)
    for head in heads:
        found = found | F.startswith(text, F.lit(head))
    return found


def matches_any(text: Column, patterns) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | text.rlike(pattern)
    return found


def unicode_regex(pattern: str, ignore_case: bool = False) -> str:
    """A pattern whose classes and boundaries know Unicode and whose final ``$`` is the very end."""
    if pattern.endswith("$"):
        pattern = pattern[:-1] + r"\z"
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def regex_escape(literal: str) -> str:
    """Escape so that both Java and RE2 read the text literally."""
    return "".join("\\" + c if c in r"\.+*?()|[]{}^$#&-~" else c for c in literal)


def literal_replacement(text: str) -> str:
    """A replacement string with no group expansion."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _fold_table() -> tuple[str, str]:
    # Rule: every Latin letter whose canonical decomposition is one base letter plus marks.
    source, target = [], []
    for code in range(0xC0, 0x250):
        char = chr(code)
        base = [c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != char:
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()


def fold(text: Column) -> Column:
    """Lower-case and strip Latin diacritics, as a full-text tokenizer does."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def terms(text: Column) -> Column:
    """Folded full-text terms: maximal runs of letters and digits."""
    return F.array_remove(F.split(fold(text), r"[^\p{L}\p{N}]+"), "")


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def token_estimate(text: Column) -> Column:
    """One token per four bytes, at least one."""
    return F.greatest(F.floor(F.octet_length(text) / 4), F.lit(1)).cast("bigint")


def fixed(n: Column, digits: int) -> Column:
    """Fixed decimals, exact ties to even."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", n.cast("double"), F.lit(pattern))


def format_size(n: Column) -> Column:
    """Bytes as GB, MB, KB with two decimals, or plain bytes."""
    kb, mb, gb = 1024, 1024**2, 1024**3
    return (
        F.when(n >= gb, F.concat(fixed(n / gb, 2), F.lit(" GB")))
        .when(n >= mb, F.concat(fixed(n / mb, 2), F.lit(" MB")))
        .when(n >= kb, F.concat(fixed(n / kb, 2), F.lit(" KB")))
        .otherwise(F.concat(n.cast("bigint").cast("string"), F.lit(" bytes")))
    )


def format_bytes(n: Column) -> Column:
    """Bytes in the largest unit from B to PB, two decimals above bytes."""
    out = F.concat(n.cast("bigint").cast("string"), F.lit(" B"))
    for power, unit in enumerate(["KB", "MB", "GB", "TB", "PB"], start=1):
        out = F.when(n >= 1024**power, F.concat(fixed(n / float(1024**power), 2), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_count(n: Column) -> Column:
    """1.2k and 3.4M style counts."""
    return (
        F.when(n >= 1_000_000, F.concat(fixed(n / 1e6, 1), F.lit("M")))
        .when(n >= 1_000, F.concat(fixed(n / 1e3, 1), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; empty without one or for dot files."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
