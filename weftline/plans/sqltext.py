"""Pieces of oracle SQL."""

from __future__ import annotations


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_contains(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def any_starts(col: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({col}, {q(w)})" for w in words) + ")"


def any_matches(col: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {q(p)})" for p in patterns) + ")"


def cases(arms, default="NULL") -> str:
    """CASE over (condition, value expression) pairs."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms) + f" ELSE {default} END"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def rank_at(order: str, p: float, n: str = "n") -> str:
    """Row filter picking the nearest-rank sample from a 1-based ``rn``."""
    return f"rn = least(CAST(floor({n} * CAST({p} AS DOUBLE)) AS BIGINT), {n} - 1) + 1"
