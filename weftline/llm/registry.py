"""Queries of this subpackage: name -> (function, SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "katz", "sharding", "packing", "suffix_dedup", "simhash", "divergence", "decontamination", "classifier", "substring_dedup", "huffman",
    "whitening", "prefixes", "winnowing",
)

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def llm_query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def llm_queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    for module in MODULES:
        importlib.import_module(f"weftline.llm.{module}")
    return dict(QUERIES)
