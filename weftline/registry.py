"""Name -> query registry: the extension point for adding operators."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

PLAN_MODULES = (
    "weftline.plans.metrics",
    "weftline.plans.relational",
    "weftline.plans.rules",
    "weftline.plans.text",
    "weftline.plans.code",
    "weftline.plans.parsers",
    "weftline.plans.vectors",
    "weftline.plans.context",
    "weftline.plans.streams",
    "weftline.plans.indexing",
    "weftline.plans.event_time",
    "weftline.plans.ordered",
)


@dataclass(frozen=True)
class Query:
    name: str
    ops: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(name: str, ops: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``ops`` lists the survey operator ids the query covers, blank-separated.
    """

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = Query(name, tuple(ops.split()), fn, sql)
        return fn

    return add


def load_plans() -> None:
    for module in PLAN_MODULES:
        if importlib.util.find_spec(module):
            importlib.import_module(module)


def all_queries() -> dict[str, Query]:
    load_plans()
    return dict(_QUERIES)
