"""Rows out of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, items: Column | str, name: str = "_item") -> DataFrame:
    """One row per array element, none for an empty or null array.

    The plain generators make the optimizer infer a ``size(items) > 0`` filter and push it down, which works the whole
    array expression out a second time; the outer form does not, and its null row is dropped afterwards.
    """
    rows = df.select(*keep, F.explode_outer(items).alias(name))
    return rows.filter(F.col(name).isNotNull())


def worked_out(df: DataFrame, keep: list, value: Column, name: str) -> DataFrame:
    """``keep`` and one costly column, worked out once per row.

    A filter on a plain computed column is pushed below it and works it out again; it cannot pass a generator.
    """
    return df.select(*keep, F.explode_outer(F.array(value)).alias(name))


def unnest_fields(df: DataFrame, keep: list, items: Column | str) -> DataFrame:
    """As ``unnest`` for an array of structs, with the fields as columns."""
    rows = unnest(df, keep, items, "_item")
    kept = [c for c in rows.columns if c != "_item"]
    return rows.select(*kept, "_item.*")
