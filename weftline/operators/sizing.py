"""Broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut_lineage

BROADCAST_ROWS = 50_000


def stored_and_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    stored = cut_lineage(df, label)
    return stored, stored.count()


def small_or_shuffled(df: DataFrame, label: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write ``df`` once, count it, and mark it for broadcast only when it is small.

    Beyond ``max_rows`` the join stays a shuffle join, which AQE may split on skew.
    """
    stored, rows = stored_and_counted(df, label)
    return F.broadcast(stored) if rows <= max_rows else stored
