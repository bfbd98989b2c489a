"""Top-k shapes that keep every shuffle and every group bounded by k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded(name: str, value: int, high: int, low: int = 1) -> int:
    """``value`` if it lies in the allowed range, else ``ValueError``."""
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in {low}..{high}, got {value}")
    return value


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of every group with their rank.

    The rank filter lets Catalyst cut every group to k rows before the shuffle, so a group
    that holds a third of all rows sends at most k rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_rows(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """Ordered rows, cut to ``limit`` when one is given."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)
