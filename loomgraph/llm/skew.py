"""Joins whose keys may hold very many rows, as the graph library has them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomgraph.operators import skew
from loomgraph.operators.skew import LEAST, SHARE

__all__ = ["LEAST", "SHARE", "join_counted"]


def join_counted(rows: DataFrame, table: DataFrame, on: str | list[str], count: str, total: int, least: int = LEAST, how: str = "inner") -> DataFrame:
    """``skew.join_counted`` with ``least`` in its earlier place."""
    return skew.join_counted(rows, table, on, count, total, how, least)
