"""Joins whose keys may hold very many rows: heavy keys are counted and split from the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 10_000
LEAST = 50_000


def join_counted(rows: DataFrame, table: DataFrame, on: str | list[str], count: str, total: int, how: str = "inner", least: int = LEAST, most: int | None = None) -> DataFrame:
    """``rows.join(table, on)`` where ``table`` says in ``count`` how many of the ``total`` rows each of its keys has.

    Keys of more than ``least`` rows and more than a ``SHARE``-th of all are at most ``SHARE`` keys, whatever the data, so
    they are broadcast and their rows stay where they are; the rest is joined by shuffle. So are rows of any key where there
    are no more than eight times ``least``, or where ``most``, the largest count if it is known, is none of a heavy key. ``how`` is inner or left.
    """
    if total <= 8 * least or (most is not None and most <= max(total // SHARE, least)):
        return rows.join(table, on, how).drop(count)
    hot = F.col(count) > max(total // SHARE, least)
    few, keys = F.broadcast(table.filter(hot)), [on] if isinstance(on, str) else on
    far = rows.join(F.broadcast(table.filter(hot).select(*keys)), on, "left_anti").join(table.filter(~hot), on, how)
    return rows.join(few, on).unionByName(far).drop(count)
