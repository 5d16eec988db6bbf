"""Scalar and small linear-algebra functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_close(a: Column, b: Column, relative: float = 1e-8, absolute: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))


def outer(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, value) of the outer product of two vectors (i, value): its size is the product of theirs by definition."""
    one = left.select("i", F.col("value").alias("_a"))
    two = right.select(F.col("i").alias("j"), F.col("value").alias("_b"))
    return one.join(two, how="cross").select("i", "j", (F.col("_a") * F.col("_b")).alias("value"))


def trace(matrix: DataFrame) -> DataFrame:
    """The sum of the diagonal of a matrix (i, j, value)."""
    return matrix.filter("i = j").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("trace"))


def mode(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key, the smallest of equally frequent ones."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counted.groupBy(key).agg(F.max(F.struct("n", (-F.col(value)).alias("_v"))).alias("_best"))
    return best.select(key, (-F.col("_best._v")).alias(value), F.col("_best.n").alias("n"))
