"""Partitions of vertices: tables ``labels(id, pid)`` with one row for each vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.operators.skew import join_counted
from loomgraph.sessions import cut


def singlets(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.col("id").alias("pid"))


def null_partition(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.lit(0).cast("long").alias("pid"))


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("pid").agg(F.count("*").alias("size"))


def num_partitions(labels: DataFrame) -> DataFrame:
    return sizes(labels).agg(F.count("*").alias("n_partitions"))


def largest_size(labels: DataFrame) -> DataFrame:
    return sizes(labels).agg(F.max("size").alias("size"))


def top_k(labels: DataFrame, k: int) -> DataFrame:
    """The k largest partitions, the smaller pid first among equal ones: the k of each task meet in one."""
    return sizes(labels).orderBy(F.desc("size"), "pid").limit(k)


def members(labels: DataFrame, pid: int) -> DataFrame:
    """The reverse map of one partition, as rows: a partition may be too large for one value."""
    return labels.filter(F.col("pid") == pid).select("id")


def is_singlet(labels: DataFrame, pid: int) -> DataFrame:
    return labels.filter(F.col("pid") == pid).agg((F.count("*") == 1).alias("is_singlet"))


def update(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """``labels`` with the pids of ``changes(id, pid)``."""
    new = changes.select("id", F.col("pid").alias("_new"))
    return labels.join(new, "id", "left").select("id", F.coalesce("_new", "pid").alias("pid"))


def fresh_ids(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """An unused pid for each of ``ids``: the largest one in use plus its rank."""
    top = labels.agg(F.coalesce(F.max("pid"), F.lit(-1)).alias("_top"))
    return dense_ids(ids.select("id"), "id", "_rank").join(top).select("id", (F.col("_top") + 1 + F.col("_rank")).alias("pid"))


def dense_ids(rows: DataFrame, key: str, into: str) -> DataFrame:
    """Consecutive numbers from 0 by ascending ``key`` without a global sort task.

    Rows are range-partitioned and numbered in their partition; the counts of partitions, as many as there
    are partitions, give each its offset.
    """
    dealt = cut(rows.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_before")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return dealt.withColumn(into, place.cast("long")).join(F.broadcast(offsets), "_part").withColumn(into, F.col(into) + F.col("_before")).drop("_part", "_before")


def canonical(labels: DataFrame) -> DataFrame:
    """Each pid replaced by the smallest id in it."""
    least = labels.groupBy("pid").agg(F.min("id").alias("_least"), F.count("*").alias("_n"))
    return join_counted(labels, least, "pid", "_n", labels.count()).select("id", F.col("_least").alias("pid"))


def normalize(labels: DataFrame) -> DataFrame:
    """Pids 0 .. k-1 in the order of their smallest member."""
    least = labels.groupBy("pid").agg(F.min("id").alias("_least"), F.count("*").alias("_n"))
    numbered = dense_ids(least, "_least", "_new").select("pid", "_n", "_new")
    return join_counted(labels, numbered, "pid", "_n", labels.count()).select("id", F.col("_new").alias("pid"))


def is_normalized(labels: DataFrame) -> DataFrame:
    """One row; true for an empty table."""
    return sizes(labels).agg(F.coalesce(F.max("pid") + 1 == F.count("*"), F.lit(True)).alias("is_normalized"))


def matrix(labels: DataFrame) -> DataFrame:
    """The 0/1 matrix of normalised labels as coordinates: row pid, column id."""
    return labels.select("pid", "id", F.lit(1.0).alias("value"))


def inside(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges that don't leave a label."""
    one = labels.select(F.col("id").alias("src"), F.col("pid").alias("_one"))
    two = labels.select(F.col("id").alias("dst"), F.col("pid").alias("_two"))
    return edges.join(one, "src").join(two, "dst").filter("_one = _two").select(*edges.columns)


def split_inside(inner: DataFrame, labels: DataFrame) -> DataFrame:
    """``split_disconnected`` where ``inner`` has no edges but those inside labels."""
    return connected_components(inner.select("src", "dst"), labels.select("id")).select("id", F.col("component").alias("pid"))


def split_disconnected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Components within labels: each connected part of a label becomes one, named by its smallest id."""
    return split_inside(inside(edges, labels), labels)
