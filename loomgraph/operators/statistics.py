"""One-row summaries of a graph's connectivity and of a partition of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import quality
from loomgraph.operators import graph, partitions
from loomgraph.operators.components import connected_components

STRANDED_BELOW = 8000


def size_distribution(sizes: DataFrame) -> DataFrame:
    """(size, count): how many sets have each size. Distinct sizes number about the root of twice the vertices at most."""
    return sizes.groupBy("size").agg(F.count("*").alias("count"))


def _summary(sizes: DataFrame, stranded_below: int) -> DataFrame:
    spread = size_distribution(sizes)
    entries = F.array_sort(F.collect_list(F.struct("size", "count")))
    n = F.coalesce(F.sum(F.col("size") * F.col("count")), F.lit(0)).cast("long")
    return spread.agg(
        n.alias("node_count"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("n_sets"),
        (F.max("size") / F.nullif(n, F.lit(0))).alias("largest"),
        F.coalesce(F.sum(F.when(F.col("size") < stranded_below, F.col("size") * F.col("count"))), F.lit(0)).cast("long").alias("stranded_nodes"),
        F.map_from_entries(entries).alias("distribution"),
    )


def graph_properties(edges: DataFrame, ids: DataFrame | None = None, stranded_below: int = STRANDED_BELOW) -> DataFrame:
    """Nodes, weight, components, share in the largest (null without nodes), nodes in small ones, size distribution."""
    found = connected_components(edges, graph.vertices(edges) if ids is None else ids)
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    weight = graph.totals(edges).select(F.col("total_edge_weight").alias("edge_weight_sum"))
    return _summary(sizes, stranded_below).join(weight).select(
        "node_count", "edge_weight_sum", F.col("n_sets").alias("n_connected_components"), F.col("largest").alias("fraction_in_largest_component"),
        "stranded_nodes", F.col("distribution").alias("component_size_distribution"),
    )


def crossing_weight(edges: DataFrame, labels: DataFrame) -> DataFrame:
    one = labels.select(F.col("id").alias("src"), F.col("pid").alias("_one"))
    two = labels.select(F.col("id").alias("dst"), F.col("pid").alias("_two"))
    return edges.join(one, "src").join(two, "dst").agg(F.coalesce(F.sum(F.when(F.col("_one") != F.col("_two"), F.col("weight"))), F.lit(0)).cast("long").alias("crossing_edge_weight"))


def partitioned_statistics(edges: DataFrame, nodes: DataFrame, g: float, labels: DataFrame | None = None, stranded_below: int = STRANDED_BELOW) -> DataFrame:
    """The same of ``nodes(id, weight, pid)``, with the weight between partitions and Q.

    ``labels`` are those of the original vertices where ``nodes`` are a contracted graph.
    """
    own = nodes.select("id", "pid") if labels is None else labels
    sizes = partitions.sizes(own)
    weight = graph.totals(edges).select("total_edge_weight")
    return _summary(sizes, stranded_below).join(weight).join(crossing_weight(edges, nodes.select("id", "pid"))).join(quality.quality(edges, nodes, g)).select(
        "node_count", F.col("total_edge_weight").alias("edge_weight_sum"), "crossing_edge_weight", F.col("n_sets").alias("n_partitions"),
        F.col("largest").alias("fraction_in_largest_partition"), "stranded_nodes", F.col("distribution").alias("partition_size_distribution"), "quality",
    )


def as_if_cut(stats: DataFrame) -> DataFrame:
    """Partition statistics as graph properties once crossing edges are gone."""
    return stats.select(
        "node_count", (F.col("edge_weight_sum") - F.col("crossing_edge_weight")).alias("edge_weight_sum"), F.col("n_partitions").alias("n_connected_components"),
        F.col("fraction_in_largest_partition").alias("fraction_in_largest_component"), "stranded_nodes", F.col("partition_size_distribution").alias("component_size_distribution"),
    )


def distribution_text(distribution: Column) -> Column:
    """``size:count`` by size, comma-joined."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(distribution)), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
