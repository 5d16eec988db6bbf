"""The public entry points: a Parquet edge list in, statistics or Parquet out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import graph, leiden, partitions, statistics
from loomgraph.operators.label_propagation import fast_label_propagation
from loomgraph.plans import hybrid
from loomgraph.sources import edges as sources


@dataclass(frozen=True)
class GraphProperties:
    """A graph's connectivity, collected from its one-row summary."""

    node_count: int
    edge_weight_sum: int
    n_connected_components: int
    fraction_in_largest_component: float | None
    stranded_nodes: int
    component_size_distribution: dict[int, int]

    @classmethod
    def of(cls, summary: DataFrame) -> GraphProperties:
        return cls(**summary.first().asDict())


def _edges(spark: SparkSession, path: str) -> DataFrame:
    return graph.canonical_edges(sources.narrow_ids(sources.read_edges(spark, path)))


def find_graph_statistics(spark: SparkSession, parquet_file: str) -> tuple[int, int, int, float | None]:
    """Nodes, sum of edge weights, connected components, share of nodes in the largest."""
    p = GraphProperties.of(statistics.graph_properties(_edges(spark, parquet_file)))
    return p.node_count, p.edge_weight_sum, p.n_connected_components, p.fraction_in_largest_component


def run_label_propagation(spark: SparkSession, parquet_file: str, epochs: int = 1, output: str = "node_partitions.parquet", seed: int = 0) -> int:
    """The number of partitions; they are written as (umi, partition_id)."""
    labels = fast_label_propagation(_edges(spark, parquet_file), epochs=epochs, seed=seed)
    sources.write_partitions(partitions.normalize(labels), output)
    return partitions.num_partitions(labels).first()[0]


def run_leiden(
    spark: SparkSession, parquet_file: str, resolution: float, max_iteration: int | None = None, partition: DataFrame | None = None, output: str = "node_partitions.parquet",
    randomness: float = 0.1, seed: int | None = None, merge_edge_threshold: int | None = None, merge_edge_threshold_relative: float | None = None,
) -> tuple[int, float]:
    """The number of partitions and Q; ``partition(umi, partition_id)`` is where it starts, and has to cover every node."""
    if merge_edge_threshold is not None and merge_edge_threshold_relative is not None:
        raise ValueError("give merge_edge_threshold or merge_edge_threshold_relative, not both")
    first = None if partition is None else partition.select(F.col("umi").alias("id"), F.col("partition_id").alias("pid"))
    level = leiden.start(_edges(spark, parquet_file), resolution, labels=first, seed=seed or 0)
    level = leiden.leiden(level, randomness, max_iteration, merge_edge_threshold, merge_edge_threshold_relative)
    labels = level.labels()
    sources.write_partitions(partitions.normalize(labels), output)
    return partitions.num_partitions(labels).first()[0], level.quality()


def run_hybrid_community_detection(
    spark: SparkSession, parquet_file: str, resolution: float, multiplet_recovery: bool, output: str = "filtered_edge_list.parquet", flp_epochs: int = 1,
    randomness: float = 0.1, seed: int | None = None, max_iteration: int | None = None,
) -> tuple[str, GraphProperties, GraphProperties, GraphProperties]:
    """The path written and the graph's properties before, after label propagation and at the end.

    The output has the input's rows whose ends are in one community, all columns, and ``component``.
    """
    raw = sources.narrow_ids(sources.read_edges(spark, parquet_file))
    found = hybrid.detect(graph.canonical_edges(raw), resolution, multiplet_recovery, flp_epochs, randomness, seed or 0, max_iteration)
    sources.filter_crossing_edges(raw, partitions.normalize(found.labels)).write.mode("overwrite").parquet(output)
    return output, *(GraphProperties.of(s) for s in (found.before, found.after_propagation, found.after_recovery))
