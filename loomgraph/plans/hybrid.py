"""Hybrid community detection: label propagation, contraction, optional Leiden, crossing edges removed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from loomgraph.functions import quality
from loomgraph.operators import leiden, statistics
from loomgraph.operators.label_propagation import fast_label_propagation
from loomgraph.sessions import cut, sparing


@dataclass(frozen=True)
class Hybrid:
    """Labels of the original vertices, and statistics before, after label propagation, and at the end; Q at these two."""

    labels: DataFrame
    before: DataFrame
    after_propagation: DataFrame
    after_recovery: DataFrame
    propagated: DataFrame
    recovered: DataFrame


@sparing
def detect(edges: DataFrame, gamma: float, recover: bool, epochs: int = 1, randomness: float = 0.1, seed: int = 0, max_iteration: int | None = None, refined: bool = False, objective: quality.Objective = quality.MODULARITY) -> Hybrid:
    """``recover`` runs Leiden on the contracted graph; ``refined`` contracts by refined parts of the propagated labels."""
    edges = cut(edges, "edges")
    before = statistics.graph_properties(edges)
    labels = fast_label_propagation(edges, epochs=epochs, seed=seed)
    level = leiden.start(edges, gamma, objective, labels, seed=seed)
    level = leiden.aggregate(level, leiden.refine(level, randomness) if refined else None)
    middle = statistics.partitioned_statistics(level.edges, level.nodes, level.g, level.labels())
    if recover:
        level = leiden.leiden(level, randomness, max_iteration)
    own = cut(level.labels(), "labels")
    end = statistics.partitioned_statistics(level.edges, level.nodes, level.g, own)
    return Hybrid(own, before, statistics.as_if_cut(middle), statistics.as_if_cut(end), middle.select("quality"), end.select("quality"))
