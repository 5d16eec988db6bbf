"""Leiden community detection in tasks and distributed rounds.

A level is local moving (``moving``), refinement (``refining``) and contraction. Q never falls, and no component
or community is gathered in a task. All draws hang on ids and seed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import quality
from loomgraph.operators import blocks, graph, moving, partitions, refining
from loomgraph.operators.components import connected_components
from loomgraph.sessions import cut, is_cut, sparing, together

#: A safety limit: the loop ends where nothing is left to do, and raises if it gets this far.
LEVELS = 1_000


@dataclass(frozen=True)
class Level:
    """Level state: edges(src, dst, weight), nodes(id, weight, pid), ancestor(orig, id), scaled resolution and seed.

    ``apart(id, block)`` are blocks that neither edges nor communities connect, where the graph is too large to be one (``blocks``).
    """

    edges: DataFrame
    nodes: DataFrame
    ancestor: DataFrame
    g: float
    seed: int = 0
    number: int = 0
    apart: DataFrame | None = None

    def labels(self) -> DataFrame:
        """(id, pid) of the original vertices."""
        return self.ancestor.join(self.nodes.select("id", "pid"), "id").select(F.col("orig").alias("id"), "pid")

    def quality(self) -> float:
        return float(quality.quality(self.edges, self.nodes, self.g).first()[0])


@sparing
def start(edges: DataFrame, gamma: float, objective: quality.Objective = quality.MODULARITY, labels: DataFrame | None = None, ids: DataFrame | None = None, seed: int = 0) -> Level:
    """The first level, from singlets or from ``labels``, which have to name every vertex once."""
    edges = edges if is_cut(edges) else cut(edges, "edges")
    ids = cut(graph.vertices(edges) if ids is None else ids, "vertices")
    g = objective.scaled(gamma, graph.totals(edges).first()["total_edge_weight"])
    own = partitions.singlets(ids) if labels is None else cut(partitions.canonical(labels if is_cut(labels) else cut(labels.select("id", "pid"), "labels")), "canonical")
    if labels is not None and not ids.join(own, "id", "left_anti").isEmpty():
        raise ValueError("the partition doesn't cover every vertex")
    if labels is not None and not own.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("the partition has vertices more than once")
    nodes = objective.node_sizes(edges, ids).join(own, "id").select("id", "weight", "pid")
    return Level(edges, cut(nodes, "nodes"), ids.select(F.col("id").alias("orig"), "id"), g, seed)


def move_nodes(level: Level, rounds: int = moving.ROUNDS, thorough: bool = False) -> tuple[Level, float]:
    """The level after rounds of moves until the frontier is empty, or ``thorough`` until no move gains, and what they have added to Q."""
    if level.apart is None and level.edges.count() + level.nodes.count() > blocks.WITHIN:
        level = replace(level, apart=cut(blocks.apart(level.edges, level.nodes), "apart"))
    nodes, added = moving.settle(level.edges, level.nodes, level.g, level.seed, rounds, thorough, apart=level.apart)
    return replace(level, nodes=nodes), added


def refine(level: Level, randomness: float = 0.1, rounds: int = refining.ROUNDS) -> DataFrame:
    """(id, refined): well-connected singletons merged into well-connected parts of their community, named by the smallest id."""
    return refining.refine(level.edges, level.nodes, level.g, randomness, level.seed, rounds)


@sparing
def aggregate(level: Level, refined: DataFrame | None = None) -> Level:
    """The contracted level: by communities, or by ``refined``, whose nodes keep the community they came from."""
    parts = level.nodes.select("id", F.col("pid").alias("refined")) if refined is None else refined
    both = level.nodes.join(parts, "id")
    nodes = both.groupBy(F.col("refined").alias("id")).agg(F.sum("weight").alias("weight"), F.min("pid").alias("pid"))
    edges = graph.contract(level.edges, parts.select("id", F.col("refined").alias("pid")))
    ancestor = level.ancestor.join(parts, "id").select("orig", F.col("refined").alias("id"))
    tables = {"edges": edges, "nodes": nodes, "ancestor": ancestor}
    if level.apart is not None:  # parts are within communities, and these within blocks
        tables["apart"] = level.apart.join(parts, "id").groupBy(F.col("refined").alias("id")).agg(F.min("block").alias("block"))
    written = together(*(partial(cut, df, name) for name, df in tables.items()))
    return replace(level, **dict(zip(tables, written)), number=level.number + 1)


@sparing
def leiden(level: Level, randomness: float = 0.1, max_iteration: int | None = None, absolute: float | None = None, relative: float | None = None) -> Level:
    """Levels until every community is one node, nothing changes, or ``max_iteration``; then contracted whole.

    Afterwards communities linked by more than a threshold are merged, if one is given.
    """
    if absolute is not None and relative is not None:
        raise ValueError("give an absolute or a relative threshold, not both")
    before = None
    for number in count():
        if number == max_iteration:
            break
        if number == LEVELS:
            raise RuntimeError(f"no fixed point after {LEVELS} levels")
        level, added = move_nodes(level)
        n, k = level.nodes.agg(F.count("*"), F.count_distinct("pid")).first()
        if n == k or (added <= moving.TINY and (n, k) == before):
            break
        before = n, k
        level = aggregate(level, refine(level, randomness))
    level = aggregate(level)
    if absolute is not None or relative is not None:
        level = merge_highly_connected(level, absolute, relative)
    return level


def merge_highly_connected(level: Level, absolute: float | None = None, relative: float | None = None) -> Level:
    """One pass: nodes linked by more than ``absolute``, or ``relative`` times the lesser node weight, become one."""
    if (absolute is None) == (relative is None):
        raise ValueError("give an absolute or a relative threshold")
    edges = level.edges.filter("src <> dst")
    if absolute is not None:
        strong = edges.filter(F.col("weight") > absolute)
    else:
        one = level.nodes.select(F.col("id").alias("src"), F.col("weight").alias("k1"))
        two = level.nodes.select(F.col("id").alias("dst"), F.col("weight").alias("k2"))
        strong = edges.join(one, "src").join(two, "dst").filter(F.col("weight") > F.lit(relative) * F.least("k1", "k2")).select("src", "dst", "weight")
    merged = connected_components(strong, level.nodes.select("id")).withColumnRenamed("component", "_c")
    nodes = level.nodes.join(merged, "id").select("id", "weight", F.col("_c").alias("pid"))
    return aggregate(replace(level, nodes=cut(nodes, "nodes")))
