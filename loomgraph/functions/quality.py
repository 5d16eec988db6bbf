"""Partition quality under modularity and the constant Potts model, and the gains of moves.

With canonical weights w, node sizes k, community sizes S and the scaled resolution g:
Q = sum over communities of (weight inside - g S (S - 1) / 2). Under modularity k is a node's number of
adjacency entries and g = gamma / (2 * total weight); under the constant Potts model k = 1 and g = gamma.
Q is not divided by the weight. A graph without weight has g = 0 under modularity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import is_close
from loomgraph.operators import graph


@dataclass(frozen=True)
class Objective:
    """A pluggable objective: node sizes (id, weight) of a graph, and its scaled resolution."""

    name: str
    node_sizes: Callable[[DataFrame, DataFrame], DataFrame]
    scaled: Callable[[float, int], float]


MODULARITY = Objective(
    "modularity",
    lambda edges, ids: graph.degrees(edges, ids).select("id", F.col("degree").alias("weight")),
    lambda gamma, total: gamma / (2 * total) if total else 0.0,
)
CPM = Objective("cpm", lambda edges, ids: ids.select("id", F.lit(1).cast("long").alias("weight")), lambda gamma, total: gamma)


def community_sizes(nodes: DataFrame) -> DataFrame:
    """(pid, S) of ``nodes(id, weight, pid)``."""
    return nodes.groupBy("pid").agg(F.sum("weight").alias("s"))


def quality(edges: DataFrame, nodes: DataFrame, g: float) -> DataFrame:
    """One row, Q; 0.0 for an empty graph."""
    one = nodes.select(F.col("id").alias("src"), F.col("pid").alias("_one"))
    two = nodes.select(F.col("id").alias("dst"), F.col("pid").alias("_two"))
    inside = edges.join(one, "src").join(two, "dst").filter("_one = _two").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w"))
    expected = community_sizes(nodes).agg(F.coalesce(F.sum(F.col("s") * (F.col("s") - 1) / 2), F.lit(0.0)).alias("e"))
    return inside.join(expected).select((F.col("w") - F.lit(g) * F.col("e")).alias("quality"))


def weights_to_communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, pid, w): weight from each node to each community of a neighbour, without its self-loop."""
    labels = nodes.select(F.col("id").alias("dst"), "pid")
    return graph.adjacency(edges).filter("src <> dst").join(labels, "dst").groupBy(F.col("src").alias("id"), "pid").agg(F.sum("weight").alias("w"))


def contributions(edges: DataFrame, nodes: DataFrame, g: float) -> DataFrame:
    """(id, own, pid, contrib, loss): joining pid is worth w - g k S(pid), leaving own costs -loss.

    One row for each node and neighbouring community; contrib for the own community is of no use for moves.
    """
    near = weights_to_communities(edges, nodes)
    own = near.select("id", F.col("pid").alias("own"), F.col("w").alias("own_w"))
    s = community_sizes(nodes)
    start = nodes.select("id", F.col("weight").alias("k"), F.col("pid").alias("own")).join(s.withColumnRenamed("pid", "own").withColumnRenamed("s", "own_s"), "own")
    start = start.join(own, ["id", "own"], "left")
    loss = -F.coalesce("own_w", F.lit(0)) + F.lit(g) * F.col("k") * (F.col("own_s") - F.col("k"))
    base = start.select("id", "own", "k", loss.alias("loss"))
    return near.join(s, "pid").join(base, "id").select("id", "own", "pid", (F.col("w") - F.lit(g) * F.col("k") * F.col("s")).alias("contrib"), "loss")


def near_best(options: DataFrame) -> DataFrame:
    """(id, pid, contrib) of ``options(id, pid, contrib)``: the largest pid among those whose contribution is the largest, or as good as that.

    Two argmax steps: the largest contribution of each node, then the largest pid within the tolerance of ``is_close`` of it.
    """
    top = options.groupBy("id").agg(F.max("contrib").alias("_top"))
    close = options.join(top, "id").filter(is_close(F.col("contrib"), F.col("_top")))
    best = close.groupBy("id").agg(F.max(F.struct("pid", "contrib")).alias("_best"))
    return best.select("id", "_best.pid", "_best.contrib")


def best_moves(edges: DataFrame, nodes: DataFrame, g: float) -> DataFrame:
    """(id, own, target, gain): the best community for each node with a neighbour other than itself.

    The neighbouring community other than its own of largest positive contribution, the larger pid among equal
    ones; a null target, worth 0, is a community of its own. gain is what the move adds to Q.
    """
    worth = F.when((F.col("pid") != F.col("own")) & (F.col("contrib") > 0), F.struct("contrib", "pid"))
    best = contributions(edges, nodes, g).groupBy("id", "own").agg(F.max(worth).alias("best"), F.first("loss").alias("loss"))
    return best.select("id", "own", F.col("best.pid").alias("target"), (F.coalesce("best.contrib", F.lit(0.0)) + F.col("loss")).alias("gain"))


def move_delta(edges: DataFrame, nodes: DataFrame, g: float, node: int, pid: int) -> DataFrame:
    """One row: what moving ``node`` to ``pid`` adds to Q, its self-loop counted where it leaves."""
    me = nodes.filter(F.col("id") == node).select(F.col("weight").alias("k"), F.col("pid").alias("own"))
    labels = nodes.select(F.col("id").alias("dst"), F.col("pid").alias("to"))
    near = graph.adjacency(edges).filter(F.col("src") == node).join(labels, "dst").join(me)
    w = near.agg(F.coalesce(F.sum(F.when((F.col("to") == pid) & (F.col("dst") != node), F.col("weight"))), F.lit(0)).alias("w_to"), F.coalesce(F.sum(F.when(F.col("to") == F.col("own"), F.col("weight"))), F.lit(0)).alias("w_own"))
    s = nodes.join(me.select("k", F.col("own").alias("_own"))).agg(
        F.coalesce(F.sum(F.when(F.col("pid") == pid, F.col("weight"))), F.lit(0)).alias("s_to"), F.sum(F.when(F.col("pid") == F.col("_own"), F.col("weight"))).alias("s_own"), F.max("k").alias("k")
    )
    k = F.col("k")
    return w.join(s).select((F.col("w_to") - F.lit(g) * k * F.col("s_to") - F.col("w_own") + F.lit(g) * k * (F.col("s_own") - k)).alias("delta"))


def well_connected_nodes(edges: DataFrame, nodes: DataFrame, g: float) -> DataFrame:
    """(id): nodes whose weight to the rest of their ``super`` set is at least g k (S - k). nodes(id, weight, super)."""
    own = nodes.select(F.col("id"), "weight", "super")
    other = nodes.select(F.col("id").alias("dst"), F.col("super").alias("_to"))
    inside = graph.adjacency(edges).filter("src <> dst").withColumnRenamed("weight", "_w").withColumnRenamed("src", "id").join(own, "id").join(other, "dst").filter("super = _to").groupBy("id").agg(F.sum("_w").alias("w"))
    s = own.groupBy("super").agg(F.sum("weight").alias("s"))
    every = own.join(s, "super").join(inside, "id", "left")
    return every.filter(F.coalesce("w", F.lit(0)) >= F.lit(g) * F.col("weight") * (F.col("s") - F.col("weight"))).select("id")


def well_connected_communities(edges: DataFrame, nodes: DataFrame, g: float) -> DataFrame:
    """(pid): communities within one ``super`` set whose weight to the rest of it is at least g C (S - C).

    nodes(id, weight, pid, super)
    """
    one = nodes.select(F.col("id").alias("src"), F.col("pid").alias("p1"), F.col("super").alias("s1"))
    two = nodes.select(F.col("id").alias("dst"), F.col("pid").alias("p2"), F.col("super").alias("s2"))
    out = graph.adjacency(edges).join(one, "src").join(two, "dst").filter("s1 = s2 and p1 <> p2").groupBy(F.col("p1").alias("pid")).agg(F.sum("weight").alias("w"))
    c = nodes.groupBy("pid").agg(F.sum("weight").alias("c"), F.min("super").alias("super"), F.max("super").alias("_most"))
    s = nodes.groupBy("super").agg(F.sum("weight").alias("s"))
    every = c.filter(F.col("super") == F.col("_most")).join(s, "super").join(out, "pid", "left")
    return every.filter(F.coalesce("w", F.lit(0)) >= F.lit(g) * F.col("c") * (F.col("s") - F.col("c"))).select("pid")
