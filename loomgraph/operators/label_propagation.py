"""Fast label propagation in rounds.

Every vertex takes the label most frequent among its distinct neighbours, weights ignored, a self-loop
making it a neighbour of its own. Only vertices with a changed neighbour are looked at again. In a round
a seeded half of them moves, so two sides of a bipartite graph cannot swap labels for ever. In a tie a
vertex keeps its label if it is among the most frequent, so rounds come to an end; else a seeded hash decides. An epoch ends by splitting labels into their connected parts.
All draws hang on ids, seed and round, so results don't depend on the partitioning.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph, partitions
from loomgraph.sessions import buckets_of, cut, dealt, drop_table, observed, sparing, together

#: A safety limit: an epoch ends when no vertex is active, and raises if it gets this far.
MAX_ROUNDS = 10_000
OWED = 8
FEW = 20_000
MANY = 4  # from a ``MANY``-th of all vertices on, active ones get their neighbours' labels pushed


class Assignment(Protocol):
    """A pluggable rule: new labels (id, new) of the vertices in ``active(id, pid)`` from their neighbours' labels."""

    def __call__(self, adj: DataFrame, labels: DataFrame, active: DataFrame, salt: int) -> DataFrame: ...


def neighbour_mode(adj: DataFrame, labels: DataFrame, active: DataFrame, salt: int) -> DataFrame:
    """The most frequent label; among equally frequent ones the vertex's own, then the one of greatest hash. ``active`` may have the own ones as ``pid``."""
    own = active if "pid" in active.columns else labels.join(active, "id", "left_semi")
    near = adj.join(own.select(F.col("id").alias("src"), F.col("pid").alias("_own")), "src").join(labels.withColumnRenamed("id", "dst"), "dst")
    counted = near.groupBy(F.col("src").alias("id"), "pid").agg(F.count("*").alias("n"), F.first("_own").alias("_own"))
    best = counted.groupBy("id").agg(F.max(F.struct("n", (F.col("pid") == F.col("_own")).alias("_keeps"), F.xxhash64("id", "pid", F.lit(salt)).alias("_tie"), "pid")).alias("_best"))
    return best.select("id", F.col("_best.pid").alias("new"))


def neighbour_mode_of_many(adj: DataFrame, labels: DataFrame, active: DataFrame, salt: int) -> DataFrame:
    """The same labels as by ``neighbour_mode``, where ``adj`` is dealt by ``src`` and most of its ``dst`` are active.

    Labels meet the edges where both are and go to the neighbours, which count them there: an edge is moved once, not three times, but all edges are read.
    """
    near = adj.join(labels.select(F.col("id").alias("src"), "pid"), "src").select(F.col("dst").alias("id"), "pid").join(active.withColumnRenamed("pid", "_own"), "id")
    counted = near.groupBy("id", "pid").agg(F.count("*").alias("n"), F.first("_own").alias("_own"))
    best = counted.groupBy("id").agg(F.max(F.struct("n", (F.col("pid") == F.col("_own")).alias("_keeps"), F.xxhash64("id", "pid", F.lit(salt)).alias("_tie"), "pid")).alias("_best"))
    return best.select("id", F.col("_best.pid").alias("new"))


def smallest_mode(adj: DataFrame, labels: DataFrame, active: DataFrame | None = None, salt: int = 0) -> DataFrame:
    """The most frequent label, the smallest among equally frequent ones: the same on every engine."""
    near = adj if active is None else adj.join(active.withColumnRenamed("id", "src"), "src", "left_semi")
    counted = near.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "pid").agg(F.count("*").alias("n"))
    best = counted.groupBy("id").agg(F.max(F.struct("n", (-F.col("pid")).alias("_pid"))).alias("_best"))
    return best.select("id", (-F.col("_best._pid")).alias("new"))


def synchronous_rounds(edges: DataFrame, labels: DataFrame, rounds: int) -> DataFrame:
    """A fixed number of rounds in which every vertex takes its neighbours' smallest mode at once."""
    adj = graph.adjacency(edges)
    for _ in range(rounds):
        new = smallest_mode(adj, labels)
        labels = labels.join(new, "id", "left").select("id", F.coalesce("new", "pid").alias("pid"))
    return labels


@sparing
def epoch(edges: DataFrame, labels: DataFrame | None = None, seed: int = 0, number: int = 0, assign: Assignment = neighbour_mode, max_rounds: int = MAX_ROUNDS, trace: list | None = None) -> DataFrame:
    """Rounds until no vertex is active; then labels are split into connected parts. ``max_rounds`` without an end is an error.

    Without ``labels`` every vertex of an edge starts with its own.
    The adjacency and labels are dealt once by vertex, and stay where they are: a round moves its active vertices, what has changed, and the rows
    of their neighbours. Changes are kept beside the labels, which are written anew once an ``OWED``-th of them has changed.
    ``trace`` collects (active vertices, changes) of every round.
    """
    directed, seen = observed(graph.adjacency(edges).select("src", "dst"), "adjacency", n=F.count("*"))
    buckets = buckets_of(seen["n"])
    adj = dealt(directed, "adjacency", "src", buckets)
    drop_table(directed)
    start = partitions.singlets(adj.select(F.col("src").alias("id")).distinct()) if labels is None else labels.select("id", "pid")
    base = dealt(start, "labels", "id", buckets)
    total = base.count()
    active, awake = base.select("id", "pid"), total
    since, owed = None, 0  # what has changed since ``base`` was written
    for turn in range(max_rounds):
        salt = (seed * 1_000_003 + number * 1009 + turn) & 0x7FFFFFFF
        toss = lambda of, salt=salt: F.pmod(F.xxhash64(of, F.lit(salt)), F.lit(2)) == 0
        coin = toss("id")
        now = base if since is None else partitions.update(base, _beside(since, owed))
        drawn = active.filter(coin)
        if assign is neighbour_mode and awake > total // MANY:
            new = neighbour_mode_of_many(adj.filter(toss("dst")), now, _beside(drawn, awake), salt)
        else:
            new = assign(adj, now, _beside(drawn, awake), salt)
        new = new.join(_beside(drawn, awake), "id")
        changed, seen = observed(new.filter("pid <> new").select("id", F.col("new").alias("pid")), "changed", n=F.count("*"))
        n = seen["n"]
        if trace is not None:
            trace.append((awake, n))

        def kept(since: DataFrame | None = since, changed: DataFrame = changed, n: int = n, owed: int = owed, now: DataFrame = now) -> tuple[DataFrame | None, int]:
            """What has changed since ``base``, or nothing if it is time to write it anew."""
            if n == 0:
                return since, owed
            if owed + n > total // OWED:
                return None, 0
            if since is None:
                return changed, n
            out, seen = observed(since.join(changed, "id", "left_anti").unionByName(changed), "since", n=F.count("*"))
            return out, seen["n"]

        def written(changed: DataFrame = changed, n: int = n, now: DataFrame = now) -> DataFrame | None:
            return dealt(partitions.update(now, _beside(changed, n)), "labels", "id", buckets) if owed + n > total // OWED and n else None

        def woken(active: DataFrame = active, changed: DataFrame = changed, n: int = n, coin: Column = coin, now: DataFrame = now) -> tuple[DataFrame, dict]:
            """Those that did not draw, and neighbours of what moved whose label, after this round's moves, is another: two that swap labels see each other."""
            rest = active.filter(~coin)
            if n:
                moved = _beside(changed, n)
                near = adj.join(moved.select(F.col("id").alias("src"), F.col("pid").alias("_to")), "src").select(F.col("dst").alias("id"), "_to").distinct()
                near = near.join(partitions.update(now, moved), "id").filter("pid <> _to").select("id", "pid")
                rest = rest.unionByName(near).distinct()
            return observed(rest, "active", n=F.count("*"))

        (next_since, next_owed), rewritten, (next_active, seen) = together(kept, written, woken)
        old = [active] if turn else []
        if next_since is not changed:
            old.append(changed)
        if since is not None and next_since is not since:
            old.append(since)
        if rewritten is not None:
            old.append(base)
            base = rewritten
        drop_table(*old)
        since, owed, active, awake = next_since, next_owed, next_active, seen["n"]
        if not awake:
            break
    else:
        raise RuntimeError(f"vertices are active after {max_rounds} rounds")
    now = base if since is None else partitions.update(base, _beside(since, owed))
    out = cut(partitions.split_disconnected(adj.filter("src <= dst"), now), "parts")
    drop_table(adj, base, *([active] if turn else []), *([since] if since is not None else []))
    return out


def _beside(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, ``n`` at most, as the side of a join that is moved: few are left to Spark, which broadcasts them, many are hashed next to what stays."""
    return rows.hint("shuffle_hash") if n > FEW else rows


def fast_label_propagation(edges: DataFrame, ids: DataFrame | None = None, epochs: int = 1, labels: DataFrame | None = None, seed: int = 0, assign: Assignment = neighbour_mode) -> DataFrame:
    """labels(id, pid), pid the smallest id in it; from singlets unless ``labels`` are given, which 0 epochs return."""
    now = labels
    if now is None and (ids is not None or not epochs):
        now = partitions.singlets(graph.vertices(edges) if ids is None else ids)
    for number in range(epochs):
        now = epoch(edges, now, seed, number, assign)
    return now
