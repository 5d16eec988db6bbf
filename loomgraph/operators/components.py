"""Connected components by randomised contractions, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import join_counted
from loomgraph.sessions import cut, drop_table, observed, sparing, together

#: A safety limit: levels end when no edge is left, and raise if they get this far.
MAX_LEVELS = 200


@sparing
def connected_components(edges: DataFrame, vertices: DataFrame | None = None, src: str = "src", dst: str = "dst", trace: list | None = None) -> DataFrame:
    """``(id, component)``: each vertex with the smallest id that it reaches, itself included.

    A level maps each vertex to the first of itself and its neighbours in an order, by id on the first level and by a
    seeded hash on the others, and the edges with it. What is connected stays connected, what is not stays apart, and under a random order no more
    than a constant share of the vertices is expected to be left, also in a chain; parallel edges become one. So all levels
    together are a small multiple of the first. Then components are handed back, level by level. A hub's neighbours are only ever
    aggregated, never gathered; what it maps to reaches its rows by broadcast, where they are, and those of other vertices by
    shuffle (``join_counted``). ``trace`` collects the edges of every level. Vertices without edges come from ``vertices`` (column ``id``).
    Self-loops keep their vertex. Null endpoints are refused: an edge to nowhere is an input error.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    pairs, seen = observed(pairs, "pairs", n=F.count_if(F.col("u") != F.col("v")))
    lone = pairs.filter("u = v").select(F.col("u").alias("id"))
    if vertices is not None:
        lone = lone.union(vertices.select("id"))
    now, n, levels = pairs.filter("u <> v"), seen["n"], []
    for level in range(MAX_LEVELS):
        if trace is not None:
            trace.append(n)
        if not n:
            break
        firsts, most = observed(_firsts(now, level), "firsts", n=F.count("*"), most=F.max("n"))
        low = firsts.withColumn("low", F.col("u")) if not levels else firsts.join(levels[-1][1].select(F.col("to").alias("u"), "low"), "u")
        into = low.groupBy("to").agg(F.count("*").alias("n"), F.min("low").alias("low"))

        def next_pairs(now: DataFrame = now, firsts: DataFrame = firsts, n: int = n, most: int = most["most"]) -> tuple[DataFrame, dict]:
            return observed(_mapped(now, firsts, n, most), "pairs", n=F.count("*"))

        (counted, fan), (here, seen) = together(lambda into=into: observed(into, "into", most=F.max("n")), next_pairs)
        levels.append((firsts, counted, most["n"], fan["most"]))
        if level:
            drop_table(now)
        now, n = here, seen["n"]
    else:
        raise RuntimeError(f"edges are left after {MAX_LEVELS} levels")
    found = None
    for level, (firsts, counted, rows, most) in reversed(list(enumerate(levels))):
        table = counted.select("to", "n", F.col("low").alias("component"))
        if found is not None:
            above = found.select(F.col("id").alias("to"), F.col("component").alias("_above"))
            table = table.join(above, "to", "left").select("to", "n", F.coalesce("_above", "component").alias("component"))
        found = join_counted(firsts.select(F.col("u").alias("id"), "to"), table, "to", "n", rows, most=most).select("id", "component")
        if level:
            found = cut(found, "components")
            drop_table(firsts, counted)
    lone = lone.select("id", F.col("id").alias("component"))
    every = lone if found is None else found.unionByName(lone)
    return every.groupBy("id").agg(F.min("component").alias("component"))


def _order(id: Column, level: int) -> Column:
    return id if level == 0 else F.xxhash64(id, F.lit(level))


def _firsts(pairs: DataFrame, level: int) -> DataFrame:
    """(u, to, n): the first of each vertex and its neighbours, and how many of these there are."""
    both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = F.min("v") if level == 0 else F.min_by("v", _order(F.col("v"), level))
    best = both.groupBy("u").agg(near.alias("best"), F.count("*").alias("n"))
    return best.select("u", F.when(_order(F.col("best"), level) < _order(F.col("u"), level), F.col("best")).otherwise(F.col("u")).alias("to"), "n")


def _mapped(pairs: DataFrame, firsts: DataFrame, n: int, most: int) -> DataFrame:
    """The edges between what their ends are mapped to, each once. n: how many pairs there are; most: how many a vertex has at most."""
    for end in ("u", "v"):
        table = firsts.select(F.col("u").alias(end), F.col("to").alias(f"_{end}"), "n")
        pairs = join_counted(pairs, table, end, "n", 2 * n, most=most).drop(end)
    return pairs.filter("_u <> _v").select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct()
