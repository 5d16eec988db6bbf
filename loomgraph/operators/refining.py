"""Refinement of Leiden: well-connected singletons merged within their community, all at once that don't touch.

Within each community (``super``) every node starts alone. A node that is well connected to its community and still alone may join
a part of it that is well connected too, if that adds to Q; it draws one of these by their gains. A round:

1. Every such node draws a part by what joining adds to Q now.
2. A node that another with an earlier random number wants to join stays and takes, else it moves; what moves can't be joined. So
   all merges of a round are between movers and parts that stay: an independent set of the choices, of expected constant share.
3. Movers of a part go in classes of random order that double in size. A class is merged if, with all classes before it and even the
   least favourable order in it, every mover still gains and the part stays well connected until the last one joins.
   The first mover is merged in any case. So merges hold as if made one after the other, in O(log n) rounds also around a hub.
4. Weights, sizes and cuts of parts follow the merges. A node leaves the tables as soon as it is no longer alone.

A node moves once and a part that takes never moves, so labels are read off the merges. The end is reached when no node has a part
to join. Draws hang on ids, round and seed. ``randomness`` is the exponent on an option's share of the gains: 0 draws evenly, a large value
takes the best.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import blocks, graph
from loomgraph.operators.moving import draw, hash_class
from loomgraph.operators.skew import join_counted
from loomgraph.sessions import cut, drop_table, observed, sparing, together

#: A safety limit: rounds end when nothing is eligible, and raise if they get this far.
ROUNDS = 1_000


def _choices(near: DataFrame, parts: DataFrame, g: float, randomness: float, salt: int) -> DataFrame:
    """(id, k, to, w, c, cut, s, total, tie): the part that each node alone draws, and what is known of both."""
    well = parts.filter(F.col("cut") >= F.lit(g) * F.col("c") * (F.col("s") - F.col("c")))
    me = parts.select(F.col("pid").alias("id"), F.col("c").alias("k"), F.col("cut").alias("total"))
    options = near.join(well, "pid").join(me, "id")
    gain = F.col("w") - F.lit(g) * F.col("k") * F.col("c")
    u = (draw("id", "pid", salt=salt) + 1) / F.lit(float(2**62 + 1))
    weight = (F.log(u) / F.pow("gain", F.lit(float(randomness)))).alias("draw")
    options = options.withColumn("gain", gain).filter("gain > 0")
    best = options.groupBy("id", "k", "total").agg(F.max(F.struct(weight, F.col("pid").alias("to"), "w", "c", "cut", "s")).alias("best"))
    return best.select("id", "k", "total", "best.to", "best.w", "best.c", "best.cut", "best.s", draw("id", salt=salt + 1).alias("tie"))


def _movers(choices: DataFrame, total: int) -> DataFrame:
    """Choices of nodes that no earlier one wants to join, of parts that don't move themselves, with the first of each part marked."""
    order = F.struct("tie", "id")
    wanted = choices.groupBy(F.col("to").alias("pid")).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    own = choices.join(wanted.select(F.col("pid").alias("id"), F.col("first").alias("wants")), "id", "left")
    moving = own.filter(F.col("wants").isNull() | (order < F.col("wants"))).drop("wants")
    stays = moving.join(moving.select(F.col("id").alias("to")), "to", "left_anti")
    return join_counted(stays, wanted.withColumnRenamed("pid", "to"), "to", "n", total).withColumn("order", order)


def _merged(movers: DataFrame, touching: DataFrame, g: float) -> DataFrame:
    """(id, k, to, w, total) of the movers that are merged."""
    near = touching.groupBy("id").agg(F.sum("w").alias("shared"))
    rows = movers.join(near, "id", "left").withColumn("class", hash_class(F.col("tie")))
    change = F.col("total") - 2 * F.col("w") - 2 * F.coalesce("shared", F.lit(0))
    worth = F.col("w") / F.col("k") + F.lit(g) * F.col("k")
    fall = F.max(-change / F.col("k")).alias("fall")
    classes = rows.groupBy("to", "class", "c", "cut", "s").agg(F.sum("k").alias("k"), F.sum(change).alias("d"), fall, F.min(worth).alias("worth"), F.min("order").alias("lead"))
    order = Window.partitionBy("to").orderBy("class")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("c") + F.coalesce(F.sum("k").over(before), F.lit(0))
    kept = F.col("cut") + F.coalesce(F.sum("d").over(before), F.lit(0))
    summed = classes.withColumns({"start": start, "end": start + F.col("k"), "kept": kept, "top": F.min("lead").over(order)})
    # the cut falls by ``fall`` for each unit of size at most, so at size x it is at least this; where it comes closest to what is asked for is known
    closest = F.least(F.greatest((F.col("s") + F.col("fall") / F.lit(g)) / 2, F.col("start")), F.col("end")) if g > 0 else F.col("end")
    good = (F.col("worth") > F.lit(g) * F.col("end")) & (F.col("kept") - F.col("fall") * (closest - F.col("start")) >= F.lit(g) * closest * (F.col("s") - closest) - 1e-9)
    told = summed.withColumn("good", F.min(good.cast("int")).over(order)).select("to", "class", "top", "good")
    return rows.join(told, ["to", "class"]).filter((F.col("good") == 1) | (F.col("order") == F.col("top"))).select("id", "k", "to", "w", "total")


@sparing
def refine(edges: DataFrame, nodes: DataFrame, g: float, randomness: float = 0.1, seed: int = 0, rounds: int = ROUNDS, trace: list | None = None, within: int = blocks.WITHIN) -> DataFrame:
    """(id, refined) of ``nodes(id, weight, pid)``; parts are named by their smallest id.

    Communities with ``within`` rows at most, nodes and inner edges, are refined by a task each (``blocks``), larger ones in rounds over tables.
    ``trace`` collects the merges of every round, and of all such communities together.
    """
    one, two = (nodes.select(F.col("id").alias(end), F.col("pid").alias(into)) for end, into in (("src", "block"), ("dst", "_block")))
    inner = edges.filter("src <> dst").join(one, "src").join(two, "dst").filter("block = _block").select("src", "dst", "weight", "block")
    rows, seen = observed(blocks.rows_of(inner, nodes.select("id", "weight", F.col("pid").alias("block")), "block"), "rows", n=F.count("*"))
    total = seen["n"]
    large, rest, tables = blocks.large(rows, total, within), rows, []
    if large is not None:
        rest, theirs = rows.join(F.broadcast(large), "block", "left_anti"), rows.join(F.broadcast(large), "block", "left_semi")
        ends = cut(theirs.filter("not node").selectExpr("a as src", "b as dst", "w as weight"), "edges")
        tables.append(_in_rounds(ends, theirs.filter("node").selectExpr("a as id", "w as weight", "b as pid"), g, randomness, seed, rounds, trace))
        drop_table(ends)
    done, seen = observed(blocks.refine(rest, total, nodes, g, randomness, seed, rounds), "refined", merged=F.coalesce(F.sum("merged"), F.lit(0)), ended=F.coalesce(F.bool_and("ended"), F.lit(True)))
    if not seen["ended"]:
        raise RuntimeError(f"eligible singletons are left after {rounds} rounds")
    if trace is not None and seen["merged"]:
        trace.append(seen["merged"])
    drop_table(rows, *([] if large is None else [large]))
    done = done.select("id", "refined")
    return tables[0].unionByName(done) if tables else done


def _in_rounds(edges: DataFrame, nodes: DataFrame, g: float, randomness: float, seed: int, rounds: int, trace: list | None) -> DataFrame:
    """The same by rounds over tables, however large a community is."""
    base = cut(nodes.select("id", "weight", F.col("pid").alias("super")), "super")
    sizes = base.groupBy("super").agg(F.sum("weight").alias("s"), F.count("*").alias("n"))
    n = base.count()
    one, two = (base.select(F.col("id").alias(end), F.col("super").alias(f"s_{end}")) for end in ("src", "dst"))
    inner = cut(edges.filter("src <> dst").join(one, "src").join(two, "dst").filter("s_src = s_dst").select("src", "dst", "weight"), "inner")
    adj = graph.adjacency(inner)
    out = adj.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("cut"))
    known = join_counted(base, sizes, "super", "n", n).join(out, "id", "left")
    parts = cut(known.select(F.col("id").alias("pid"), F.col("weight").alias("c"), F.coalesce("cut", F.lit(0)).cast("long").alias("cut"), "s"), "parts")
    # written first: where few nodes are well connected, as in large communities, their join leaves the edges where they are
    steady = cut(parts.filter(F.col("cut") >= F.lit(g) * F.col("c") * (F.col("s") - F.col("c"))).select(F.col("pid").alias("id")), "steady")
    near = cut(adj.select(F.col("src").alias("id"), F.col("dst").alias("pid"), F.col("weight").alias("w")).join(steady, "id", "left_semi"), "near")
    merges: list[DataFrame] = []
    for turn in range(rounds):
        salt = (seed * 1_000_003 + 2 * turn) & 0x7FFFFFFF
        choices, seen = observed(_choices(near, parts, g, randomness, salt), "choices", n=F.count("*"))
        if not seen["n"]:
            drop_table(choices)
            break
        movers = cut(_movers(choices, seen["n"]), "movers")
        here = movers.select("id", "to")
        there = movers.select(F.col("id").alias("pid"), F.col("to").alias("to2"))
        touching = cut(near.join(here, "id").join(there, "pid").filter("to = to2").select("id", "pid", "w"), "touching")
        done = cut(_merged(movers, touching, g), "merges")

        def followed(near: DataFrame = near, done: DataFrame = done) -> DataFrame:
            """Weights of the nodes that are still alone, towards parts as they are now."""
            gone = done.select("id").unionByName(done.select(F.col("to").alias("id"))).distinct()
            renamed = near.join(gone, "id", "left_anti").join(done.select(F.col("id").alias("pid"), "to"), "pid", "left")
            return cut(renamed.groupBy("id", F.coalesce("to", "pid").alias("pid")).agg(F.sum("w").alias("w")), "near")

        def grown(parts: DataFrame = parts, done: DataFrame = done, touching: DataFrame = touching) -> DataFrame:
            """Sizes and cuts: a part's cut loses what leads into it, an edge between two that join counts in both of their totals."""
            both = touching.join(done.select("id", "to"), "id").join(done.select(F.col("id").alias("pid")), "pid", "left_semi")
            change = done.select(F.col("to").alias("pid"), F.col("k").alias("dc"), (F.col("total") - 2 * F.col("w")).alias("dcut"))
            change = change.unionByName(both.select(F.col("to").alias("pid"), F.lit(0).cast("long").alias("dc"), (-F.col("w")).alias("dcut")))
            summed = change.groupBy("pid").agg(F.sum("dc").alias("dc"), F.sum("dcut").alias("dcut"))
            now = parts.join(done.select(F.col("id").alias("pid")), "pid", "left_anti").join(summed, "pid", "left")
            return cut(now.select("pid", (F.col("c") + F.coalesce("dc", F.lit(0))).alias("c"), (F.col("cut") + F.coalesce("dcut", F.lit(0))).alias("cut"), "s"), "parts")

        new_near, new_parts = together(followed, grown)
        if trace is not None:
            trace.append(done.count())
        drop_table(choices, movers, touching, near, parts)
        near, parts = new_near, new_parts
        merges.append(done)
    else:
        raise RuntimeError(f"eligible singletons are left after {rounds} rounds")
    named = base.select("id", F.col("id").alias("to"))
    if merges:
        every = merges[0].select("id", "to")
        for more in merges[1:]:
            every = every.unionByName(more.select("id", "to"))
        named = base.select("id").join(every, "id", "left").select("id", F.coalesce("to", "id").alias("to"))
    named = cut(named, "named")
    least = named.groupBy("to").agg(F.min("id").alias("refined"), F.count("*").alias("n"))
    refined = cut(join_counted(named, least, "to", "n", n).select("id", "refined"), "refined")
    drop_table(base, inner, steady, near, parts, named, *merges)
    return refined
