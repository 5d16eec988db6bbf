"""Local moving of Leiden on a frontier, with state that follows the moves.

The state of a level is kept in tables that a round changes by what moved: node-to-community weights as a base and signed
differences, merged every few rounds; community sizes; labels. A round:

1. Nodes of the frontier are evaluated: for each the best community of a neighbour, and what the move adds to Q.
2. A community is a giver if its best move out comes before its best move in, else it takes. Only moves from givers to
   takers are made, so none follows a neighbour that leaves.
3. In every community moves go by priority, in classes of gain per size and hash. What a move loses to those before it is its size times theirs, so
   in this order the most moves hold: once one fails, later ones do as well. A move is made if its gain is positive after
   those before it, in its target and in the community that it leaves: sums over classes, so no community is gathered. One that leads both is
   made in any case, so every round with gains has moves.
4. Gains then add up: what movers share with each other can only add to Q. The sum is exact and carried along.
5. Neighbours of what moved, and nodes that could not move though they would gain, are the next frontier. Rounds end when it is empty; or, if
   ``thorough``, when all nodes are looked at once more and none gains: communities that grow or shrink also change what distant nodes gain.

Priorities hang on gains, ids and the seed, so results don't depend on the partitioning. Communities are named by pairs (number, id)
here, as a node that founds a community of its own, its n-th, needs a name that no other has; at the end by their smallest member.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import blocks, graph
from loomgraph.operators.skew import join_counted
from loomgraph.sessions import cut, drop_table, observed, sparing, together

TINY = 1e-9
#: A safety limit: rounds end where nothing gains, and raise if they get this far.
ROUNDS = 10_000
PARTS = 4
STEPS = 256  # an octave of gains
#: Up to this many gains, about 2 MB in rows, are dealt with in one stage, as Spark would put them into one partition anyway.
FEW = 20_000


def draw(*columns: str, salt: int) -> Column:
    """A hash from 0 to 2**62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(salt)), 2)


def hash_class(tie: Column) -> Column:
    """0 to 62, each about as large as all lower ones together: sums over classes tell within a factor of two how far a sum goes."""
    return F.floor(F.log2(tie + 1)).cast("int")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _evaluated(near: list[DataFrame], nodes: DataFrame, sizes: DataFrame, g: float, active: DataFrame | None, salt: int) -> DataFrame:
    """(id, k, own, founded, target, gain, dw, first) of nodes that gain.

    dw is what the move changes of the weight within communities; first its priority, the gain for each unit of size in fine steps of equal ratio, then a hash: lower is earlier.
    """
    seen, mine = "", ""
    if active is not None:
        seen, mine = (f"left semi join {{active}} a on a.id = {t}.id" for t in ("r", "n"))
    rows = f"select r.id, r.pid, r.w from {{near}} r {seen}"
    if len(near) > 1:
        rows = f"select r.id, r.pid, sum(r.w) as w from {{near}} r {seen} group by r.id, r.pid having sum(r.w) <> 0"
    return nodes.sparkSession.sql(
        f"""
        with rows as ({rows}),
        me as (select n.id, n.weight as k, n.pid as own, n.founded, o.s as own_s from {{nodes}} n join {{sizes}} o on o.pid = n.pid {mine}),
        worth as (
            select m.*, r.pid, r.w, r.w - {g!r}D * m.k * s.s as contrib, r.pid <> m.own as other
            from rows r join {{sizes}} s on s.pid = r.pid join me m on m.id = r.id
        ),
        best as (
            select id, k, own, founded, {g!r}D * k * (own_s - k) - coalesce(sum(if(other, null, w)), 0) as loss, coalesce(sum(if(other, null, w)), 0) as own_w,
                max(if(other and contrib > 0, struct(contrib, pid, w), null)) as best
            from worth group by id, k, own, own_s, founded
        ),
        gains as (select id, k, own, founded, best.pid as target, coalesce(best.contrib, 0D) + loss as gain, coalesce(best.w, 0) - own_w as dw from best)
        select *, struct(-cast(floor(log2(gain / k) * {STEPS}) as int) as level, shiftrightunsigned(xxhash64(id, {salt}), 2) as tie, id as by) as first
        from gains where gain > {TINY!r}D
        """,
        near=_union(near), nodes=nodes, sizes=sizes, **({} if active is None else {"active": active}),
    )


def _offers(gains: DataFrame, total: int) -> DataFrame:
    """The moves from givers to takers, with their class in the order, and whether they lead where they leave and go."""
    roles = gains.sparkSession.sql(
        """
        with ends as (select inline(array(struct(own as pid, first as out, null as into), struct(target as pid, null as out, first as into))) from {gains}),
        tops as (select pid, min(out) as out, min(into) as into, count(out) as n_out, count(into) as n_in from ends where pid is not null group by pid)
        select *, out is not null and (into is null or out < into) as gives from tops
        """,
        gains=gains,
    )
    here = roles.filter("gives").selectExpr("pid as own", "out as top_out", "n_out")
    there = roles.filter("into is not null").selectExpr("pid as target", "into as top_in", "gives", "n_in")
    rows = join_counted(join_counted(gains, here, "own", "n_out", total), there, "target", "n_in", total, how="left")
    leads = "first = top_out and (target is null or first = top_in) as leads"
    return rows.filter("target is null or not gives").selectExpr("id", "k", "own", "founded", "target", "gain", "dw", leads, "struct(first.level, cast(floor(log2(first.tie + 1)) as int) as tie) as class")


def _made(offers: DataFrame, g: float) -> DataFrame:
    """(id, k, own, founded, target, dw) of the offers that gain after all that may come before them where they leave and go.

    A community is left or joined in a round, never both, so one sum tells what comes before or with each of its classes.
    """
    return offers.sparkSession.sql(
        f"""
        with ends as (select inline(array(struct(own as pid, class, k), struct(target as pid, class, k))) from {{offers}}),
        classes as (select pid, class, sum(k) as k from ends where pid is not null group by pid, class),
        upto as (select pid, class, sum(k) over (partition by pid order by class) as k from classes)
        select o.id, o.k, o.own, o.founded, o.target, o.dw
        from {{offers}} o join upto l on l.pid = o.own and l.class = o.class left join upto j on j.pid = o.target and j.class = o.class
        where o.leads or o.gain - {g!r}D * o.k * (l.k - o.k + coalesce(j.k - o.k, 0)) > {TINY!r}D
        """,
        offers=offers,
    )


def _made_of_few(gains: DataFrame, g: float) -> DataFrame:
    """The same as ``_made(_offers(gains))``, by windows over one partition: no join, no shuffle and no broadcast. For ``FEW`` rows only, as a community's are met in one place."""
    return gains.sparkSession.sql(
        f"""
        with ends as (select *, inline(array(struct(0 as side, own as pid), struct(1 as side, target as pid))) from {{gains}}),
        tops as (
            select *, min(if(side = 0, first, null)) over (partition by pid) as out, min(if(side = 1, first, null)) over (partition by pid) as into
            from ends where pid is not null
        ),
        roles as (select *, out is not null and (into is null or out < into) as gives, first = if(side = 0, out, into) as heads from tops),
        offers as (
            select id, k, own, founded, target, gain, dw, first, min(heads) as leads from roles
            group by id, k, own, founded, target, gain, dw, first having bool_and(side = 1 or gives) and not bool_or(side = 1 and gives)
        ),
        both as (
            select *, struct(first.level, cast(floor(log2(first.tie + 1)) as int) as tie) as class, inline(array(struct(own as pid), struct(target as pid))) from offers
        ),
        upto as (select *, sum(k) over (partition by pid order by class range between unbounded preceding and current row) - k as others from both where pid is not null)
        select id, k, own, founded, target, dw from upto group by id, k, own, founded, target, gain, dw, leads
        having leads or gain - {g!r}D * k * sum(others) > {TINY!r}D
        """,
        gains=gains.coalesce(1),
    )


@sparing
def settle(
    edges: DataFrame, nodes: DataFrame, g: float, seed: int = 0, rounds: int = ROUNDS, thorough: bool = False, trace: list | None = None, apart: DataFrame | None = None, within: int = blocks.WITHIN
) -> tuple[DataFrame, float]:
    """``nodes(id, weight, pid)`` after rounds of moves until the frontier is empty, and what they have added to Q.

    Blocks that don't touch, ``apart(id, block)``, are settled by a task each if they have ``within`` rows at most (``blocks``), larger ones in rounds over
    tables. ``trace`` collects (whether all nodes were looked at, moves, what they added) of every round, and of all such blocks together.
    """
    total = edges.count() + nodes.count()
    if apart is None:
        apart = nodes.select("id", F.lit(0).cast("long").alias("block")) if total <= within else blocks.apart(edges, nodes)
    here = cut(nodes.join(apart, "id"), "nodes")
    rows = cut(blocks.rows_of(edges.join(here.select(F.col("id").alias("src"), "block"), "src"), here, "pid"), "rows")
    large, rest, tables, added = blocks.large(rows, total, within), rows, [], 0.0
    if large is not None:
        rest, theirs = rows.join(F.broadcast(large), "block", "left_anti"), cut(rows.join(F.broadcast(large), "block", "left_semi"), "rows")
        ends = cut(theirs.filter("not node").selectExpr("a as src", "b as dst", "w as weight"), "edges")
        out, added = _in_rounds(ends, theirs.filter("node").selectExpr("a as id", "w as weight", "b as pid"), g, seed, rounds, thorough, trace)
        tables.append(out)
        drop_table(theirs, ends)
    sums = {"n": F.count("*"), "gained": F.coalesce(F.sum("gained"), F.lit(0.0)), "moves": F.coalesce(F.sum("moves"), F.lit(0)), "ended": F.coalesce(F.bool_and("ended"), F.lit(True))}
    done, seen = observed(blocks.settle(rest, total, nodes, g, rounds, thorough), "settled", **sums)
    if not seen["ended"]:
        raise RuntimeError(f"moves that gain are left after {rounds} rounds")
    if trace is not None and seen["moves"]:
        trace.append((True, seen["moves"], seen["gained"]))
    drop_table(here, rows, *([] if large is None else [large]))
    done = done.select("id", "weight", "pid")
    return _union([done, *tables]), added + seen["gained"]


def _in_rounds(edges: DataFrame, nodes: DataFrame, g: float, seed: int, rounds: int, thorough: bool, trace: list | None) -> tuple[DataFrame, float]:
    """The same by rounds over tables, however large a component is."""
    spark = nodes.sparkSession
    adj, here = together(
        lambda: cut(graph.adjacency(edges).filter("src <> dst"), "adjacency"),
        lambda: cut(nodes.selectExpr("id", "weight", "struct(-1 as number, pid as id) as pid", "0 as founded"), "nodes"),
    )
    first, sizes = together(
        lambda: cut(spark.sql("select a.src as id, n.pid, sum(a.weight) as w from {adj} a join {here} n on n.id = a.dst group by 1, 2", adj=adj, here=here), "near"),
        lambda: cut(here.groupBy("pid").agg(F.sum("weight").alias("s")), "sizes"),
    )
    near = [first]
    n, added, active, looked = here.count(), 0.0, None, []
    salt = seed & 0x7FFFFFFF  # the same in all rounds, as are all statements, so that what is compiled for one serves the others
    for _ in range(rounds):
        gains, seen = observed(_evaluated(near, here, sizes, g, active, salt), "gains", n=F.count("*"))
        if not seen["n"]:
            drop_table(gains)
            if active is None or not thorough:
                break
            active = None
            continue
        made, seen = observed(_made_of_few(gains, g) if seen["n"] <= FEW else _made(_offers(gains, seen["n"]), g), "moves", n=F.count("*"), dw=F.coalesce(F.sum("dw"), F.lit(0)))
        moves = made.selectExpr("id", "k", "own", "coalesce(target, struct(founded as number, id as id)) as to", "int(target is null) as founds")

        def differences(moves: DataFrame = moves) -> tuple[DataFrame, dict]:
            """What neighbours of movers lose and gain towards communities; ``extra`` meets each edge among movers four times."""
            rows = spark.sql(
                """
                select a.dst as id, inline(array(struct(m.own as pid, -a.weight as w), struct(m.to as pid, a.weight as w))),
                    a.weight * (if(m.own = o.own, 1, 0) + if(m.to = o.to, 1, 0)) as extra
                from {adj} a join {moves} m on m.id = a.src left join {moves} o on o.id = a.dst
                """,
                adj=adj, moves=moves,
            )
            return observed(rows, "differences", extra=F.coalesce(F.sum("extra"), F.lit(0)))

        def relabelled(moves: DataFrame = moves, here: DataFrame = here) -> DataFrame:
            return cut(spark.sql("select h.id, h.weight, coalesce(m.to, h.pid) as pid, h.founded + coalesce(m.founds, 0) as founded from {here} h left join {moves} m on m.id = h.id", here=here, moves=moves), "nodes")

        def resized(moves: DataFrame = moves, sizes: DataFrame = sizes) -> tuple[DataFrame, dict]:
            now = spark.sql(
                """
                with change as (select inline(array(struct(own as pid, -k as d), struct(to as pid, k as d))) from {moves}),
                every as (select pid, s as was, s from {sizes} union all select pid, 0 as was, d as s from change)
                select pid, sum(was) as was, sum(s) as s from every group by pid having sum(was) <> 0 or sum(s) <> 0
                """,
                moves=moves, sizes=sizes,
            )
            return observed(now, "sizes", expected=F.coalesce(F.sum(F.expr("(double(s) * s - double(was) * was) / 2")), F.lit(0.0)))

        (steps, pairs), new_nodes, (new_sizes, spread) = together(differences, relabelled, resized)
        gained = float(seen["dw"]) + float(pairs["extra"]) / 4 - g * float(spread["expected"])
        added += gained
        if trace is not None:
            trace.append((active is None, seen["n"], gained))
        active = steps.select("id").unionByName(gains.select("id")).distinct()
        near.append(steps.select("id", "pid", "w"))
        drop_table(here, sizes, made, *looked)
        here, sizes, looked = new_nodes, new_sizes, [gains]
        if len(near) > PARTS:
            merged = cut(_union(near).groupBy("id", "pid").agg(F.sum("w").alias("w")).filter("w <> 0"), "near")
            active = cut(active, "active")
            drop_table(*near)
            near = [merged]
    else:
        raise RuntimeError(f"moves that gain are left after {rounds} rounds")
    named = here.groupBy("pid").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    out = cut(join_counted(here, named, "pid", "n", n).select("id", "weight", F.col("least").alias("pid")), "nodes")
    drop_table(adj, here, sizes, *near, *looked)
    return out, added
