"""Queries of the graph library over edge lists derived from the test tables, and SQL that they are held against."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import quality, scalars
from loomgraph.operators import components, graph, label_propagation, leiden, partitions, statistics
from loomgraph.plans import hybrid
from loomgraph.sessions import buckets_of, cut, fresh_path, sparing
from loomgraph.sources import edges as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Edge lists (umi1, umi2): sparse order-part with many small components, and whole; customer-supplier, bipartite and weighted;
# events by user and slot, with self-loops; customers in cliques of ten, each tied to the next by one edge, so that communities are known.
VIEWS = {
    "order_part": "select l_orderkey * 2 as umi1, l_partkey * 2 + 1 as umi2 from lineitem where l_returnflag = 'R' and l_quantity >= 45",
    "order_part_whole": "select l_orderkey * 2 as umi1, l_partkey * 2 + 1 as umi2 from lineitem",
    "cust_supp": "select o_custkey * 2 as umi1, l_suppkey * 2 + 1 as umi2 from orders join lineitem on o_orderkey = l_orderkey",
    "user_slot": "select user_id as umi1, event_id % 97 as umi2 from events",
    "planted": "select a.c_custkey as umi1, b.c_custkey as umi2 from customer a join customer b on a.c_custkey // 10 = b.c_custkey // 10 where a.c_custkey < b.c_custkey"
    " union all select a.c_custkey, b.c_custkey from customer a join customer b on a.c_custkey + 1 = b.c_custkey where a.c_custkey % 10 = 9",
}


def _clique(id: Column, of: int) -> Column:
    return F.floor(id / of)


def pairs(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if view == "order_part":
        kept = read("lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45))
        return kept.select((F.col("l_orderkey") * 2).alias("umi1"), (F.col("l_partkey") * 2 + 1).alias("umi2"))
    if view == "order_part_whole":
        return read("lineitem").select((F.col("l_orderkey") * 2).alias("umi1"), (F.col("l_partkey") * 2 + 1).alias("umi2"))
    if view == "cust_supp":
        both = read("orders").join(read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        return both.select((F.col("o_custkey") * 2).alias("umi1"), (F.col("l_suppkey") * 2 + 1).alias("umi2"))
    if view == "planted":
        ids = read("customer").select(F.col("c_custkey").cast("long").alias("id"))
        one, two = (ids.select(F.col("id").alias(c), _clique(F.col("id"), 10).alias("clique")) for c in ("umi1", "umi2"))
        bridges = one.filter("umi1 % 10 = 9").join(two, F.col("umi1") + 1 == F.col("umi2"))
        return one.join(two, "clique").filter("umi1 < umi2").select("umi1", "umi2").unionAll(bridges.select("umi1", "umi2"))
    return read("events").select(F.col("user_id").alias("umi1"), (F.col("event_id") % 97).alias("umi2"))


def _edges(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return graph.canonical_edges(pairs(spark, sf_dir, view))


def _by_remainder(ids: DataFrame, of: int) -> DataFrame:
    return ids.select("id", (F.col("id") % of).alias("pid"))


def _nodes(edges: DataFrame, of: int, objective: quality.Objective = quality.MODULARITY) -> DataFrame:
    ids = graph.vertices(edges)
    return objective.node_sizes(edges, ids).join(_by_remainder(ids, of), "id").select("id", "weight", "pid")


def _sql(view: str, *more: str, recursive: bool = False) -> str:
    """The graph of a view in SQL: pairs, e (canonical), a (adjacency), v (vertices), d (degrees), then ``more``."""
    parts = [
        f"pairs as ({VIEWS[view]})",
        "e as (select least(umi1, umi2) as src, greatest(umi1, umi2) as dst, count(*)::bigint as weight from pairs group by 1, 2)",
        "a as (select src, dst, weight from e union all select dst, src, weight from e where src <> dst)",
        "v as (select src as id from e union select dst from e)",
        "d as (select src as id, count(*)::bigint as degree from a group by 1)",
        *more[:-1],
    ]
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {more[-1]}"


_CC = (
    "reach(id, label) as (select id, id from v union select a.dst, reach.label from reach join a on a.src = reach.id where reach.label < a.dst)",
    "cc as (select id, min(label) as component from reach group by id)",
)


def _reach(edges: str) -> tuple[str, str]:
    """The same as ``_CC`` over (src, dst) rows of a table: a label is replaced where a smaller one arrives, so it ends soon on whole tables."""
    return (
        f"reached(id, label) using key (id) as (select id, id from v union select f.dst, min(c.label) from reached c join {edges} f on f.src = c.id join recurring.reached r on r.id = f.dst where c.label < r.label group by f.dst)",
        "cc as (select id, label as component from reached)",
    )


def _query(name: str, sql: str | None = None, whole: str | None = None):
    """Registers a query; one that takes a ``view`` also as NAME_whole over all rows, with ``whole`` as SQL where that of the thin one is recursive."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        if "view" in inspect.signature(f).parameters:
            QUERIES[f"{name}_whole"] = partial(f, view="order_part_whole")
            if whole is not None:
                ORACLES[f"{name}_whole"] = whole
            elif sql is not None and not sql.startswith("with recursive"):
                ORACLES[f"{name}_whole"] = sql.replace(VIEWS["order_part"], VIEWS["order_part_whole"])
        return f

    return keep


@_query("vertices", _sql("cust_supp", "select id from v"))
def _(spark, d):
    return graph.vertices(_edges(spark, d, "cust_supp"))


@_query("canonical_edges", _sql("user_slot", "select src, dst, weight from e"))
def _(spark, d):
    return _edges(spark, d, "user_slot")


@_query("adjacency", _sql("user_slot", "select src, dst, weight from a"))
def _(spark, d):
    return graph.adjacency(_edges(spark, d, "user_slot"))


@_query("degrees", _sql("user_slot", "select id, degree from d"))
def _(spark, d):
    return graph.degrees(_edges(spark, d, "user_slot"))


@_query("edge_totals", _sql("cust_supp", "select count(*)::bigint as edge_entry_count, sum(weight)::bigint as total_edge_weight from e"))
def _(spark, d):
    return graph.totals(_edges(spark, d, "cust_supp"))


@_query("graph_norm", _sql("user_slot", "select round(1e9 / (sum(degree) * sum(degree)), 6) as norm from d"))
def _(spark, d):
    return graph.norm(_edges(spark, d, "user_slot")).select(F.round(F.col("norm") * 1e9, 6).alias("norm"))


@_query("row_count", "select count(*)::bigint as n from lineitem")
def _(spark, d):
    return spark.createDataFrame([(sources.row_count(spark.read.parquet(f"{d}/lineitem.parquet")),)], "n long")


@_query("neighbors_of_node", _sql("user_slot", "select dst as id from a where src = 5 and dst <> 5"))
def _(spark, d):
    return graph.neighbors(_edges(spark, d, "user_slot"), 5)


@_query("incident_edges", _sql("user_slot", "select src, dst, weight from a where src = 5"))
def _(spark, d):
    return graph.incident_edges(_edges(spark, d, "user_slot"), 5)


@_query("edge_weight_lookup", _sql("user_slot", "select max(weight) as weight from e where src = 3 and dst = 8"))
def _(spark, d):
    return graph.edge_weight(_edges(spark, d, "user_slot"), 8, 3)


@_query("edges_in_selection", _sql("cust_supp", "select src, dst, weight from e where src in (2, 3, 4) or dst in (2, 3, 4)"))
def _(spark, d):
    return graph.edges_in_selection(_edges(spark, d, "cust_supp"), [2, 3, 4])


@_query("edges_of_selection_table", _sql("cust_supp", "select src, dst, weight from e where src % 50 = 1 or dst % 50 = 1"))
def _(spark, d):
    edges = _edges(spark, d, "cust_supp")
    return graph.edges_in_selection(edges, graph.vertices(edges).filter("id % 50 = 1"))


@_query("encoded_ids", _sql("order_part", "select id, (row_number() over (order by id) - 1)::bigint as idx from v"))
def _(spark, d, view="order_part"):
    return graph.encode_ids(graph.vertices(_edges(spark, d, view)))


@_query("encode_decode_round_trip", _sql("order_part", "select umi1, umi2, 1::bigint as weight from pairs"))
def _(spark, d, view="order_part"):
    raw = pairs(spark, d, view)
    mapping = graph.encode_ids(graph.vertices(raw, "umi1", "umi2"))
    return graph.decode_edges(graph.encode_edges(raw, mapping), mapping)


@_query("connected_components", _sql("order_part", *_CC, "select id, component from cc", recursive=True), _sql("order_part_whole", *_reach("a"), "select id, component from cc", recursive=True))
def _(spark, d, view="order_part"):
    edges = _edges(spark, d, view)
    return components.connected_components(edges)


@_query(
    "components_by_predicate",
    _sql("user_slot", "f as (select src, dst from a where weight >= 2 and src % 3 = dst % 3)", "reach(id, label) as (select id, id from v union select f.dst, reach.label from reach join f on f.src = reach.id where reach.label < f.dst)", "select id, min(label) as component from reach group by id", recursive=True),
)
def _(spark, d):
    return graph.components_by(_edges(spark, d, "user_slot"), (F.col("weight") >= 2) & (F.col("src") % 3 == F.col("dst") % 3))


_SIZES = ("s as (select count(*)::bigint as size from cc group by component)", "select size, count(*)::bigint as count from s group by size")


@_query("component_size_distribution", _sql("order_part", *_CC, *_SIZES, recursive=True), _sql("order_part_whole", *_reach("a"), *_SIZES, recursive=True))
def _(spark, d, view="order_part"):
    found = components.connected_components(_edges(spark, d, view))
    return statistics.size_distribution(found.groupBy("component").agg(F.count("*").alias("size")))


_PROPERTIES = (
    "s as (select count(*)::bigint as size from cc group by component)", "h as (select size, count(*)::bigint as n from s group by size)",
    "select sum(size * n)::bigint as node_count, (select sum(weight)::bigint from e) as edge_weight_sum, sum(n)::bigint as n_connected_components, round(max(size) / sum(size * n), 9) as fraction_in_largest_component, coalesce(sum(size * n) filter (size < 8), 0)::bigint as stranded_nodes, string_agg(size || ':' || n, ',' order by size) as component_size_distribution from h",
)


@_query("graph_properties", _sql("order_part", *_CC, *_PROPERTIES, recursive=True), _sql("order_part_whole", *_reach("a"), *_PROPERTIES, recursive=True))
def _(spark, d, view="order_part"):
    found = statistics.graph_properties(_edges(spark, d, view), stranded_below=8)
    return found.withColumns({"component_size_distribution": statistics.distribution_text(F.col("component_size_distribution")), "fraction_in_largest_component": F.round("fraction_in_largest_component", 9)})


_L = "l as (select id, id % 7 as pid from v)"
_N = "n as (select d.id, d.degree as weight, d.id % 7 as pid from d)"
_NC = "n as (select id, 1::bigint as weight, id % 7 as pid from v)"
_W = "w as (select a.src as id, n.pid, sum(a.weight) as w from a join n on n.id = a.dst where a.src <> a.dst group by 1, 2)"
_S = "s as (select pid, sum(weight) as s from n group by pid)"
_G = "g as (select 0.7 / (2 * sum(weight)) as g from e)"
_FULL = "f as (select n.id, n.pid as own, w.pid, w.w - g.g * n.weight * s.s as contrib, -coalesce(o.w, 0) + g.g * n.weight * (so.s - n.weight) as loss from n join w on w.id = n.id join s on s.pid = w.pid join s so on so.pid = n.pid left join w o on o.id = n.id and o.pid = n.pid cross join g)"


@_query("neighbor_label_mode", _sql("user_slot", _L, "c as (select a.src as id, l.pid, count(*)::bigint as n from a join l on l.id = a.dst group by 1, 2)", "r as (select id, pid, row_number() over (partition by id order by n desc, pid) as k from c)", "select id, pid as new from r where k = 1"))
def _(spark, d):
    edges = _edges(spark, d, "user_slot")
    return label_propagation.smallest_mode(graph.adjacency(edges), _by_remainder(graph.vertices(edges), 7))


def _lpa_sql(rounds: int) -> str:
    parts = ["l0 as (select id, id as pid from v)"]
    for k in range(rounds):
        parts += [
            f"c{k} as (select a.src as id, l{k}.pid, count(*) as n from a join l{k} on l{k}.id = a.dst group by 1, 2)",
            f"r{k} as (select id, pid, row_number() over (partition by id order by n desc, pid) as k from c{k})",
            f"l{k + 1} as (select id, pid from r{k} where k = 1)",
        ]
    return _sql("user_slot", *parts, f"select id, pid from l{rounds}")


@_query("lpa_k_rounds", _lpa_sql(3))
def _(spark, d):
    edges = _edges(spark, d, "user_slot")
    return label_propagation.synchronous_rounds(edges, partitions.singlets(graph.vertices(edges)), 3)


@_query("clean_partitions", _sql("order_part", "f2 as (select src, dst from a where src % 4 // 2 = dst % 4 // 2)", "reach(id, label) as (select id, id from v union select f2.dst, reach.label from reach join f2 on f2.src = reach.id where reach.label < f2.dst)", "select id, min(label) as pid from reach group by id", recursive=True), _sql("order_part_whole", "f2 as (select src, dst from a where src % 4 // 2 = dst % 4 // 2)", *_reach("f2"), "select id, component as pid from cc", recursive=True))
def _(spark, d, view="order_part"):
    edges = _edges(spark, d, view)
    labels = graph.vertices(edges).select("id", F.floor(F.col("id") % 4 / 2).alias("pid"))
    return partitions.split_disconnected(edges, labels)


@_query("singlet_partition", _sql("order_part", "select id, id as pid from v"))
def _(spark, d, view="order_part"):
    return partitions.singlets(graph.vertices(_edges(spark, d, view)))


@_query("null_partition", _sql("order_part", "select id, 0::bigint as pid from v"))
def _(spark, d, view="order_part"):
    return partitions.null_partition(graph.vertices(_edges(spark, d, view)))


@_query("updated_partition", _sql("order_part", "select id, case when id % 5 = 0 then -1 else id % 7 end as pid from v"))
def _(spark, d, view="order_part"):
    labels = _by_remainder(graph.vertices(_edges(spark, d, view)), 7)
    return partitions.update(labels, labels.filter("id % 5 = 0").select("id", F.lit(-1).cast("long").alias("pid")))


@_query("partition_weights", _sql("user_slot", _N, "select pid, sum(weight)::bigint as s from n group by pid"))
def _(spark, d):
    return quality.community_sizes(_nodes(_edges(spark, d, "user_slot"), 7))


@_query("partition_sizes", _sql("order_part", _L, "select pid, count(*)::bigint as size from l group by pid"))
def _(spark, d, view="order_part"):
    return partitions.sizes(_by_remainder(graph.vertices(_edges(spark, d, view)), 7))


@_query("num_partitions", _sql("order_part", _L, "select count(distinct pid)::bigint as n_partitions from l"))
def _(spark, d, view="order_part"):
    return partitions.num_partitions(_by_remainder(graph.vertices(_edges(spark, d, view)), 7))


@_query("largest_partition_size", _sql("order_part", _L, "select max(n)::bigint as size from (select count(*) as n from l group by pid)"))
def _(spark, d, view="order_part"):
    return partitions.largest_size(_by_remainder(graph.vertices(_edges(spark, d, view)), 7))


@_query("top_k_partitions", _sql("order_part", "l as (select id, id % 50 as pid from v)", "select pid, count(*)::bigint as size from l group by pid order by size desc, pid limit 5"))
def _(spark, d, view="order_part"):
    return partitions.top_k(_by_remainder(graph.vertices(_edges(spark, d, view)), 50), 5)


@_query("partition_members", _sql("order_part", _L, "select id from l where pid = 3"))
def _(spark, d, view="order_part"):
    return partitions.members(_by_remainder(graph.vertices(_edges(spark, d, view)), 7), 3)


@_query("is_singlet_partition", _sql("order_part", _L, "select count(*) = 1 as is_singlet from l where pid = 3"))
def _(spark, d, view="order_part"):
    return partitions.is_singlet(_by_remainder(graph.vertices(_edges(spark, d, view)), 7), 3)


@_query("fresh_partition_ids", _sql("order_part", "m as (select max(id % 7) as top from v)", "select id, top + row_number() over (order by id) as pid from v cross join m where id % 11 = 0"))
def _(spark, d, view="order_part"):
    ids = graph.vertices(_edges(spark, d, view))
    return partitions.fresh_ids(_by_remainder(ids, 7), ids.filter("id % 11 = 0"))


@_query("normalize_partitions", _sql("order_part", "l as (select id, id * 31 % 101 as pid from v)", "m as (select pid, min(id) as least from l group by pid)", "k as (select pid, row_number() over (order by least) - 1 as new from m)", "select id, new::bigint as pid from l join k using (pid)"))
def _(spark, d, view="order_part"):
    ids = graph.vertices(_edges(spark, d, view))
    return partitions.normalize(ids.select("id", (F.col("id") * 31 % 101).alias("pid")))


@_query("is_normalized", _sql("order_part", _L, "select max(pid) + 1 = count(distinct pid) as is_normalized from l"))
def _(spark, d, view="order_part"):
    return partitions.is_normalized(_by_remainder(graph.vertices(_edges(spark, d, view)), 7))


@_query("partition_matrix", _sql("order_part", _L, "select pid, id, 1.0::double as value from l"))
def _(spark, d, view="order_part"):
    return partitions.matrix(_by_remainder(graph.vertices(_edges(spark, d, view)), 7))


_Q = "round((select coalesce(sum(e.weight), 0) from e join n x on x.id = e.src join n y on y.id = e.dst where x.pid = y.pid) - {g} * (select sum(s * (s - 1) / 2) from s), 6)"


@_query("quality_modularity", _sql("user_slot", _N, _S, _G, f"select {_Q.format(g='(select g from g)')} as quality"))
def _(spark, d):
    edges = _edges(spark, d, "user_slot")
    total = graph.totals(edges).first()["total_edge_weight"]
    return quality.quality(edges, _nodes(edges, 7), quality.MODULARITY.scaled(0.7, total)).select(F.round("quality", 6).alias("quality"))


@_query("quality_cpm", _sql("user_slot", _NC, _S, f"select {_Q.format(g='0.5')} as quality"))
def _(spark, d):
    edges = _edges(spark, d, "user_slot")
    return quality.quality(edges, _nodes(edges, 7, quality.CPM), 0.5).select(F.round("quality", 6).alias("quality"))


@_query(
    "partition_statistics",
    _sql(
        "user_slot", _NC, _S, "z as (select count(*)::bigint as size from n group by pid)", "h as (select size, count(*)::bigint as n from z group by size)",
        f"select sum(size * n)::bigint as node_count, (select sum(weight)::bigint from e) as edge_weight_sum, (select coalesce(sum(weight), 0)::bigint from e where src % 7 <> dst % 7) as crossing_edge_weight, sum(n)::bigint as n_partitions, round(max(size) / sum(size * n), 9) as fraction_in_largest_partition, coalesce(sum(size * n) filter (size < 22), 0)::bigint as stranded_nodes, string_agg(size || ':' || n, ',' order by size) as partition_size_distribution, {_Q.format(g='0.5')} as quality from h",
    ),
)
def _(spark, d):
    edges = _edges(spark, d, "user_slot")
    found = statistics.partitioned_statistics(edges, _nodes(edges, 7, quality.CPM), 0.5, stranded_below=22)
    return found.withColumns({"partition_size_distribution": statistics.distribution_text(F.col("partition_size_distribution")), "fraction_in_largest_partition": F.round("fraction_in_largest_partition", 9), "quality": F.round("quality", 6)})


@_query("contrib_loss", _sql("user_slot", _N, _W, _S, _G, _FULL, "select id, own, pid, round(contrib, 6) as contrib, round(loss, 6) as loss from f"))
def _(spark, d):
    edges = _edges(spark, d, "user_slot")
    total = graph.totals(edges).first()["total_edge_weight"]
    found = quality.contributions(edges, _nodes(edges, 7), quality.MODULARITY.scaled(0.7, total))
    return found.withColumns({"contrib": F.round("contrib", 6), "loss": F.round("loss", 6)})


@_query("best_move", _sql("user_slot", _NC, _W, _S, "g as (select 0.5 as g)", _FULL, "r as (select *, row_number() over (partition by id order by contrib desc, pid desc) as k from f where pid <> own and contrib > 0)", "o as (select distinct id, own, loss from f)", "select o.id, o.own, r.pid as target, round(coalesce(r.contrib, 0) + o.loss, 6) as gain from o left join r on r.id = o.id and r.k = 1"))
def _(spark, d):
    edges = _edges(spark, d, "user_slot")
    return quality.best_moves(edges, _nodes(edges, 7, quality.CPM), 0.5).withColumn("gain", F.round("gain", 6))


@_query("move_delta", _sql("user_slot", _NC, _S, "select round((select coalesce(sum(a.weight), 0) from a where src = 5 and dst <> 5 and dst % 7 = 2) - 0.5 * (select s from s where pid = 2) - (select coalesce(sum(a.weight), 0) from a where src = 5 and dst % 7 = 5) + 0.5 * ((select s from s where pid = 5) - 1), 6) as delta"))
def _(spark, d):
    edges = _edges(spark, d, "user_slot")
    return quality.move_delta(edges, _nodes(edges, 7, quality.CPM), 0.5, 5, 2).select(F.round("delta", 6).alias("delta"))


@_query("well_connected_nodes", _sql("user_slot", _NC, _S, "i as (select src as id, sum(a.weight) as w from a where src <> dst and src % 7 = dst % 7 group by 1)", "select n.id from n join s using (pid) left join i on i.id = n.id where coalesce(i.w, 0) >= 0.9 * n.weight * (s.s - n.weight)"))
def _(spark, d):
    edges = _edges(spark, d, "user_slot")
    return quality.well_connected_nodes(edges, _nodes(edges, 7, quality.CPM).withColumnRenamed("pid", "super"), 0.9)


@_query(
    "well_connected_communities",
    _sql("user_slot", "n as (select id, 1::bigint as weight, id % 21 as pid, id % 7 as super from v)", "o as (select src % 21 as pid, sum(weight) as w from a where src % 7 = dst % 7 and src % 21 <> dst % 21 group by 1)", "c as (select pid, min(super) as super, sum(weight) as c from n group by pid)", "s as (select super, sum(weight) as s from n group by super)", "select c.pid from c join s using (super) left join o on o.pid = c.pid where coalesce(o.w, 0) >= 0.9 * c.c * (s.s - c.c)"),
)
def _(spark, d):
    edges = _edges(spark, d, "user_slot")
    nodes = graph.vertices(edges).select("id", F.lit(1).cast("long").alias("weight"), (F.col("id") % 21).alias("pid"), (F.col("id") % 7).alias("super"))
    return quality.well_connected_communities(edges, nodes, 0.9)


@_query("aggregate_graph", _sql("cust_supp", "select least(src % 40, dst % 40) as src, greatest(src % 40, dst % 40) as dst, sum(weight)::bigint as weight from e group by 1, 2"))
def _(spark, d):
    edges = _edges(spark, d, "cust_supp")
    return graph.contract(edges, _by_remainder(graph.vertices(edges), 40))


def _merge_sql(rule: str) -> str:
    return _sql("user_slot", "f as (select a.src, a.dst from a join d x on x.id = a.src join d y on y.id = a.dst where a.src <> a.dst and " + rule + ")", "reach(id, label) as (select id, id from v union select f.dst, reach.label from reach join f on f.src = reach.id where reach.label < f.dst)", "select id, min(label) as pid from reach group by id", recursive=True)


def _merged(spark: SparkSession, d: str, **threshold: float) -> DataFrame:
    return leiden.merge_highly_connected(leiden.start(_edges(spark, d, "user_slot"), 1.0), **threshold).labels()


@_query("merge_highly_connected_abs", _merge_sql("a.weight > 3"))
def _(spark, d):
    return _merged(spark, d, absolute=3)


@_query("merge_highly_connected_rel", _merge_sql("a.weight > 0.06 * least(x.degree, y.degree)"))
def _(spark, d):
    return _merged(spark, d, relative=0.06)


@_query("filter_crossing_edges", _sql("cust_supp", "select umi1, umi2, (umi1 % 9)::varchar as component from pairs where umi1 % 9 = umi2 % 9"))
def _(spark, d):
    raw = pairs(spark, d, "cust_supp")
    return sources.filter_crossing_edges(raw, _by_remainder(graph.vertices(raw, "umi1", "umi2"), 9))


@_query("filter_crossing_table", _sql("cust_supp", "select umi1, umi2, (umi1 % 9)::varchar as component from pairs where umi1 % 9 = umi2 % 9"))
def _(spark, d):
    raw, path = pairs(spark, d, "cust_supp"), fresh_path(spark, "edges")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    sources.write_edge_table(raw, table, path, max(8, buckets_of(sources.row_count(spark.read.parquet(f"{d}/lineitem.parquet")))))
    return sources.filter_crossing_table(spark, table, _by_remainder(graph.vertices(raw, "umi1", "umi2"), 9))


@_query("outer_product", "with a as (select n_nationkey as i, n_regionkey + 1 as x from nation), b as (select r_regionkey as j, r_regionkey * 2 + 1 as y from region) select i, j, x * y as value from a cross join b")
def _(spark, d):
    one = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("i"), (F.col("n_regionkey") + 1).alias("value"))
    two = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("i"), (F.col("r_regionkey") * 2 + 1).alias("value"))
    return scalars.outer(one, two)


@_query("matrix_trace", "select sum(n_nationkey)::bigint as trace from nation where n_nationkey = n_regionkey")
def _(spark, d):
    cells = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("j"), F.col("n_nationkey").alias("value"))
    return scalars.trace(cells)


@_query("mode_of_values", "with c as (select l_suppkey as k, l_linenumber as value, count(*)::bigint as n from lineitem group by 1, 2), r as (select *, row_number() over (partition by k order by n desc, value) as rank from c) select k, value, n from r where rank = 1")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("value"))
    return scalars.mode(rows, "k", "value")


# The iterative algorithms give labels that SQL can't, so their queries return what has to hold of any right
# result, next to figures that SQL knows: every vertex once, every community connected, weight kept, Q not below
# that of singlets.
def _checked(edges: DataFrame, labels: DataFrame, before: float, after: float) -> DataFrame:
    return _parts_checked(partitions.split_disconnected(edges, labels), labels, after >= before - 1e-9)


def _parts_checked(split: DataFrame, labels: DataFrame, not_worse: bool) -> DataFrame:
    parts = split.select("pid").distinct().agg(F.count("*").alias("parts"))
    whole = labels.agg(F.count("*").cast("long").alias("node_count"), F.count_distinct("id").alias("ids"), F.count_distinct("pid").alias("pids"))
    return whole.join(parts).select("node_count", (F.col("ids") == F.col("node_count")).alias("each_once"), (F.col("parts") == F.col("pids")).alias("connected"), F.lit(not_worse).alias("not_worse"))


def _removed(found: hybrid.Hybrid, kept: DataFrame) -> DataFrame:
    """The same of a hybrid, by the edges that are left once those between communities are gone: their components are the communities, their weight is
    what the statistics say, and Leiden has not lowered Q of the propagated labels."""
    before, after = found.before.select("node_count").first()[0], found.after_recovery.select("node_count", "edge_weight_sum").first()
    not_worse = found.recovered.first()[0] >= found.propagated.first()[0] - 1e-9
    weight = graph.totals(kept).first()["total_edge_weight"] == after["edge_weight_sum"]
    checked = _parts_checked(partitions.split_inside(kept, found.labels), found.labels, not_worse)
    return checked.withColumns({"each_once": F.col("each_once") & (F.col("node_count") == before) & (F.col("node_count") == after["node_count"]), "connected": F.col("connected") & F.lit(weight)})


_HOLDS = "select count(*)::bigint as node_count, true as each_once, true as connected, true as not_worse from v"


@_query("label_propagation", _sql("order_part", _HOLDS))
def _(spark, d, view="order_part"):
    edges = _edges(spark, d, view)
    return _checked(edges, label_propagation.fast_label_propagation(edges, epochs=1, seed=7), 0.0, 0.0)


def _leiden(spark: SparkSession, d: str, view: str, gamma: float, objective: quality.Objective) -> DataFrame:
    first = leiden.start(_edges(spark, d, view), gamma, objective, seed=7)
    last = leiden.leiden(first, randomness=1.0)
    return _checked(first.edges, last.labels(), first.quality(), last.quality())


@_query("leiden_modularity", _sql("order_part", _HOLDS))
def _(spark, d, view="order_part"):
    return _leiden(spark, d, view, 1.0, quality.MODULARITY)


@_query("leiden_cpm", _sql("order_part", _HOLDS))
def _(spark, d, view="order_part"):
    return _leiden(spark, d, view, 0.2, quality.CPM)


@sparing
def _inner(edges: DataFrame, labels: DataFrame, nodes: DataFrame, g: float) -> tuple[DataFrame, DataFrame, float, float]:
    """The edges inside labels, the labels, Q of singlets and of the labels: Q and the parts hang on no other edges, those of singlets on self-loops."""
    inner = cut(partitions.inside(edges, labels), "inner")
    before = quality.quality(edges.filter("src = dst"), nodes.withColumn("pid", F.col("id")), g).first()[0]
    return inner, labels, float(before), float(quality.quality(inner, nodes.join(labels, "id"), g).first()[0])


@_query("refine_partitions", _sql("order_part", _HOLDS))
def _(spark, d, view="order_part"):
    edges = cut(_edges(spark, d, view), "edges")
    level = leiden.start(edges, 0.2, quality.CPM, components.connected_components(edges).withColumnRenamed("component", "pid"), seed=7)
    refined = leiden.refine(level, randomness=1.0).select("id", F.col("refined").alias("pid"))
    return _checked(*_inner(edges, refined, level.nodes.drop("pid"), level.g))


@_query("hybrid", _sql("order_part", _HOLDS))
def _(spark, d, view="order_part"):
    raw = pairs(spark, d, view)
    found = hybrid.detect(graph.canonical_edges(raw), 1.0, recover=True, seed=7)
    kept = cut(graph.canonical_edges(sources.filter_crossing_edges(raw, partitions.normalize(found.labels))), "kept")
    return _removed(found, kept)


@_query("hybrid_conserves_weight", _sql("order_part", "select count(*)::bigint as node_count, true as weight_kept from v"))
def _(spark, d, view="order_part"):
    edges = _edges(spark, d, view)
    found = hybrid.detect(edges, 1.0, recover=False, seed=7)
    cut_off = statistics.crossing_weight(edges, found.labels)
    total = graph.totals(edges)
    return found.after_recovery.join(cut_off).join(total).select("node_count", (F.col("edge_weight_sum") + F.col("crossing_edge_weight") == F.col("total_edge_weight")).alias("weight_kept"))


# On cliques of ten with one edge between neighbours the communities are known: SQL names them, and singlets, one
# community for all and connected components (there is one) all fail.
_PLANTED = _sql("planted", "select id, min(id) over (partition by id // 10) as pid from v")


@_query("planted_leiden_cpm", _PLANTED)
def _(spark, d):
    last = leiden.leiden(leiden.start(_edges(spark, d, "planted"), 0.2, quality.CPM, seed=7), randomness=1.0)
    return partitions.canonical(last.labels())


# What Leiden says its quality is, and the quality of the cliques in SQL.
@_query("planted_leiden_quality", _sql("planted", "n as (select id, 1::bigint as weight, id // 10 as pid from v)", _S, f"select {_Q.format(g='0.2')} as quality, count(distinct pid)::bigint as n_partitions from n"))
def _(spark, d):
    last = leiden.leiden(leiden.start(_edges(spark, d, "planted"), 0.2, quality.CPM, seed=7), randomness=1.0)
    return partitions.num_partitions(last.labels()).select(F.round(F.lit(last.quality()), 6).alias("quality"), "n_partitions")


# The resolution is the number of vertices by 100, as with the hybrid below: then the cliques are the best partition at any size.
@_query("planted_leiden_modularity", _PLANTED)
def _(spark, d):
    edges = _edges(spark, d, "planted")
    last = leiden.leiden(leiden.start(edges, graph.vertices(edges).count() / 100, quality.MODULARITY, seed=7), randomness=1.0)
    return partitions.canonical(last.labels())


@_query("planted_refinement", _sql("planted", "select id, min(id) over (partition by id // 2) as pid from v"))
def _(spark, d):
    edges = _edges(spark, d, "planted")
    twos = graph.vertices(edges).select("id", _clique(F.col("id"), 2).alias("pid"))
    return leiden.refine(leiden.start(edges, 0.2, quality.CPM, twos, seed=7), randomness=1.0).select("id", F.col("refined").alias("pid"))


# A draw in label propagation may give two neighbouring cliques one label, so these count: one label in every clique, and
# labels for at least four cliques in five. The resolution of the hybrid's modularity grows with the graph, as the best
# partition at a fixed one merges cliques once there are many.
_WHOLE_CLIQUES = _sql("planted", "select id // 10 as clique, count(*)::bigint as nodes, 1::bigint as n_labels, true as told_apart from v group by 1")


def _cliques(labels: DataFrame) -> DataFrame:
    tagged = labels.select(_clique(F.col("id"), 10).alias("clique"), "pid")
    apart = tagged.agg((F.count_distinct("pid") >= 0.8 * F.count_distinct("clique")).alias("told_apart"))
    each = tagged.groupBy("clique").agg(F.count("*").alias("nodes"), F.count_distinct("pid").alias("n_labels"))
    return each.join(F.broadcast(apart))  # one row


@_query("planted_label_propagation", _WHOLE_CLIQUES)
def _(spark, d):
    return _cliques(label_propagation.fast_label_propagation(_edges(spark, d, "planted"), epochs=1, seed=7))


@_query("planted_hybrid", _WHOLE_CLIQUES)
def _(spark, d):
    edges = _edges(spark, d, "planted")
    return _cliques(hybrid.detect(edges, graph.vertices(edges).count() / 100, recover=True, seed=7).labels)


@_query("planted_hybrid_refined", _WHOLE_CLIQUES)
def _(spark, d):
    edges = _edges(spark, d, "planted")
    return _cliques(hybrid.detect(edges, graph.vertices(edges).count() / 100, recover=True, seed=7, refined=True).labels)


@_query("adjacency_packed", _sql("user_slot", "select src, dst, weight from a"))
def _(spark, d):
    return graph.unpacked(graph.packed_adjacency(_edges(spark, d, "user_slot"), chunk=16))


_CELLS = "c as (select l_partkey * 2 + 1 as i, l_suppkey * 2 as j, count(*)::bigint as weight from lineitem group by 1, 2)"


@_query("graph_from_matrix", f"with {_CELLS} select least(i, j) as src, greatest(i, j) as dst, weight from c")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_partkey") * 2 + 1).alias("i"), (F.col("l_suppkey") * 2).alias("j"))
    parts = buckets_of(sources.row_count(rows))
    cells = rows.repartition(parts, "i", "j").groupBy("i", "j").agg(F.count("*").alias("weight"))
    return graph.from_matrix(cells.unionByName(cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight")), parts=2 * parts)


@_query(
    "ids_by_first_appearance",
    "with r as (select l_orderkey, l_partkey, row_number() over () as n from lineitem), p as (select l_orderkey as id, n * 2 as place from r union all select l_partkey, n * 2 + 1 from r), f as (select id, min(place) as place from p group by id) select id, (row_number() over (order by place) - 1)::bigint as idx from f",
)
def _(spark, d):
    return graph.first_appearances(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", "l_partkey")


@_query(
    "bfs_levels",
    _sql("order_part_whole", "b(id, hop) using key (id) as (select id, 0::bigint from v where id % 1000 = 0 union select a.dst, min(b.hop) + 1 from b join a on a.src = b.id left join recurring.b r on r.id = a.dst where r.id is null group by a.dst)", "select id, hop from b", recursive=True),
)
def _(spark, d):
    edges = _edges(spark, d, "order_part_whole")
    return graph.bfs_levels(edges, graph.vertices(edges).filter("id % 1000 = 0"))


@_query("bfs_levels_of_heavy_edges", _sql("user_slot", "f as (select src, dst from a where weight >= 3)", "b(id, hop) using key (id) as (select id, 0::bigint from v where id < 3 union select f.dst, min(b.hop) + 1 from b join f on f.src = b.id left join recurring.b r on r.id = f.dst where r.id is null group by f.dst)", "select id, hop from b", recursive=True))
def _(spark, d):
    edges = _edges(spark, d, "user_slot")
    return graph.bfs_levels(edges, graph.vertices(edges).filter("id < 3"), F.col("weight") >= 3)


# Contributions that differ by some 1e-13, as sums in another order do, count as the same.
@_query("best_option_near_ties", _sql("user_slot", _NC, _W, "o as (select id, pid, w - 0.5 + ((id * 7 + pid * 3) % 5) * 1e-13 as contrib from w)", "t as (select *, max(contrib) over (partition by id) as top from o)", "select id, max(pid) as pid from t where abs(contrib - top) <= greatest(1e-12, 1e-8 * greatest(abs(contrib), abs(top))) group by id"))
def _(spark, d):
    edges = _edges(spark, d, "user_slot")
    near = quality.weights_to_communities(edges, _nodes(edges, 7, quality.CPM))
    noise = (F.col("id") * 7 + F.col("pid") * 3) % 5 * 1e-13
    return quality.near_best(near.select("id", "pid", (F.col("w") - 0.5 + noise).alias("contrib"))).select("id", "pid")
