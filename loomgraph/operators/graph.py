"""An undirected weighted graph as DataFrames: canonical edges, adjacency, vertices, and what is read off them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.operators.partitions import dense_ids
from loomgraph.operators.skew import join_counted
from loomgraph.sessions import cut, drop_table
from loomgraph.sources.edges import required


def canonical_edges(pairs: DataFrame, src: str = "umi1", dst: str = "umi2", weight: Column | None = None) -> DataFrame:
    """(src <= dst, weight): parallel and reversed edges are one, their weights summed as long."""
    a, b = required(src), required(dst)
    worth = F.lit(1) if weight is None else weight
    edges = pairs.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), worth.cast("long").alias("weight"))
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def from_matrix(cells: DataFrame, row: str = "i", column: str = "j", weight: str = "weight", parts: int | None = None) -> DataFrame:
    """(src <= dst, weight) of a symmetric matrix in coordinates: every cell off the diagonal has its mirror, of the same weight.

    A cell without its mirror, of another weight than it, repeated or null ends the job. Both are met in one aggregation, dealt to
    ``parts`` tasks, which should grow with the cells; by default to as many as the session has.
    """
    i, j, w = required(row), required(column), required(weight)
    sides = cells.select(F.least(i, j).alias("src"), F.greatest(i, j).alias("dst"), w.cast("long").alias("w"), F.signum(F.when(i < j, 1).when(i > j, -1).otherwise(0)).cast("int").alias("side"))
    met = (sides if parts is None else sides.repartition(parts, "src", "dst")).groupBy("src", "dst").agg(F.count_if(F.col("side") < 0).alias("low"), F.count_if(F.col("side") > 0).alias("up"), F.count_if(F.col("side") == 0).alias("loop"), F.min("w").alias("least"), F.max("w").alias("most"))
    off = (F.col("src") < F.col("dst")) & (F.col("low") == 1) & (F.col("up") == 1) & (F.col("least") == F.col("most"))
    loop = (F.col("src") == F.col("dst")) & (F.col("loop") == 1)
    where = F.concat(F.lit("not symmetric at "), F.col("src"), F.lit(", "), F.col("dst"))
    return met.select("src", "dst", F.when(off | loop, F.col("least")).otherwise(F.raise_error(where).cast("long")).alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, a self-loop once."""
    return edges.select("src", "dst", "weight").union(edges.filter("src <> dst").select("dst", "src", "weight"))


def packed_adjacency(edges: DataFrame, chunk: int = 1024) -> DataFrame:
    """(id, chunk, near): the neighbours of each vertex as an array of (dst, weight) by dst, a hub's in numbered chunks.

    A hub of degree n has n / ``chunk`` chunks, to which its neighbours are dealt by a hash, so no array grows with the graph.
    """
    adj = adjacency(edges)
    sizes = adj.groupBy("src").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / chunk))
    dealt = join_counted(adj, sizes, "src", "n", edges.count() * 2)
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("dst"), F.col("chunks")).cast("int"))
    return dealt.groupBy(F.col("src").alias("id"), "chunk").agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("near"))


def unpacked(packed: DataFrame) -> DataFrame:
    """(src, dst, weight) of packed rows."""
    return packed.select(F.col("id").alias("src"), F.inline("near"))


def vertices(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.explode(F.array(src, dst)).alias("id")).distinct()


def degrees(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, degree): the number of adjacency entries, a self-loop counted once; 0 for vertices of ``ids`` without any."""
    counted = adjacency(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    if ids is None:
        return counted
    return ids.join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def totals(edges: DataFrame) -> DataFrame:
    """One row: entries and weight of the canonical edges."""
    return edges.agg(F.count("*").alias("edge_entry_count"), F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("total_edge_weight"))


def norm(edges: DataFrame) -> DataFrame:
    """One row: 1 / (sum of degrees) squared, null for a graph without edges."""
    return degrees(edges).agg((F.lit(1.0) / F.nullif(F.pow(F.sum("degree"), F.lit(2)), F.lit(0.0))).alias("norm"))


def edge_weight(edges: DataFrame, a: int, b: int) -> DataFrame:
    """One row; null where there is no such edge."""
    return edges.filter((F.col("src") == min(a, b)) & (F.col("dst") == max(a, b))).agg(F.max("weight").alias("weight"))


def neighbors(edges: DataFrame, node: int) -> DataFrame:
    return adjacency(edges).filter((F.col("src") == node) & (F.col("dst") != node)).select(F.col("dst").alias("id"))


def incident_edges(edges: DataFrame, node: int) -> DataFrame:
    return adjacency(edges).filter(F.col("src") == node)


def edges_in_selection(edges: DataFrame, selection: DataFrame | Iterable[int]) -> DataFrame:
    """Edges with an end in the selection, each once: a list is a filter, a DataFrame (id) two semi-joins."""
    if not isinstance(selection, DataFrame):
        chosen = list(selection)
        return edges.filter(F.col("src").isin(chosen) | F.col("dst").isin(chosen))
    ids = selection.select("id").distinct()
    here = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "weight")
    there = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")
    return here.union(there).distinct()


def components_by(edges: DataFrame, keep: Column, ids: DataFrame | None = None) -> DataFrame:
    """Components over the edges that ``keep`` accepts, (id, component) for every vertex."""
    return connected_components(edges.filter(keep), vertices(edges) if ids is None else ids)


def bfs_levels(edges: DataFrame, sources: DataFrame, keep: Column | None = None, max_hops: int | None = None) -> DataFrame:
    """(id, hop): every vertex that ``sources(id)`` reach over the edges that ``keep`` accepts, with the fewest edges to one of them.

    A step joins only the vertices of the last one with their neighbours; what was reached before is taken off by an anti-join.
    """
    adj = cut(adjacency(edges if keep is None else edges.filter(keep)).filter("src <> dst").select("src", "dst"), "adjacency")
    found = [cut(sources.select("id").distinct().withColumn("hop", F.lit(0).cast("long")), "hops")]
    while max_hops is None or len(found) <= max_hops:
        reached = adj.join(found[-1].select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        for before in found[-2:]:  # a neighbour of the last step is of that, of the one before or new
            reached = reached.join(before, "id", "left_anti")
        step = cut(reached.withColumn("hop", F.lit(len(found)).cast("long")), "hops")
        if step.isEmpty():
            break
        found.append(step)
    drop_table(adj)
    return reduce(DataFrame.unionByName, found)


def encode_ids(ids: DataFrame, column: str = "id") -> DataFrame:
    """(id, idx): consecutive numbers from 0 in ascending order of id, ranked by range partitions."""
    return dense_ids(ids.select(F.col(column).alias("id")).distinct(), "id", "idx")


def first_appearances(rows: DataFrame, src: str = "umi1", dst: str = "umi2") -> DataFrame:
    """(id, idx): numbers from 0 in the order in which ids first appear, row by row of the files of ``rows``, ``src`` before ``dst``.

    ``rows`` has to be read from Parquet files: places are those of files by name and of rows within them.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    ends = rows.select(F.array(F.struct(F.col(src).alias("id"), F.lit(0).alias("end")), F.struct(F.col(dst).alias("id"), F.lit(1).alias("end"))).alias("ends"), place.alias("at"))
    met = ends.select(F.inline("ends"), "at").groupBy("id").agg(F.min(F.struct("at.file", "at.row", "end")).alias("at"))
    return dense_ids(met, "at", "idx").select("id", "idx")


def encode_edges(pairs: DataFrame, mapping: DataFrame, src: str = "umi1", dst: str = "umi2") -> DataFrame:
    """(src, dst, weight 1) by index; an id without an index ends the job."""
    one = mapping.select(F.col("id").alias(src), F.col("idx").alias("_one"))
    two = mapping.select(F.col("id").alias(dst), F.col("idx").alias("_two"))
    both = pairs.join(one, src, "left").join(two, dst, "left")
    return both.select(required("_one").alias("src"), required("_two").alias("dst"), F.lit(1).cast("long").alias("weight"))


def decode_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    one = mapping.select(F.col("idx").alias("src"), F.col("id").alias("umi1"))
    two = mapping.select(F.col("idx").alias("dst"), F.col("id").alias("umi2"))
    return edges.join(one, "src").join(two, "dst").select("umi1", "umi2", "weight")


def contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The graph of labels: weights summed, what is inside a label a self-loop counted once."""
    one = labels.select(F.col("id").alias("src"), F.col("pid").alias("_one"))
    two = labels.select(F.col("id").alias("dst"), F.col("pid").alias("_two"))
    return canonical_edges(edges.join(one, "src").join(two, "dst"), "_one", "_two", F.col("weight"))
