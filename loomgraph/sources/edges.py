"""Edge lists in and out: Parquet and CSV sources, partition and filtered-edge sinks, a seeded generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST_LONG = 2**63 - 1


def required(name: str) -> Column:
    """The column; a null in it ends the job with a message."""
    return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"null in {name}"))).otherwise(F.col(name))


def read_edges(spark: SparkSession, path: str, src: str = "umi1", dst: str = "umi2") -> DataFrame:
    """The whole edge list. Other columns are kept; the scan reads only those that a query uses."""
    edges = spark.read.parquet(path)
    for name in (src, dst):
        if name not in edges.columns:
            raise ValueError(f"{path} has no column {name}")
        if edges.schema[name].dataType.typeName() not in ("long", "integer", "short", "byte", "decimal"):
            raise ValueError(f"{name} is {edges.schema[name].dataType.simpleString()}, not an integer")
    return edges


def narrow_ids(edges: DataFrame, src: str = "umi1", dst: str = "umi2") -> DataFrame:
    """Ids as long where all fit, else unchanged: unsigned 64-bit ids are read as decimal(20, 0)."""
    if all(edges.schema[c].dataType.typeName() != "decimal" for c in (src, dst)):
        return edges
    top = edges.agg(F.max(F.greatest(F.col(src), F.col(dst)))).first()[0]
    if top is not None and top > LARGEST_LONG:
        return edges
    return edges.withColumns({c: F.col(c).cast("long") for c in (src, dst)})


def read_edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """The first two columns of a CSV file with a header; rows that aren't integers are left out."""
    rows = spark.read.csv(path, header=True)
    ends = rows.select(*(F.col(f"`{c}`").try_cast("long").alias(n) for c, n in zip(rows.columns, ("umi1", "umi2"), strict=False)))
    return ends.filter("umi1 is not null and umi2 is not null")


def read_partitions_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="id long, pid long", enforceSchema=True)


def row_count(edges: DataFrame) -> int:
    """From the files' footers where the source is Parquet."""
    return edges.count()


def edges_from_tuples(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "umi1 long, umi2 long")


def random_edges(spark: SparkSession, nodes: int, count: int, seed: int = 0) -> DataFrame:
    """Uniform pairs without self-pairs (with one node: loops), the same for the same seed on any partitioning."""
    draw = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(nodes))
    if nodes < 2:
        return spark.range(count).select(F.lit(0).cast("long").alias("umi1"), F.lit(0).cast("long").alias("umi2"))
    second = F.pmod(F.col("umi1") + 1 + F.pmod(F.xxhash64("id", F.lit(seed), F.lit(2)), F.lit(nodes - 1)), F.lit(nodes))
    return spark.range(count).withColumn("umi1", draw(1)).select("umi1", second.alias("umi2"))


def write_partitions(labels: DataFrame, path: str) -> None:
    labels.select(F.col("id").alias("umi"), F.col("pid").alias("partition_id")).write.mode("overwrite").parquet(path)


def filter_crossing_edges(edges: DataFrame, labels: DataFrame, src: str = "umi1", dst: str = "umi2") -> DataFrame:
    """Rows whose ends have the same label, all columns and repeated rows kept, with it as the string ``component``."""
    one = labels.select(F.col("id").alias("_a"), F.col("pid").alias("_pa"))
    two = labels.select(F.col("id").alias("_b"), F.col("pid").alias("_pb"))
    both = edges.join(one, F.col(src) == F.col("_a")).join(two, F.col(dst) == F.col("_b")).filter("_pa = _pb")
    return both.select(*edges.columns, F.col("_pa").cast("string").alias("component"))


def write_edge_table(edges: DataFrame, table: str, path: str, buckets: int, src: str = "umi1", dst: str = "umi2") -> None:
    """The edge list as a table of the catalog, its files in ``path``, bucketed and sorted by both ends: rows are moved once, here."""
    dealt = edges.repartition(buckets, src, dst)
    dealt.write.bucketBy(buckets, src, dst).sortBy(src, dst).option("path", path).mode("overwrite").format("parquet").saveAsTable(table)


def filter_crossing_table(spark: SparkSession, table: str, labels: DataFrame, src: str = "umi1", dst: str = "umi2") -> DataFrame:
    """The same as ``filter_crossing_edges`` of a table by ``write_edge_table``, whose rows stay in their buckets.

    Only its different pairs of ends are shuffled, without other columns, to be labelled; those within a label come back to the
    buckets.
    """
    raw = spark.table(table)
    kept = filter_crossing_edges(raw.select(src, dst).distinct(), labels, src, dst)
    return raw.join(kept, [src, dst]).select(*raw.columns, "component")
