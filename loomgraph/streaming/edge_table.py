"""A canonical edge table kept up to date from a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.graph import canonical_edges


def keep_edge_table(pairs: DataFrame, path: str, checkpoint: str, src: str = "umi1", dst: str = "umi2") -> StreamingQuery:
    """Each micro-batch is aggregated to canonical edges and written under its own number.

    A batch that is run again after a failure replaces its own folder, so every edge counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        canonical_edges(batch, src, dst).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_edge_table(spark: SparkSession, path: str) -> DataFrame:
    """The edges of all batches, weights summed."""
    return spark.read.parquet(path).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
