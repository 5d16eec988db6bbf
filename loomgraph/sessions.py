"""The session's shared folder, and tables that cut a lineage there."""

from __future__ import annotations

import functools
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_leaving: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    A temporary folder is set only where none is named and the master is local, as in tests; on a cluster
    that is an error, as executors don't share the driver's disk.
    """
    found = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; the application's tables go when its driver ends."""
    own = f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}"
    if own not in _leaving:
        where, files = _file_system(spark, own)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _leaving.add(own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    A task that is lost later reads the written files again, so nothing upstream is run twice.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._cut_at = path  # for drop_table, which else has to list the files
    return table


def is_cut(df: DataFrame) -> bool:
    """Whether ``df`` is a table that ``cut`` wrote, as it was read back."""
    return hasattr(df, "_cut_at")


#: Rows that a bucket of ``dealt`` holds at most, about.
BUCKET_ROWS = 500_000


def buckets_of(rows: int) -> int:
    """How many buckets a table of ``rows`` gets: their number grows with the table, so none does."""
    return max(1, -(-rows // BUCKET_ROWS))


def dealt(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """The same as ``cut``, as a table of the catalog bucketed by ``key``: joins on it move only their other side, in each of the rounds that read it."""
    path = fresh_path(df.sparkSession, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    table = df.sparkSession.table(name)
    table._cut_at, table._named = path, name
    return table


def together(*jobs) -> list:
    """Independent writes, at the same time."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def observed(df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, dict]:
    """``df`` cut, and sums over its rows that are taken while it is written."""
    seen = Observation()
    out = cut(df.observe(seen, *(e.alias(n) for n, e in sums.items())), label)
    return out, seen.get


#: Spark broadcasts tables whose files have up to 10 MB, which may be ten times as much in rows, at each join of each round, all by way of the driver.
SPARING = {"spark.sql.autoBroadcastJoinThreshold": ("10485760b", "1m"), "spark.sql.sources.fileCompressionFactor": ("1.0", "8.0")}


def sparing(f):
    """A loop of rounds that broadcasts only what has about 1 MB in rows, so that what passes the driver doesn't grow with the graph. Settings that aren't Spark's own are kept."""

    @functools.wraps(f)
    def run(first, *args, **options):
        spark = (first if isinstance(first, DataFrame) else first.edges).sparkSession
        usual = [name for name, (default, _) in SPARING.items() if spark.conf.get(name, default) == default]
        for name in usual:
            spark.conf.set(name, SPARING[name][1])
        try:
            return f(first, *args, **options)
        finally:
            for name in usual:
                spark.conf.unset(name)

    return run


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table written by this library, through the file system that holds it."""
    where, files = _file_system(spark, path)
    files.delete(where, True)


def drop_table(*tables: DataFrame) -> None:
    """Delete the files behind tables that ``cut`` made, once nothing reads them any more."""
    for df in tables:
        path, name = getattr(df, "_cut_at", None), getattr(df, "_named", None)
        if name:
            df.sparkSession.sql(f"drop table if exists {name}")
        for folder in [path] if path else {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/loomgraph/" in folder:
                drop_path(df.sparkSession, folder)
