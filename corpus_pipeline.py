"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

1. quality: documents that the neighbour vote scores under ``MIN_QUALITY`` go.
2. near-dedup: one document of each near-duplicate group stays.
3. decontamination: documents that overlap with a benchmark item go.
4. secrets: found secrets are replaced in the text, ``n_chars`` follows it; every document stays.
5. mixing: how many words of each remaining document the mix takes.

Each stage reads what its predecessor kept and nothing else of ``documents``. Empty tables go through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, mixing, near_dup, quality, secrets
from loomgraph.sessions import fresh_path

MIN_QUALITY = 0.5


def _free(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labels outside the held-out third, like the operator's own query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    model = quality.fit(docs, labels, "quality", learn)
    own = _free("score", docs)
    return quality.score(docs, model, into=own).filter(F.col(own) >= MIN_QUALITY).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    blob, spans = _free("blob", docs), _free("spans", docs)
    rows, _ = secrets.scan(docs, blob=blob, spans=spans)
    masked = rows.withColumn("text", secrets.redacted(spans=spans))
    changed = F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", changed).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.blend(docs)


STAGES = [
    ("quality", by_quality),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("mixing", mixed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
