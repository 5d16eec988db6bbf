"""The thin queries of the operators, and the SQL that some of them are held against."""

from __future__ import annotations

import zlib
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, gif, html_text, manifest, mixing, near_dup, pii, quality, runs, secrets, simhash, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_mixing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.blend(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@_query("op2_near_dup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)


URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


@_query("op3_url_filter")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


ORACLES["op3_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw_host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), named AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM named
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


WIDTH = 64
FRAME_ROWS = 65535
CLEAR = 255


def _stored(text: str) -> tuple:
    """A text as a GIF of grey samples, and what the canvas shows when that is played.

    The payload is dealt over two frames or more, each cleared away before the next is drawn; the last one is filled
    up with a transparent index, which UTF-8 never holds as a byte. Samples are read off the opaque parts of what is shown.
    """
    plain = text.encode("utf-8", "surrogatepass")
    padded = plain + bytes(-len(plain) % WIDTH or (WIDTH if not plain else 0))
    samples = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)
    height = min(-(-len(samples) // 2), FRAME_ROWS)
    filled = np.concatenate([samples, np.full((-len(samples) % height, WIDTH), CLEAR, np.uint8)])
    media = gif.encode([(filled[i : i + height], 40) for i in range(0, len(filled), height)], disposal=2, transparent=CLEAR)
    shown, shades, played = [], np.zeros(gif.BINS, np.int64), 0
    for frame in gif.decode(media):
        visible = frame.rgba[..., 0][frame.rgba[..., 3] > 0]
        shades += gif.histogram(visible)
        played += frame.delay_ms
        shown.append(visible.tobytes())
    payload = b"".join(shown)
    return (
        len(plain), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]),
        len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, shades.tolist())), len(shown), played,
    )


_STORED = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("n_frames", "long"), ("shown_ms", "long")]


@_query("op4_gif")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if k == "long" else pa.string() for _, k in _STORED]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [_stored(t.as_py() or "") for t in part.column("text")]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *(n for n, _ in _STORED)])

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.mapInArrow(store, "doc_id long, " + ", ".join(f"{n} {k}" for n, k in _STORED))


@_query("op8_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries, halves by a hash of the id: the second is scanned against the ledger of the first."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    earlier = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    first, ledger = secrets.findings(documents.filter(earlier), ["doc_id"])
    second, _ = secrets.findings(documents.filter(~earlier), ["doc_id"], ledger=ledger)
    rows = first.unionByName(second)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *(count(k) for k in secrets.BASE_KINDS),
        F.sha2(secrets.joined("spans", secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.joined("spans", secrets.KINDS).alias("spans"),
    )


@_query("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def _remainder(of: int):
    """Of the id's checksum; -1 for a row without an id, which is in no fold and held out of none."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)), F.lit(-1))


@_query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(documents, _table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", _remainder(3) != 1)
    scored = quality.score(documents, model)
    return scored.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", _remainder(4) != 2)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query("op5_html_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    read = html_text.main_text(pages, html_text.fit(pages))
    return read.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in pii.BASE_KINDS),
        F.sha2(pii.joined("spans", pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.joined("spans", pii.KINDS).alias("spans"),
    )


@_query("op11_simhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)


def _checksum():
    """Of the decimal id; null for a row without one."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


@_query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the texts is made periodic from some word on before the runs are looked for."""
    g = F.floor(F.col("h") / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", _checksum().alias("h"))
    chosen = documents.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("long"))
    planned = chosen.withColumn("a", F.when(F.col("n") > 0, g % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    altered = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    found = runs.periodic(planned.select("doc_id", F.when(F.col("a").isNotNull(), altered).otherwise(F.col("text")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    top = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query("op13_manifest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are verified after half of them, by their ids, have lost the line breaks of their text."""
    documents = _table(spark, sf_dir, "documents").select(*manifest.COLUMNS)
    tampered = F.when((_checksum() % 2 == 0) & F.contains("text", F.lit("\n")), manifest.leaf(*(F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in manifest.COLUMNS)))
    whole = manifest.leaf(*(F.col(c) for c in manifest.COLUMNS))
    hashed = documents.select("doc_id", "source", whole.alias("own"), tampered.alias("tampered"))
    found = manifest.manifest(hashed, digest=F.col("own"), keep=("tampered",))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), manifest.fold("path", F.coalesce("tampered", "leaf")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
