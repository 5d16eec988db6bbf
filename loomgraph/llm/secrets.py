"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed by its SHA-256. The ledger holds the pairs (blob, rule
version) that were scanned, with their findings; ``scan`` reads only texts whose pair is not in it,
each once however often it occurs, and joins the findings back to every path that has the blob.

Most texts occur once and are new, and are scanned where they are: a bit table of bounded size tells them from
those that may repeat or be in the ledger. Only the latter are brought together by address. Likewise only rows
that may have findings take part in the join back, dealt by a salt, so one blob of very many paths is many tasks.

Spans are in code points, end exclusive. Base kinds: ``assign``, ``access`` and ``hex``; the method
adds ``pem`` (private key blocks) and ``forge`` (prefixed access tokens of code forges).

Defined results: a null text is the empty blob and has no findings; repeated texts share a blob and
give the same findings on every path; a ledger that repeats a pair, as a retried append may leave it, counts it
once; an empty table gives an empty ledger and no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bit_table
from loomgraph.sessions import cut, drop_table

RULE_VERSION = 1  # raise it with every change of the patterns: all blobs are then scanned again
KINDS = ("assign", "access", "hex", "pem", "forge")
BASE_KINDS = KINDS[:3]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,20}PRIVATE KEY-----")
_FORGE = re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")
_HINT = re.compile(r"[:=]")
SALTS = 16

SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as listed."""
    found: list[tuple[str, int, int]] = []
    if _HINT.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "-----BEGIN" in text:
        found += [("pem", *m.span()) for m in _PEM.finditer(text)]
    if "gh" in text and "_" in text:
        found += [("forge", *m.span()) for m in _FORGE.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _finder(table=None, n_hashes: int = 0):
    """(columns..., blob, text, spans) of (columns..., blob, text, hashes...): a text whose hashes may be in the table is kept for later, without spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            later = np.zeros(batch.num_rows, bool)
            columns = batch.columns[: batch.num_columns - n_hashes]
            for hashes in batch.columns[len(columns) :]:
                later[bit_table.passing(table.value, hashes.to_numpy().view(np.uint64))] = True
            texts = [t.as_py() for t in columns[-1]]
            spans = [None if wait else [dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t)] for t, wait in zip(texts, later, strict=True)]
            kept = [t if wait else None for t, wait in zip(texts, later, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(kept, pa.string()), pa.array(spans, _FOUND)], names=[*batch.schema.names[: len(columns)], "spans"])

    return run


def blob_of(text: str = "text"):
    """The content address: lowercase hex SHA-256 of the UTF-8 bytes, those of an empty text for a null."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _first_pass(versions: DataFrame, text: str, known: DataFrame | None, keep: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """(k0, k1, ..., blob, text, spans) of all rows, written, k0 and so on being the columns ``keep``; and the tables it hangs on.

    Texts that surely occur once and are not in the ledger have their spans, the others their text.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    # a hash of the text is enough to tell what may repeat: one that only seems to goes the longer way
    marks = versions.select(F.xxhash64(plain).alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    if known is not None:
        marks = marks.unionByName(known.select(F.xxhash64("blob").alias("h")))
    marks = cut(marks, "marks")
    table = bit_table.build(marks, "h")
    address = blob_of(text)
    hashes = [F.xxhash64(plain).alias("h"), *([] if known is None else [F.xxhash64(address).alias("known")])]
    kept = [F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)]
    kinds = "".join(f"k{n} {versions.schema[c].dataType.simpleString()}, " for n, c in enumerate(keep))
    rows = versions.select(*kept, address.alias("blob"), plain.alias("text"), *hashes)
    return cut(rows.mapInArrow(_finder(table, len(hashes)), f"{kinds}blob string, text string, spans {SPANS}"), "scanned"), [marks]


def _fresh(first: DataFrame, known: DataFrame | None, rule_version: int) -> DataFrame:
    """Ledger rows of a first pass, written: of what it scanned, and of each other blob that the ledger lacks."""
    once = first.filter("spans is null").groupBy("blob").agg(F.first("text").alias("text"))  # copies are dropped before the shuffle
    if known is not None:
        once = once.join(known.distinct(), "blob", "left_anti")
    found = once.mapInArrow(_finder(), f"blob string, text string, spans {SPANS}")
    both = first.filter("spans is not null").select("blob", "spans").unionByName(found.select("blob", "spans"))
    return cut(both.select("blob", F.lit(rule_version).alias("rule_version"), "spans"), "ledger")


def _known(ledger: DataFrame | None, rule_version: int) -> DataFrame | None:
    return None if ledger is None else ledger.filter(F.col("rule_version") == rule_version).select("blob")


def update(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob, rule_version, spans) for the pairs that ``ledger`` lacks."""
    known = _known(ledger, rule_version)
    first, more = _first_pass(versions, text, known, [])
    out = _fresh(first, known, rule_version)
    drop_table(first, *more)
    return out


def findings(
    versions: DataFrame, keep: list[str], text: str = "text", ledger: DataFrame | None = None, rule_version: int = RULE_VERSION
) -> tuple[DataFrame, DataFrame]:
    """(keep..., blob, spans) of every row, without its text, and the ledger to keep for the next run.

    Texts are read once to tell what may repeat and once more to address and scan them. Only rows that may be copies, or are in the
    ledger, are joined to the findings, by their address alone.
    """
    known = _known(ledger, rule_version)
    first, more = _first_pass(versions, text, known, keep)
    fresh = _fresh(first, known, rule_version)
    whole = fresh if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(fresh)
    hits = whole.filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select("blob", F.col("spans").alias("found"))
    dealt = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    later = first.filter("spans is null").drop("text", "spans").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    joined_ = later.join(dealt, ["blob", "salt"], "left").withColumn("spans", F.coalesce("found", F.array().cast(SPANS)))
    names = [f"k{n}" for n in range(len(keep))]
    rows = first.filter("spans is not null").select(*names, "blob", "spans").unionByName(joined_.select(*names, "blob", "spans"))
    drop_table(*more)
    return rows.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "blob", "spans"), whole


def scan(
    versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rule_version: int = RULE_VERSION, blob: str = "blob", spans: str = "spans"
) -> tuple[DataFrame, DataFrame]:
    """The rows with ``blob`` and ``spans``, in place of columns of these names, and the ledger to keep for the next run.

    Only blobs with findings take part in the join back; the rest get an empty array.
    """
    fresh = update(versions, text, ledger, rule_version)
    whole = fresh if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(fresh)
    hits = whole.filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).dropDuplicates(["blob"])
    hits = cut(hits.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), "hits")
    rows = versions.withColumn(blob, blob_of(text)).drop(spans)
    out, none = rows.columns, F.array().cast(SPANS)
    salt = next(n for k in range(len(out) + 1) if (n := f"_salt{k}") not in {c.lower() for c in (*out, spans)})
    near, far = bit_table.split(rows, hits.select(blob), blob)
    dealt = hits.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = near.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(dealt, [blob, salt], "left")
    return near.select(*out, F.coalesce(spans, none).alias(spans)).unionByName(far.select(*out, none.alias(spans))), whole


def joined(spans, kinds: tuple[str, ...]):
    """``kind:start:end`` of the kinds asked for, comma-joined in the order of ``spans``."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _masked(text: str, spans, by: str) -> str:
    out, at = [], -1  # where what is masked ends
    for s in spans:
        if s["start"] > at:
            out += [text[max(at, 0) : s["start"]], by]
        at = max(at, s["end"])
    return "".join([*out, text[max(at, 0) :]])


def redacted(text: str = "text", spans: str = "spans", by: str = "[secret]") -> Column:
    """The text with ``by`` in place of every span; spans that overlap or touch count as one. Only texts with spans go to Python."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _masked(t, s, by) for t, s in zip(texts, found, strict=True)], dtype=object)

    some = F.size(spans) > 0
    return F.when(some, mask(F.when(some, F.col(text)), F.when(some, F.col(spans)))).otherwise(F.col(text))
