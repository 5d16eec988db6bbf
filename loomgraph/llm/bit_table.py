"""Bit tables: which hashes may be among those of a table, in a broadcast of bounded size.

A table has about 16 bits for each hash, two of them set, and ``MAX_BITS`` at most. A hash that is in the table
always passes; another passes in about 1 of 70 cases, more often where the table is full. So it may only
be used to keep rows away from a join or an exact check, never in its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS = 29  # 64 MB
PER_HASH = 16
SLICE = 1 << 18
PER_TASK = 1 << 20
MAX_BUCKETS = 1 << 22


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)


def passing(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of ``hashes`` (uint64) that pass."""
    one, two = _places(hashes, (len(table) * 8).bit_length() - 1)
    look = lambda at: table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
    at = np.flatnonzero(look(one))
    return at[look(two[at]) == 1]


def build(hashes: DataFrame, column: str, count: int | None = None) -> Broadcast:
    """The packed table of a long column, broadcast.

    As many tasks as the hashes have set the bits of their share, in slices of ``SLICE`` bytes; slices of the same place are put
    together by shuffle, so the driver gets each part of the table once, slice by slice.
    """
    n = hashes.count() if count is None else count
    bits = min(max(n * PER_HASH, 1 << 10).bit_length(), MAX_BITS)
    size = (1 << bits) // 8

    def slices(table: np.ndarray) -> pa.RecordBatch:
        starts = [at for at in range(0, size, SLICE) if table[at : at + SLICE].any()]
        parts = [table[at : at + SLICE].tobytes() for at in starts]
        return pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], names=["start", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(table, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield slices(table)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for start, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(part.as_py(), np.uint8)
                own[start] = own[start] | part if start in own else part
        for start, part in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["start", "bits"])

    out = np.zeros(size, np.uint8)
    if n:
        kind = "start long, bits binary"
        tasks = max(1, min(-(-n // PER_TASK), hashes.sparkSession.sparkContext.defaultParallelism * 4))
        marked = hashes.select(column).coalesce(tasks).mapInArrow(mark, kind)
        whole = marked if tasks == 1 else marked.repartition("start").mapInArrow(merge, kind)
        for r in whole.toLocalIterator():
            out[r["start"] : r["start"] + SLICE] = np.frombuffer(r["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def split(rows: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have a key among ``keys`` (of the same name), and the rest, which surely hasn't.

    So that only the former have to be shuffled for a join. Told by the bucket of the key's hash: 64 buckets for a key,
    ``MAX_BUCKETS`` at most, of which those that hold a key are broadcast. Rows never leave the JVM for this.
    """
    buckets = min(max(keys.count() * 64, 1 << 10), MAX_BUCKETS)
    taken = {c.lower() for c in rows.columns}
    at = next(n for k in range(len(taken) + 1) if (n := f"_at{k}") not in taken)
    spot = F.pmod(F.xxhash64(column), F.lit(buckets)).alias(at)
    held, marked = F.broadcast(keys.select(spot).distinct()), rows.select("*", spot)
    return marked.join(held, at, "left_semi").drop(at), marked.join(held, at, "left_anti").drop(at)


def without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` whose key is none of ``keys``; those with a null stay."""
    near, far = split(rows, keys, column)
    return near.join(keys, column, "left_anti").select(*rows.columns).unionByName(far.select(*rows.columns))
