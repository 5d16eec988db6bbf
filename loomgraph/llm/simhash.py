"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint takes a vote of its shingles: shingles of ``k`` words, repeats included, each hashed by XXH64;
a bit is 1 if more than half of the hashes have it. Fingerprints that differ in at most ``radius`` bits are linked.

Covering tables: the bits of a fingerprint are dealt vectors of radius + 1 bits, none of them zero. Each of the
2**(radius + 1) - 1 vectors v that aren't zero is a table; its mask has the bits whose vector has an odd product with v, about
half of all. However ``radius`` bits are chosen, their vectors span too little to reach every v, so some v
is even with all of them, and its mask has none of these bits. So every pair within the radius has
equal masked bits in some table: no link is lost, by construction and not by chance.

1. Equal fingerprints are one class; copies go no further.
2. The keys of each table are counted; only those that several classes share are compared.
3. A key of ``limit`` classes at most is compared in one task: classes not yet linked are searched from those that are, so a
   dense group costs little more than its size, and the links that span what it found are given.
4. A key of more classes is dealt again by masks over the bits that its own mask leaves free, by the same rule. About half of
   the free bits go each time, so after three deals there are fewer possible classes than the limit.
5. Components of all links give each document its smallest reachable id.

Nothing is bounded but the size of a comparison; fingerprints shared by a large part of the rows are joined by ``skew.join_counted``.

Defined results: a text without words (null, empty or white space) has fingerprint zero, which links like any other;
fewer than ``k`` words are one shingle; repeated rows are copies; rows that share an id but not a text are rows of their
own; a row without an id takes the smallest id of its component, null if there is none; an empty table gives no rows; ids may be
of any type that has an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bit_table, words
from loomgraph.llm.skew import join_counted
from loomgraph.operators.components import connected_components
from loomgraph.sessions import cut, drop_table

BITS = 64
RADIUS = 4
SEED = 42
LIMIT = 1 << 14
_STEP = 1 << 16
_CELLS = 1 << 20
_LANES = np.uint64(0x0101010101010101)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += np.uint8(32)


def _hashes(part: words.Words, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, its words lower-cased and joined by one space, and where those of each document begin."""
    word = words.is_word(part.data)
    kept = word.copy()
    kept[part.ends[part.ends < len(kept)]] = True  # one space after each word
    folded = np.where(word, _FOLD[part.data], np.uint8(32))
    text = folded[kept].tobytes()
    place = np.cumsum(kept)
    starts, ends = place[part.starts] - 1, place[part.ends - 1]
    counts = np.diff(part.first)
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(runs)])
    begin = np.arange(first[-1]) - np.repeat(first[:-1], runs) + np.repeat(part.first[:-1], runs)
    end = begin + np.repeat(np.minimum(counts, k), runs) - 1
    out = np.empty(first[-1], np.uint64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(out), _STEP):
        spans = zip(starts[begin[lo : lo + _STEP]].tolist(), ends[end[lo : lo + _STEP]].tolist(), strict=True)
        out[lo : lo + _STEP] = np.fromiter((digest(text[a:b], seed) for a, b in spans), np.uint64)
    return out, first


def vote(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The fingerprint of each document: bits set in more than half of its hashes, zero without any.

    Bits are summed eight at a time, each in a byte of its own, over runs of at most 255 hashes.
    """
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint64)
    if not len(full):
        return out
    pieces = -(-counts[full] // 255)
    piece = np.concatenate([[0], np.cumsum(pieces)])
    begins = (np.arange(piece[-1]) - np.repeat(piece[:-1], pieces)) * 255 + np.repeat(first[full], pieces)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, begins).astype("<u8").view(np.uint8).reshape(-1, 8)
        votes = np.add.reduceat(sums.astype(np.int64), piece[:-1], axis=0)
        won = (2 * votes > counts[full, None]).astype(np.uint64)
        out[full] |= (won << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(documents: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, seed: int = SEED) -> DataFrame:
    """(id, print): one row for each document, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch.column(1), hashed=False):
                prints = vote(*_hashes(part, k, seed))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.docs), pa.array(prints.view(np.int64))], names=["id", "print"])

    kind = documents.schema[id].dataType.simpleString()
    return documents.select(F.col(id).alias("id"), text).mapInArrow(run, f"id {kind}, print long")


def covering(used: int, radius: int, bits: int = BITS) -> list[int]:
    """Masks, each holding the bits of ``used``, such that any ``radius`` other bits are missing from one of them."""
    vectors = sorted(range(1, 2 ** (radius + 1)), key=lambda v: (v.bit_count(), v))  # a basis first: then no mask is ``used`` itself
    free = [b for b in range(bits) if not used >> b & 1]
    dealt = [(1 << b, vectors[n % len(vectors)]) for n, b in enumerate(free)]
    return sorted({used | sum(bit for bit, vector in dealt if (vector & v).bit_count() % 2) for v in vectors})


def spanning_links(prints: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among distinct ``prints`` (uint64) within the radius, as many as span their components."""
    out, left = [], prints
    while len(left) > 1:
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            step = max(1, _CELLS // len(left))
            some, reached = reached[:step], reached[step:]
            near = np.bitwise_count(some[:, None] ^ left[None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                out.append((some[near[:, hit].argmax(axis=0)], left[hit]))
                reached, left = np.concatenate([reached, left[hit]]), left[~hit]
    return out


def _compare(radius: int):
    """Over rows (key, print) sorted by key: the spanning links of each key. One key and one batch are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def linked(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            close = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius]
            found = [(prints[close], prints[close + 1])]
            for at in np.flatnonzero(sizes > 2):
                found += spanning_links(np.unique(prints[bounds[at] : bounds[at + 1]]), radius)
            sides = [pa.array(np.concatenate(side).view(np.int64)) for side in zip(*found, strict=True)]
            return pa.RecordBatch.from_arrays(sides, names=["src", "dst"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            prints = np.concatenate([prints, batch.column("print").to_numpy().view(np.uint64)])
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last:
                yield linked(keys[:last], prints[:last])
                keys, prints = keys[last:], prints[last:]
        if len(keys):
            yield linked(keys, prints)

    return run


def links(prints: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> list[DataFrame]:
    """Tables (src, dst) of links between distinct fingerprints ``prints(print)`` that span all components."""
    if limit < 1 << (radius + 2):
        raise ValueError("a limit so low that deals by further masks would not end")
    spark, found = prints.sparkSession, []
    rows, used = prints.select("print", F.lit(0).cast("long").alias("mask")), [0]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    while True:
        deals = [(m, n) for m in used for n in covering(m, radius)]
        used = sorted({n for _, n in deals})
        table = spark.createDataFrame([(signed(m), signed(n)) for m, n in deals], "mask long, next long")
        keyed = rows.join(F.broadcast(table), "mask").select("print", F.col("next").alias("mask"), F.xxhash64("next", F.col("print").bitwiseAND(F.col("next"))).alias("key"))
        shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
        large = shared.filter(F.col("n") > limit)
        near, _ = bit_table.split(keyed.select("key", "print"), shared.filter(F.col("n") <= limit).select("key"), "key")
        again = not large.isEmpty()
        if again:
            near = bit_table.without(near, large.select("key"), "key")
        found.append(cut(near.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(radius), "src long, dst long"), "links"))
        if again:
            rows = cut(join_counted(keyed, large, "key", "n", keyed.count()).select("print", "mask").distinct(), "large")
        drop_table(shared)
        if not again:
            return found


def components(documents: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, radius: int = RADIUS, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """One row for each document: (id, fingerprint, component_id), the fingerprint in 16 lowercase hex digits."""
    prints = cut(fingerprints(documents, id, text, k, seed), "prints")
    classes = cut(prints.groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    found = links(classes.select("print"), radius, limit)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    own = cut(connected_components(every).join(classes.withColumnRenamed("print", "id"), "id", "right").select(F.col("id").alias("print"), F.coalesce("component", "id").alias("component"), "rep", "copies"), "own")
    roots = own.groupBy("component").agg(F.min("rep").alias("root"), F.count("*").alias("m"))
    named = cut(join_counted(own, roots, "component", "m", own.count()).select("print", "root", "copies"), "roots")
    drop_table(classes, own, *found)
    out = join_counted(prints, named, "print", "copies", prints.count())
    return out.select(F.col("id").alias(id), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("root").alias("component_id"))
