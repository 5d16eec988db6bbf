"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``1101111`` hashes the words of a window at its ones and ignores the rest, so a copied
passage is found though words at ignored positions were replaced. The seeds of the benchmark go into a
bit table of bounded size. One pass over the documents keeps the windows that it lets through, gathered into
segments; their seeds are joined to the benchmark's, and each (segment, item, offset) is verified word by word:
matching words count 1, others -1, and every run of the alignment that reaches ``least_of`` the item is an overlap.

``least_of`` is six tenths of an item's words, ``LEAST`` at most, and all of an item of five words or fewer. Items of
6 to ``DROPPED`` words are hashed whole with each word left out in turn, shorter ones as they are. So of passages with
replaced words at random places found are, by words and replacements: 6 to 12 and 1: 1.00; 12 and 2: 0.95; 15 and
2: 1.00; 15 and 3: 0.97; 20 and 4: 0.99; 30 and 6: 1.00; 40 and 8: 1.00.

The bit table has 64 MB at most: beyond some 30 million seeds more windows pass it and are told apart by the
join. Seeds and items are broadcast where they are small (``BROADCAST_SEEDS``, ``BROADCAST_WORDS``), so that a phrase of
very many documents moves nowhere; larger ones are joined by shuffle, each key dealt over ``SALTS`` tasks.

Defined results: null or empty texts and items overlap with nothing; repeated items, and items without an id, each
report their own overlap; rows of equal id report an equal overlap once; rows without an id report theirs under a
null, and ``remove`` keeps them, as nothing says which of them is meant; empty tables give no rows. Words are runs of other
than ASCII white space in the lower-cased text, so a passage in capitals, with or without accents, is found too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bit_table, words
from loomgraph.sessions import cut, drop_table

MASKS = ("1101111", "1110111", "111101111", "1101101101", "11011011", "1010111")
LEAST = 10
DROPPED = 9
BROADCAST_SEEDS = 1_000_000
BROADCAST_WORDS = 4_000_000
SALTS = 16
_LONGS = pa.list_(pa.int64())
_SPREAD = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) | 1 for k in range(64)], np.uint64)


def least_of(words: int, least: int = LEAST) -> int:
    """Matches less mismatches that make an overlap with an item of so many words."""
    return words if words < 6 else min(least, -(-6 * words // 10))


def _masks(masks: tuple[str, ...], short: list[int]) -> list[tuple[int, list[int], bool]]:
    """(span, places that count, whether for whole items of that span only), in an order that numbers them."""
    out = [(len(m), [i for i, c in enumerate(m) if c == "1"], False) for m in masks]
    for n in short:
        out += [(n, [i for i in range(n) if i != gone], True) for gone in (range(n) if n > 5 else (-1,))]
    return out


def _seeds(h: np.ndarray, span: int, places: list[int], salt: int, scaled: dict) -> np.ndarray:
    """The seed at each place where the mask fits: a sum of the words' hashes, each times a factor of its place."""
    n = max(len(h) - span + 1, 0)
    out = np.full(n, salt + 1, np.uint64)
    for o in places if n else ():
        if o not in scaled:
            scaled[o] = h * _SPREAD[o]
        out += scaled[o][o : o + n]
    return out


def _inside(first: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Whether a window of ``span`` words from each place lies in one document."""
    return at + span <= first[np.searchsorted(first, at, "right")]


def item_words(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, item_words): the word hashes of each item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch.column(1)):
                lists = [part.hashes[a:b].view(np.int64) for a, b in zip(part.first[:-1], part.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.docs), pa.array(lists, _LONGS)], names=["item", "item_words"])

    return benchmark.select(F.col(item).alias("item"), F.lower(text).alias("_text")).mapInArrow(split, f"item {benchmark.schema[item].dataType.simpleString()}, item_words array<long>")


def item_seeds(items: DataFrame, masks: tuple[str, ...], short: list[int]) -> DataFrame:
    """(seed, item_no, at): the seeds of each item and where they begin; those of short items at their length only."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, scaled = own.values.to_numpy(zero_copy_only=False).view(np.uint64), {}
                for number, (span, at, whole) in enumerate(_masks(masks, short)):
                    if not whole or len(h) == span:
                        s = _seeds(h, span, at, number, scaled)
                        found.append(s)
                        owners.append(np.full(len(s), key))
                        places.append(np.arange(len(s), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(places))], names=["seed", "item_no", "at"])

    return items.select("item_no", "item_words").mapInArrow(seed, "seed long, item_no long, at int")


def _segments(documents: DataFrame, bits, masks: tuple[str, ...], short: list[int], context: int) -> DataFrame:
    """(id, begin, words, seeds, places): stretches of documents around the windows that pass the bit table."""
    known = _masks(masks, short)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            for part in words.chunks(batch.column(1)):
                h, scaled = part.hashes, {}
                found, values = [], []
                for number, (span, ones, _) in enumerate(known):
                    s = _seeds(h, span, ones, number, scaled)
                    at = bit_table.passing(table, s)
                    at = at[_inside(part.first, at, span)]
                    found.append(at)
                    values.append(s[at])
                if not sum(map(len, found)):
                    continue
                at, value = np.concatenate(found), np.concatenate(values)
                order = np.argsort(at, kind="stable")
                at, value = at[order], value[order]
                doc = np.searchsorted(part.first, at, "right") - 1
                new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 2 * context) | (np.diff(doc) > 0)]))
                rows: dict[str, list] = {"id": [], "begin": [], "words": [], "seeds": [], "places": []}
                for a, b in zip(new, np.append(new[1:], len(at)), strict=True):
                    d = doc[a]
                    lo = max(part.first[d], at[a] - context)
                    hi = min(part.first[d + 1], at[b - 1] + context)
                    rows["id"].append(batch.column(0)[part.lo + int(d)].as_py())
                    rows["begin"].append(int(lo - part.first[d]))
                    rows["words"].append(h[lo:hi].view(np.int64))
                    rows["seeds"].append(value[a:b].view(np.int64))
                    rows["places"].append((at[a:b] - lo).astype(np.int32))
                kinds = [batch.column(0).type, pa.int64(), _LONGS, _LONGS, pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    kind = documents.schema[0].dataType.simpleString()
    return documents.mapInArrow(search, f"id {kind}, begin long, words array<long>, seeds array<long>, places array<int>")


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """(score, begin, end) of the run with most matches less mismatches; the first of equally good ones."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -1))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(total[end] - low[end]), int(np.argmax(total[: end + 1] == low[end])), end


def runs(same: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the best run, then of the best on either side of it, as long as they reach ``least``."""
    open_ = [(0, len(same))]
    while open_:
        lo, hi = open_.pop()
        score, a, b = best_run(same[lo:hi])
        if score >= least:
            yield lo + a, lo + b
            open_ += [(lo + b, hi), (lo, lo + a)]


def _verified(pairs: DataFrame, kind: str, least: int) -> DataFrame:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            own, other = batch.column("words"), batch.column("item_words")
            for n, (key, item, begin, diagonal) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "item_no", "begin", "diagonal")), strict=True)):
                text, probe = (c[n].values.to_numpy(zero_copy_only=False) for c in (own, other))
                lo, hi = max(0, -diagonal), min(len(probe), len(text) - diagonal)
                same = text[lo + diagonal : hi + diagonal] == probe[lo:hi]
                out += [(key, item, begin + diagonal + lo + a, lo + a, b - a, int(same[a:b].sum())) for a, b in runs(same, least_of(len(probe), least))]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [batch.column("id").type, *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "item_no", "start_word", "item_start", "n_words", "n_same"])

    return pairs.mapInArrow(verify, f"id {kind}, item_no long, start_word long, item_start long, n_words long, n_same long")


def _joined(rows: DataFrame, table: DataFrame, key: str, small: bool) -> DataFrame:
    """Rows with the table's columns by ``key``: the table broadcast, or each key dealt over ``SALTS`` tasks by segment."""
    if small:
        return rows.join(F.broadcast(table), key)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int"))
    return dealt.join(table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"]).drop("_salt")


def overlaps(
    documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, least: int = LEAST,
    broadcast_seeds: int = BROADCAST_SEEDS, broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """(id, item, start_word, item_start, n_words, n_same): every verified overlap, in words of the document."""
    items = item_words(benchmark, item, item_text).filter(F.size("item_words") > 0).withColumn("item_no", F.monotonically_increasing_id())
    items = cut(items, "items")  # written with their numbers, which therefore never change
    n_words, longest = items.agg(F.coalesce(F.sum(F.size("item_words")), F.lit(0)), F.coalesce(F.max(F.size("item_words")), F.lit(0))).first()
    short = sorted(r["n"] for r in items.select(F.size("item_words").alias("n")).filter(F.col("n") <= DROPPED).distinct().collect())
    seeds = cut(item_seeds(items, masks, short), "seeds")
    n_seeds = seeds.count()
    bits = bit_table.build(seeds, "seed", n_seeds)
    kept = _segments(documents.select(F.col(id).alias("id"), F.lower(text).alias("_text")), bits, masks, short, longest)
    kept = cut(kept.withColumn("segment", F.monotonically_increasing_id()), "segments")
    hits = kept.select("segment", F.explode(F.arrays_zip("seeds", "places")).alias("hit")).select("segment", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("place"))
    pairs = _joined(hits, seeds, "seed", n_seeds <= broadcast_seeds).select("segment", "item_no", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    pairs = cut(pairs, "pairs")  # so that their size is known: segments, which are far larger, are shuffled only if these are too many to broadcast
    full = _joined(pairs.join(kept.select("segment", "id", "begin", "words"), "segment"), items.select("item_no", "item_words"), "item_no", n_words <= broadcast_words)
    found = cut(_verified(full, documents.schema[id].dataType.simpleString(), least), "overlaps")
    names = items.select("item_no", "item")
    named = found.join(F.broadcast(names) if n_words <= broadcast_words else names, "item_no").drop("item_no").distinct()
    drop_table(kept, seeds, pairs)
    return named.select(F.col("id").alias(id), F.col("item").alias(item), "start_word", "item_start", "n_words", "n_same")


def remove(documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The documents that overlap with no item, with the input's columns only."""
    bad = cut(overlaps(documents, benchmark, id, text, **more).select(id).filter(F.col(id).isNotNull()).distinct(), "bad")
    return bit_table.without(documents, bad, id)
