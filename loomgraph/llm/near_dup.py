"""MinHash near-duplicate detection with tensored banding.

A document is the set of its distinct shingles of ``k`` words (a shorter one its whole sequence). Two
collections of ``m`` half-keys, ``r`` minhashes each, are computed; every pair of a half-key of the first
and one of the second is the key of a table. So m*m tables with keys of 2r minhashes cost 2*m*r minhashes
in place of 2*r*m*m. Two documents of similarity s share a table with probability (1 - (1 - s**r)**m)**2: with r = 3
and m = 11 that is 0.9993 at 0.8, 0.9999 at 0.85, 0.59 at 0.5 and 0.07 at 0.3.

1. Documents with equal sets are one class; copies go no further. A class has a number of its own, so rows
   that share an id but not a text are told apart.
2. A half-key that one class alone has makes no table: a bit table of those that several have (bounded size, broadcast)
   leaves most classes with nothing to pair, so few table keys are ever written.
3. Each table bucket hangs its classes on one of them (the pivot, of the smallest fingerprint): one row for each class
   and pivot, not one for each pair. The classes of a pivot over all tables are its family; two classes that share any
   bucket share the family of that bucket's pivot.
4. Families are dealt into blocks of about ``BLOCK`` classes, the pivot in each. A block compares all its
   classes on their full sets and gives the links that span what it found.
5. Classes of a family in different blocks are compared too, block by block, unless both already belong to
   the family's largest component. So no link between candidates is lost, and no pair is ever a row.
6. Components of all links give each document its smallest reachable id.

The hub of a family of any size is spread over many blocks; buckets, families, components and sets of copies that hold
a large share of the rows are joined by ``skew.join_counted``. Only texts of classes with candidates are read again, and only
those are shuffled. What remains quadratic is the number of blocks that hold classes outside a large family's main
component, times the number of its blocks.

Defined results: a null or empty text has an empty set, links with nothing and is kept; repeated rows are copies; ids
may be of any type that has an order; rows that share an id but not a text are documents of their own; an empty table
gives no rows; rows without an id link with nothing, have a null component and are kept, unless an identical text
has an id: then they are copies of that one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bit_table, words
from loomgraph.llm.skew import join_counted
from loomgraph.operators.components import connected_components
from loomgraph.sessions import cut, drop_table

HALVES = 11
ROWS = 3
BLOCK = 256
_LONGS = pa.list_(pa.int64())


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = words.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return draw[:n] | np.uint64(1), draw[n:]


def _first_of_each(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Two sums over each set that equal sets share."""
    out = np.zeros((2, len(sets)), np.uint64)
    for i, s in enumerate(sets):
        out[0, i], out[1, i] = s.sum(dtype=np.uint64), words.mix(s).sum(dtype=np.uint64)
    return out.view(np.int64)


def signatures(documents: DataFrame, id: str, text: str, k: int, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """(id, n, fp1, fp2, a, b): set size, a fingerprint of the set, and both collections of half-keys.

    Half-keys of different places differ, as each is hashed with its number.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, flips = _factors(2 * halves * rows)
        for batch in batches:
            for part in words.chunks(batch.column(1)):
                h, first = words.windows(part, k)
                sets = _first_of_each(h, first)
                sizes = np.array([len(s) for s in sets])
                full = sizes > 0
                keys = np.zeros((len(sets), 2 * halves), np.int64)
                prints = _fingerprints(sets)
                if full.any():
                    flat = np.concatenate(sets)
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    least = [np.minimum.reduceat((flat ^ flips[i]) * times[i], starts) for i in range(len(times))]
                    for j in range(2 * halves):
                        key = np.full(len(starts), j, np.uint64)
                        for i in range(rows):
                            key = words.mix(key * np.uint64(3) + least[j * rows + i])
                        keys[full, j] = key.view(np.int64)
                ids = batch.column(0).slice(part.lo, part.docs)
                halved = [pa.array(list(side), _LONGS) for side in (keys[:, :halves], keys[:, halves:])]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes, pa.int64()), pa.array(prints[0]), pa.array(prints[1]), *halved], names=["id", "n", "fp1", "fp2", "a", "b"]
                )

    kind = documents.schema[id].dataType.simpleString()
    return documents.select(F.col(id).alias("id"), text).mapInArrow(sign, f"id {kind}, n long, fp1 long, fp2 long, a array<long>, b array<long>")


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of (id, fp1, fp2, text): the distinct shingle hashes, sorted, where the text is that of the fingerprint."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = np.stack([batch.column(c).to_numpy() for c in ("fp1", "fp2")])
            for part in words.chunks(batch.column("text")):
                sets = _first_of_each(*words.windows(part, k))
                right = (_fingerprints(sets) == want[:, part.lo : part.lo + part.docs]).all(axis=0)
                ids = batch.column("id").slice(part.lo, part.docs).filter(pa.array(right))
                yield pa.RecordBatch.from_arrays([ids, pa.array([s.view(np.int64) for s, ok in zip(sets, right, strict=True) if ok], _LONGS)], names=["id", "shingles"])

    return texts.select("id", "fp1", "fp2", "text").mapInArrow(collect, "id long, shingles array<long>")


def table_keys(classes: DataFrame, shared) -> DataFrame:
    """(key, id, fp1): the tables of each class, from half-keys of both collections that pass the bit table."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sides, open_ = batch.num_rows, [], []
            for name in ("a", "b"):
                half = batch.column(name).flatten().to_numpy().view(np.uint64)
                may = np.zeros(len(half), bool)
                may[bit_table.passing(shared.value, half)] = True
                sides.append(half.reshape(n, -1))
                open_.append(may.reshape(n, -1))
            rows = np.flatnonzero(open_[0].any(axis=1) & open_[1].any(axis=1))
            both = open_[0][rows, :, None] & open_[1][rows, None, :]
            keys = words.mix(sides[0][rows, :, None] * np.uint64(3) + sides[1][rows, None, :])[both].view(np.int64)
            owner = rows[np.nonzero(both)[0]]
            ids, prints = (batch.column(c).to_numpy()[owner] for c in ("id", "fp1"))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(prints)], names=["key", "id", "fp1"])

    return classes.select("id", "fp1", "a", "b").mapInArrow(pair, "key long, id long, fp1 long")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning_links(sets: list[np.ndarray], percent: int, known: list | None = None) -> list[tuple[int, int]]:
    """Links with 100 * intersection >= percent * union among ``sets``, as many as span their components.

    Intersections are counted exactly: shingles held by two sets or more, as columns of a 0/1 matrix, in
    slices of bounded size. Sets with the same value in ``known`` count as linked before.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        common = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2)
    else:
        owner = np.repeat(np.arange(n), sizes)
        values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        keep = shared[column]
        owner, column = owner[keep], place[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((n, n), np.int64)  # a slice counts up to its width, which float32 holds exactly
        width = max(1, 4_000_000 // n)
        for lo in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(column, (lo, lo + width))
            held = np.zeros((n, width), np.float32)
            held[owner[a:b], column[a:b] - lo] = 1
            common += (held @ held.T).astype(np.int64)
    forest = _Forest(n)
    if known is not None:
        seen: dict = {}
        for i, c in enumerate(known):
            forest.join(i, seen.setdefault(c, i))
    union = sizes[:, None] + sizes[None, :] - common
    linked = np.triu(100 * common >= percent * union, 1)
    return [(int(i), int(j)) for i, j in np.argwhere(linked) if forest.join(int(i), int(j))]


def _links_by_group(keys: list[str], percent: int, known: bool):
    """Over rows sorted by ``keys``: the spanning links of each group. One group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        out: list[tuple[int, int]] = []

        def close() -> None:
            once = {r[0]: r for r in held}
            rows = list(once.values())
            if len(rows) > 1:
                comps = [r[2] for r in rows] if known else None
                if comps is None or len(set(comps)) > 1:
                    out.extend((rows[i][0], rows[j][0]) for i, j in spanning_links([r[1] for r in rows], percent, comps))

        for batch in batches:
            names = [c.to_pylist() for c in (batch.column(k) for k in keys)]
            ids = batch.column("id").to_pylist()
            comps = batch.column("component").to_pylist() if known else ids
            sets = batch.column("shingles")
            for n, key in enumerate(zip(*names, strict=True)):
                if key != at:
                    close()
                    held, at = [], key
                held.append((ids[n], sets[n].values.to_numpy(zero_copy_only=False).view(np.uint64), comps[n]))
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist([{"src": a, "dst": b} for a, b in out], schema=pa.schema([("src", pa.int64()), ("dst", pa.int64())]))
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist([{"src": a, "dst": b} for a, b in out], schema=pa.schema([("src", pa.int64()), ("dst", pa.int64())]))

    return run


def _compared(rows: DataFrame, keys: list[str], percent: int, known: bool = False) -> DataFrame:
    columns = [*keys, "id", "shingles", *(["component"] if known else [])]
    dealt = rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_links_by_group(keys, percent, known), "src long, dst long")


def components(
    documents: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, halves: int = HALVES, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """One row for each document: (id, n_shingles, component_id, kept)."""
    signed = cut(signatures(documents, id, text, k, halves, rows), "signed")
    same = ["n", "fp1", "fp2"]
    grouped = signed.filter("n > 0").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = cut(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")  # written with their numbers
    star, rest = _families(classes.filter("rep is not null"))

    members = star.select("pivot", "id")
    wanted = members.select("id").union(members.select("pivot")).distinct()
    located = cut(classes.select("id", "rep", "fp1", "fp2").join(wanted, "id"), "located")
    texts = documents.select(F.col(id).alias("rep"), F.col(text).alias("text"))
    near, _ = bit_table.split(texts, located.select("rep"), "rep")
    # the ids grow with the corpus, so these joins are sort-merge at every size
    sets = cut(shingle_sets(near.join(located.hint("merge"), "rep"), k), "sets")

    sizes = star.groupBy("pivot").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    dealt = join_counted(members, sizes, "pivot", "m", star.count())
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    hubs = sizes.select("pivot", F.col("pivot").alias("id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    within = dealt.select("pivot", "id", "block").unionByName(hubs)
    found = cut(_compared(within.join(sets.hint("merge"), "id"), ["pivot", "block"], percent), "links")

    wide = cut(dealt.filter("blocks > 1").select("pivot", "id"), "wide")
    if not wide.isEmpty():
        found = found.unionByName(cut(_compared(_across(wide, connected_components(found), block).join(sets, "id"), ["pivot", "left", "right"], percent, known=True), "links"))
    linked = cut(connected_components(found).join(classes.select("id", "rep"), "id"), "linked")
    tops = linked.groupBy("component").agg(F.min("rep").alias("root"), F.count("*").alias("m"))
    rooted = join_counted(linked.select("id", "component"), tops, "component", "m", linked.count()).select("id", "root")
    reps = cut(classes.select("id", *same, "rep", "copies").join(rooted, "id", "left").select(*same, F.coalesce("root", "rep").alias("root"), "copies"), "roots")
    drop_table(classes, located, sets, wide, found, linked, *rest)

    full = join_counted(signed.filter("n > 0").select("id", *same), reps, same, "copies", signed.count())
    empty = signed.filter("n = 0").select("id", *same, F.col("id").alias("root"))
    out = full.unionByName(empty)
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), root.alias("component_id"), (F.col("id").eqNullSafe(root)).alias("kept"))


def _families(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(id, pivot) of the classes that share a table bucket, and the tables it is made of."""
    halves = classes.select(F.explode(F.concat("a", "b")).alias("key"))
    shared = cut(halves.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"), "halves")
    buckets = cut(table_keys(classes, bit_table.build(shared, "key")), "buckets")
    pivots = cut(buckets.groupBy("key").agg(F.min_by("id", "fp1").alias("pivot"), F.count("*").alias("m")).filter("m > 1"), "pivots")
    star = cut(join_counted(buckets.select("key", "id"), pivots, "key", "m", buckets.count()).filter("id <> pivot").select("id", "pivot").distinct(), "families")
    drop_table(shared, buckets, pivots)
    return star, [star]


def _across(wide: DataFrame, known: DataFrame, block: int) -> DataFrame:
    """Rows for pairs of blocks of a family that may hold links between components.

    Blocks of classes outside the family's largest component meet each other and those of it.
    """
    tagged = cut(wide.join(known, "id", "left").withColumn("component", F.coalesce("component", "id")), "tagged")
    counts = tagged.groupBy("pivot", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("pivot").agg(F.max(F.struct("c", -F.col("component"))).alias("top"), F.sum("c").alias("m"))
    main = main.select("pivot", (-F.col("top.col2")).alias("top"), F.col("top.c").alias("n_top"), (F.col("m") - F.col("top.c")).alias("n_rest")).filter("n_rest > 0")
    split = tagged.join(main, "pivot").withColumns(
        {"b_top": F.ceil(F.col("n_top") / block).cast("int"), "b_rest": F.ceil(F.col("n_rest") / block).cast("int"), "is_top": F.col("component") == F.col("top")}
    )
    here = F.when(F.col("is_top"), F.pmod(F.xxhash64("id"), F.col("b_top"))).otherwise(F.pmod(F.xxhash64("id"), F.col("b_rest"))).cast("int")
    split = split.withColumn("here", here)
    rest = F.sequence(F.lit(0), F.col("b_rest") - 1)
    meet_rest = F.transform(rest, lambda o: F.struct(F.least(o, F.col("here")).alias("left"), F.greatest(o, F.col("here")).alias("right")))
    meet_top = F.transform(F.sequence(F.lit(0), F.col("b_top") - 1), lambda o: F.struct(F.col("here").alias("left"), (-1 - o).alias("right")))
    from_top = F.transform(rest, lambda o: F.struct(o.alias("left"), (-1 - F.col("here")).alias("right")))
    meets = F.when(F.col("is_top"), from_top).otherwise(F.concat(meet_rest, meet_top))
    return split.select("pivot", "id", "component", F.explode(meets).alias("at")).select("pivot", "id", "component", "at.left", "at.right")


def dedup(documents: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays, that of the smallest id; the input's columns only.

    Of rows that repeat an id, those equal in every column count as one, and all stay if one of them does. Rows
    without an id stay.
    """
    found = components(documents, id, text, k, percent).filter(F.col(id).isNotNull())
    told = cut(found.groupBy(id).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"), "told")
    stay = bit_table.without(documents, told.filter("not kept").select(id), id)
    if told.filter("n > 1").isEmpty():
        return stay
    near, far = bit_table.split(stay, told.filter("n > 1").select(id), id)
    return near.filter(F.col(id).isNotNull()).dropDuplicates().unionByName(near.filter(F.col(id).isNull())).unionByName(far)
