"""A Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources.

A node is the lowercase hex SHA-256 of its up to ``ARITY`` children's hex digests. Leaves of a source ascend by id; every
``ARITY`` consecutive nodes, the last ones fewer, become one until one is left, the source's subroot. Subroots in the order of
their sources (null first, then by bytes) become the root in the same way. A row's authentication path has for each level what
stands left and right of its node, so anybody who has the row and its path can fold them to the root.

1. Leaves are hashed in the JVM in one pass over the rows; from there on only digests move.
2. Places within sources come from range partitions and their counts, so no source is gathered, whatever its size.
3. Aligned blocks of ``ARITY ** LEVELS`` consecutive leaves are subtrees of their own. A treehash stack, with fewer than ``ARITY``
   nodes a level, gives the root of each; block roots are the leaves of the next tier, and so on until every source has one.
4. From the top down, each block is traversed leaf by leaf. For each level the group of nodes around the current leaf is held, and
   a treehash that takes one leaf a step has the next group ready when the traversal gets there. The path of the
   block's own root, read as the first row of the block, is appended.

Beside a block's digests (729 by default) a task holds memory in the square of its levels. No step sees more than a block at once.

Defined results: nulls in any hashed column count as ``-``; rows that share an id are ordered by their leaves, identical rows have
leaves of their own; rows without an id come first; a source may be null, and is no other source then; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.partitions import dense_ids
from loomgraph.sessions import cut, drop_table

ARITY = 3
LEVELS = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def framed(column: Column) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*(framed(c) for c in columns)), 256)


def fold(path: Column | str, digest: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, digest, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def _node(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Treehash:
    """Digests taken in one by one; ``group`` collects the nodes of ``level`` that they make, as soon as they are made."""

    def __init__(self, level: int):
        self.group: list[str] = []
        self._waiting: list[list[str]] = [[] for _ in range(level)]

    def take(self, digest: str, at: int = 0) -> None:
        for waiting in self._waiting[at:]:
            waiting.append(digest)
            if len(waiting) < ARITY:
                return
            digest = _node(waiting)
            waiting.clear()
        self.group.append(digest)

    def close(self) -> None:
        """No more digests: nodes that wait are the last of their level."""
        for level, waiting in enumerate(self._waiting):
            if waiting:
                digest = _node(waiting)
                waiting.clear()
                self.take(digest, level + 1)


def block_root(digests: Iterator[str] | list[str], height: int) -> str:
    tree = Treehash(height)
    for d in digests:
        tree.take(d)
    tree.close()
    return tree.group[0]


def traverse(digests: list[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """The authentication path of each leaf up to ``height``, in order: (left, right) of its node at every level.

    ``groups[h]`` is the group of level h that the current leaf is under. ``ahead[h]`` makes the one that follows it,
    a leaf a step: a group of level h spans ARITY ** (h + 1) leaves, as many as steps until it is needed.
    """
    spans = [ARITY ** (h + 1) for h in range(height)]
    groups = []
    for h, span in enumerate(spans):
        first = Treehash(h)
        for d in digests[:span]:
            first.take(d)
        first.close()
        groups.append(first.group)
    ahead = [Treehash(h) for h in range(height)]
    for i in range(len(digests)):
        for h, span in enumerate(spans):
            if i and i % span == 0:
                ahead[h].close()
                groups[h], ahead[h] = ahead[h].group, Treehash(h)
        path = []
        for h, group in enumerate(groups):
            at = i // ARITY**h % ARITY
            path.append(("".join(group[:at]), "".join(group[at + 1 :])))
        yield path
        for h, span in enumerate(spans):
            if i + span < len(digests):  # the leaf of the next group that stands where this one does in its own
                ahead[h].take(digests[i + span])


def _height(width: int, levels: int) -> int:
    """Levels within a block of a tree of ``width`` leaves: fewer than ``levels`` where the tree is no more than a block."""
    height = 0
    while height < levels and ARITY**height < width:
        height += 1
    return height


def _leaves(rows: DataFrame) -> DataFrame:
    """``rows`` with ``tree``, the number of their ``source``, ``pos``, the place by ``id`` and ``digest`` in it, and ``width``, its rows.

    Rows are range-partitioned and numbered in their partition; the counts of partitions give the offsets.
    """
    rows = cut(rows, "digests")  # texts are hashed once: range partitions are sampled from this
    ties = rows.withColumn("tie", F.monotonically_increasing_id())
    order = ["id", "digest", "tie"]
    dealt = cut(ties.repartitionByRange("source", *order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = cut(dealt.groupBy("part", "source").agg(F.count("*").alias("n")), "counts")
    trees = dense_ids(counts.select(F.col("source").alias("of")).distinct(), "of", "tree")
    whole = Window.partitionBy("source")
    earlier = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumns({"before": F.coalesce(earlier, F.lit(0)), "width": F.sum("n").over(whole)})
    offsets = offsets.join(trees, F.col("source").eqNullSafe(F.col("of"))).select(F.col("part").alias("at"), "of", "tree", "width", "before")
    place = F.row_number().over(Window.partitionBy("part", "source").orderBy(*order)) - 1
    here = dealt.withColumn("place", place)
    found = here.join(offsets, (F.col("part") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    out = cut(found.select(*rows.columns, "tree", (F.col("place") + F.col("before")).cast("long").alias("pos"), "width"), "leaves")
    drop_table(rows, dealt, counts)
    return out


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], pa.Schema]]:
    """Rows sorted by tree and block, block by block."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                yield held, batch.schema
                held = []
            held.append(row)
    if held:
        yield held, batch.schema


def _blocks(tier: DataFrame, levels: int) -> DataFrame:
    return tier.withColumn("block", F.floor(F.col("pos") / ARITY**levels).cast("long"))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _tiers(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Tiers (tree, pos, digest, width) from the leaves to the roots: the block roots of each are the leaves of the next."""
    size = ARITY**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("digest", pa.string()), ("width", pa.int64())])
        for rows, _ in _by_block(batches):
            first = rows[0]
            root = block_root([r["digest"] for r in rows], _height(first["width"], levels))
            yield pa.RecordBatch.from_pylist([{"tree": first["tree"], "pos": first["block"], "digest": root, "width": -(-first["width"] // size)}], schema=kinds)

    tiers = [leaves]
    while not tiers[-1].filter("width > 1").isEmpty():
        below = _blocks(tiers[-1].select("tree", "pos", "digest", "width"), levels)
        tiers.append(cut(_dealt(below).mapInArrow(run, "tree long, pos long, digest string, width long"), "tier"))
    return tiers


def _paths(tier: DataFrame, above: DataFrame, levels: int, given: list[str]) -> DataFrame:
    """``tier`` with ``path`` and ``given``: each node's path in its block, then that of the block's root in the tier ``above``.

    ``above`` has (tree, pos, path) and the columns ``given``. Its row is sent as the first one of the block.
    """
    below = _blocks(tier.drop("path"), levels)
    heads = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", *given)
    columns = [*tier.drop("path").columns, "path", *given]
    both = below.unionByName(heads, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (head, *members), schema in _by_block(batches):
            own = traverse([r["digest"] for r in members], _height(members[0]["width"], levels))
            for r, path in zip(members, own, strict=True):
                r |= {g: head[g] for g in given} | {"path": [{"left": a, "right": b} for a, b in path] + head["path"]}
            kinds = [(c, _PATH if c == "path" else schema.field(c).type) for c in columns]
            yield pa.RecordBatch.from_pylist(members, schema=pa.schema(kinds))

    schema = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in columns)
    return _dealt(both).mapInArrow(run, schema)


def manifest(
    rows: DataFrame, id: str = "doc_id", source: str = "source", columns: tuple[str, ...] = COLUMNS, digest: Column | None = None, levels: int = LEVELS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, keep, leaf, subroot, root, path) for each row.

    A leaf hashes ``columns``, or is ``digest``. ``path`` leads from the leaf over the subroot to the root. ``keep`` are further columns
    to hand through: they are shuffled with the leaves.
    """
    own = leaf(*(F.col(c) for c in columns)) if digest is None else digest
    kept = {f"keep{n}": F.col(c) for n, c in enumerate(keep)}
    leaves = _leaves(rows.select(F.col(id).alias("id"), F.col(source).alias("source"), own.alias("digest"), *(c.alias(n) for n, c in kept.items()))).drop("source")
    tiers = _tiers(leaves, levels)
    subroots = tiers[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(tiers[-1].count()).cast("long").alias("width"))
    tops = _tiers(cut(subroots, "subroots"), levels)
    above = tops[-1].select("tree", "pos", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    for tier in reversed(tops[:-1] or tops):
        above = cut(_paths(tier, above, levels, ["root"]), "paths")
    above = above.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "root", F.col("digest").alias("subroot"))
    for tier in reversed(tiers[1:-1]):
        above = cut(_paths(tier, above, levels, ["subroot", "root"]), "paths")
    out = _paths(leaves, above, levels, ["subroot", "root"])
    return out.select(F.col("id").alias(id), *(F.col(n).alias(c) for n, c in zip(kept, keep, strict=True)), F.col("digest").alias("leaf"), "subroot", "root", "path")
