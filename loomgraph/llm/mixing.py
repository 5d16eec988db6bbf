"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target of words: a share of the budget by its weight, but ``max_epochs`` times its
own words at most, the excess dealt anew by weight until no source is above. A source whose target is
f times its words gives each document floor(f) times, and once more with probability f - floor(f).
Those probabilities are moved through the null space of two constraints, words and documents of the
source, until each is 0 or 1, the longest documents first: a block keeps both totals exactly and leaves two of its shortest
documents undecided or so, the undecided ones of all blocks form the next level's blocks, and what is left of
a source in the end, two short documents, is landed on the choice nearest to its words.

Blocks hold about ``BLOCK`` documents however large their source is, so a hot source is many tasks and
nothing grows with the corpus but the number of blocks. Rows that repeat an id in a source are numbered, so they are dealt
over blocks as well. Sources may be any number: their targets are found by Spark in rounds of one sum each, and only
sums reach the driver. Draws hang on ids, level and seed alone: reruns agree.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, the last;
repeated rows are units of their own; sources without words get target 0; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.partitions import dense_ids
from loomgraph.sessions import cut

BLOCK = 1024
BROADCAST_SOURCES = 50_000
BROADCAST_NAMES = 8_000_000
REPEATS = 10_000
TINY = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: list[float], budget: float, max_epochs: float) -> list[float]:
    """Words that each source of a short list is to give: by weight, capped, the excess reshared among those below their cap."""
    out, open_, rest = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(budget)
    while open_:
        share = rest / sum(weights[i] for i in open_)
        over = {i for i in open_ if share * weights[i] > max_epochs * sizes[i]}
        for i in over or open_:
            out[i] = float(max_epochs * sizes[i]) if over else share * weights[i]
        rest -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over] if over else []
    return out


def aimed(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """``sources`` (size, weight, ...) with ``target``: by weight, capped, the excess reshared among those below their cap.

    ``budget`` is a share of all words. A source is at its cap where words a weight reach ``max_epochs`` times its
    size; that level only rises from round to round, until no source more comes to its cap.
    """
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * budget
    cap, reach = max_epochs * F.col("size"), F.lit(max_epochs) * F.col("size") / F.col("weight")
    level, before = None, None
    while True:
        full = F.lit(False) if level is None else reach < level
        capped, weight, n = sources.filter("size > 0").agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))
        ).first()
        if n == before or not weight:
            break
        level, before = (total - capped) / weight, n
    level = float("inf") if level is None or not weight else level
    share = F.lit(total - capped) * F.col("weight") / F.lit(weight or 1.0)
    return sources.withColumn("target", F.when(F.col("size") == 0, F.lit(0.0)).when(reach < level, cap.cast("double")).otherwise(share))


def fly(sizes: list[float], chances: list[float], rng: np.random.Generator) -> list[float]:
    """Move chances along the null space of (count, words) until no three, or two of equal size, are undecided."""
    chances = [0.0 if p < TINY else 1.0 if p > 1 - TINY else p for p in chances]
    waiting = [i for i, p in enumerate(chances) if 0 < p < 1]
    draws, used = rng.random(len(waiting) + 3).tolist(), 0
    waiting.reverse()
    held: list[int] = []
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) == 3:
            i, j, k = held
            u = (sizes[j] - sizes[k], sizes[k] - sizes[i], sizes[i] - sizes[j])
            if not (u[0] or u[1] or u[2]):
                u = (1.0, -1.0, 0.0)
        elif len(held) == 2 and sizes[held[0]] == sizes[held[1]]:
            u = (1.0, -1.0)
        else:
            return chances
        up = min((1 - chances[n]) / d if d > 0 else chances[n] / -d for n, d in zip(held, u, strict=True) if d)
        down = min(chances[n] / d if d > 0 else (1 - chances[n]) / -d for n, d in zip(held, u, strict=True) if d)
        step = up if draws[used] * (up + down) < down else -down
        used += 1
        for n, d in zip(held, u, strict=True):
            p = chances[n] + step * d
            chances[n] = 0.0 if p < TINY else 1.0 if p > 1 - TINY else p
        left = [n for n in held if 0 < chances[n] < 1]
        if len(left) == len(held):  # by rounding nothing got to a wall: put the nearest one there
            n = min(held, key=lambda n: min(chances[n], 1 - chances[n]))
            chances[n] = float(round(chances[n]))
            left.remove(n)
        held = left


def land(sizes: list[float], chances: list[float]) -> list[float]:
    """Round the few undecided ones to what keeps words nearest to their expectation, then documents."""
    undecided = [i for i, p in enumerate(chances) if 0 < p < 1]
    want = sum(sizes[i] * chances[i] for i in undecided), sum(chances[i] for i in undecided)
    best = min(
        range(1 << len(undecided)),
        key=lambda bits: (
            abs(sum(sizes[i] for n, i in enumerate(undecided) if bits >> n & 1) - want[0]),
            abs(bits.bit_count() - want[1]),
            bits,
        ),
    )
    for n, i in enumerate(undecided):
        chances[i] = float(best >> n & 1)
    return chances


def _flight(seed: int):
    """Flies each source of a group by itself: small sources share groups, a large one has a group for each block."""

    def one_group(group: pa.Table) -> pa.Table:
        group = group.sort_by([("source_no", "ascending"), ("size", "descending"), ("order", "ascending"), ("id", "ascending"), ("turn", "ascending"), ("chance", "ascending")])
        sources, sizes, chances = group["source_no"].to_numpy(), group["size"].cast(pa.float64()).to_pylist(), group["chance"].to_pylist()
        level, block, last = (group[c][0].as_py() for c in ("level", "block", "last"))
        begins = np.flatnonzero(np.diff(sources, prepend=-1)).tolist()
        out: list[float] = []
        for a, b in zip(begins, [*begins[1:], len(sources)], strict=True):
            found = fly(sizes[a:b], chances[a:b], np.random.default_rng([seed, level, int(sources[a]), block]))
            out += land(sizes[a:b], found) if last else found
        return group.select(["id", "turn", "source_no", "size"]).append_column("chance", pa.array(out, pa.float64()))

    return one_group


def numbered(units: DataFrame, many: int = REPEATS) -> DataFrame:
    """Units with ``turn``, which tells equal rows apart: they are counted, and dealt out again ``many`` at a time."""
    counted = units.groupBy(*units.columns).agg(F.count("*").alias("_n"))
    parts = counted.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / many))))
    begin = F.col("_part") * many
    return parts.withColumn("turn", F.explode(F.sequence(begin, F.least(begin + many, F.col("_n")) - 1))).drop("_n", "_part")


def choose(units: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Decide units (id, source_no, size, chance): the same rows with chance 0 or 1."""
    kind = units.schema["id"].dataType.simpleString()
    decided: list[DataFrame] = []
    rest, level = numbered(units.select("id", F.col("source_no").cast("long").alias("source_no"), "size", "chance")), 0
    while True:
        rest = cut(rest, "units") if level == 0 else rest
        counts = rest.groupBy("source_no").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        n, small = counts.agg(F.count("*"), F.sum(F.when(F.col("n") <= block, F.col("n")))).first()
        if not n:
            break
        last = F.col("blocks") == 1
        group = F.when(last, -1 - F.pmod(F.xxhash64("source_no"), F.lit((small or 0) // block + 1))).otherwise(F.col("source_no"))
        order = F.xxhash64(F.lit(seed), F.lit(level), "id", "size", "turn")
        dealt = rest.join(F.broadcast(counts) if n <= BROADCAST_SOURCES else counts, "source_no").select(
            "id", "turn", "source_no", "size", "chance",
            order.alias("order"), F.lit(level).alias("level"),
            F.pmod(order, F.col("blocks")).cast("int").alias("block"), last.alias("last"), group.alias("group"),
        )
        done = cut(
            dealt.groupBy("group", "block").applyInArrow(_flight(seed), f"id {kind}, turn long, source_no long, size long, chance double"),
            f"flight{level}",
        )
        settled = (F.col("chance") == 0) | (F.col("chance") == 1)
        decided.append(done.filter(settled))
        rest, level = done.filter(~settled), level + 1
    out = rest if not decided else decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.drop("turn")


def blend(
    documents: DataFrame,
    cycle: tuple[float, ...] = (1, 2, 3),
    budget: float = 1.0,
    max_epochs: int = 3,
    seed: int = 0,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """One row for each document: id, size, source_size, target, taken, and ``copies`` of it in the mix.

    ``budget`` is a share of all words. Sources, by code point with the null last, weigh ``cycle`` in turn.
    """
    sized = cut(
        documents.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), words_in(F.col(text)).alias("size")),
        "sized",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("size")).withColumn("name", F.struct(F.col("source").isNull().alias("last"), "source"))
    ranked = dense_ids(totals, "name", "source_no").drop("name")
    turn = F.array(*(F.lit(float(w)) for w in cycle))
    weighed = cut(ranked.withColumn("weight", F.element_at(turn, (F.col("source_no") % len(cycle) + 1).cast("int"))), "sources")
    planned = aimed(weighed, budget, max_epochs)
    each = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    whole = F.when(F.abs(each - F.round(each)) < TINY, F.round(each)).otherwise(F.floor(each))
    table = cut(
        planned.select("source", "source_no", F.col("size").alias("source_size"), "target", whole.cast("int").alias("whole"), F.greatest(F.lit(0.0), each - whole).alias("chance")),
        "targets",
    )
    n, letters = table.agg(F.count("*"), F.coalesce(F.sum(F.length("source")), F.lit(0))).first()
    if n <= BROADCAST_SOURCES and letters <= BROADCAST_NAMES:
        table = F.broadcast(table)  # a hot source then moves nowhere; a larger table is joined by shuffle
    units = sized.withColumnRenamed("source", "own").join(table, F.col("own").eqNullSafe(F.col("source")))
    open_ = (F.col("chance") > TINY) & (F.col("size") > 0)
    drawn = choose(units.filter(open_).select("id", "source_no", "size", "chance"), seed, block)
    plain = units.filter(~open_).select("id", "source_no", "size", F.lit(0.0).alias("chance"))
    every = plain.unionByName(drawn).join(table.drop("chance"), "source_no")
    copies = (F.col("whole") + F.col("chance").cast("int")).cast("int")
    return every.select(
        F.col("id").alias(id), "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"),
        copies.alias("copies"), F.col("source").alias(source),
    )


def repeat(documents: DataFrame, mixed: DataFrame, id: str = "doc_id") -> DataFrame:
    """The documents themselves, as often as the mix takes them; ids have to be unique."""
    times = mixed.select(F.col(id).alias("_id"), "copies").filter(F.col("copies") > 0)
    joined = documents.join(times, F.col(id) == F.col("_id"))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("_id", "copies", "copy")
