"""Parts of a graph that don't touch each other, dealt to tasks, which take their nodes one by one.

Local moving in one connected component, its communities included, hangs on nothing outside of it, as refinement in one community does. So each of
these blocks is one task's work, in the order that a single queue would take; a task gets several small ones. A block of more than ``WITHIN`` rows, edges and
nodes, is none of these: it's left to the rounds of ``moving`` and ``refining``, so that no task's share grows with the graph.
Nodes are taken by id or by a seeded hash, so results don't depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.sessions import cut

TINY = 1e-9
#: Rows that a block may have, some 150 MB of a Python worker.
WITHIN = 1_000_000
#: Rows that a task gets, about, if blocks are smaller.
SHARE = 200_000


def apart(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, block) of ``nodes(id, weight, pid)``: what edges or communities connect is one block."""
    ties = edges.select("src", "dst").unionAll(nodes.filter("id <> pid").select("id", "pid"))
    return connected_components(ties, nodes.select("id")).withColumnRenamed("component", "block")


def rows_of(edges: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """(block, a, b, w, node) of ``edges(src, dst, weight, block)`` and ``nodes(id, weight, block, group)``."""
    return edges.selectExpr("block", "src as a", "dst as b", "weight as w", "false as node").unionAll(nodes.selectExpr("block", "id as a", f"{group} as b", "weight as w", "true as node"))


def large(rows: DataFrame, total: int, within: int) -> DataFrame | None:
    """(block) of those with more than ``within`` of the ``total`` rows, fewer than ``total / within``; nothing if there is none."""
    if total <= within:
        return None
    found = cut(rows.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > within).select("block"), "large")
    return None if found.isEmpty() else found


def dealt(rows: DataFrame, total: int, work: Callable, schema: str) -> DataFrame:
    """What ``work`` makes of each task's blocks."""
    tasks = max(1, -(-total // SHARE))
    return rows.repartitionById(tasks, F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("int")).select("a", "b", "w", "node").mapInArrow(work, schema)


def _read(batches: Iterator[pa.RecordBatch]):
    """Ids in order, their weights and groups, and where each one's neighbours are, which and how heavy; self-loops are left out."""
    table = pa.Table.from_batches(list(batches))
    node = table["node"].to_numpy(zero_copy_only=False)
    a, b, w = (table[c].to_numpy(zero_copy_only=False) for c in ("a", "b", "w"))
    order = np.argsort(a[node], kind="stable")
    ids, group, size = a[node][order], b[node][order], w[node][order]
    src, dst, w = np.searchsorted(ids, a[~node]), np.searchsorted(ids, b[~node]), w[~node]
    apart = src != dst
    one, two = np.concatenate([src[apart], dst[apart]]), np.concatenate([dst[apart], src[apart]])
    order = np.lexsort((two, one))
    starts = np.searchsorted(one[order], np.arange(len(ids) + 1)).tolist()
    return ids, size.tolist(), group, starts, two[order].tolist(), np.concatenate([w[apart], w[apart]])[order].tolist()


def settled(batches: Iterator[pa.RecordBatch], g: float, rounds: int, thorough: bool, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(id, weight, pid, gained, moves, ended): nodes move to the best community of a neighbour, or one of their own, while that gains; then their neighbours are looked at again."""
    held = list(batches)
    if not sum(len(h) for h in held):
        return
    ids, size, group, starts, near, weight = _read(iter(held))
    n, (_, first) = len(ids), np.unique(group, return_inverse=True)
    label, total = first.tolist(), np.bincount(first, weights=np.array(size, dtype=float)).astype(np.int64).tolist()
    gained, moves, waiting = [0.0] * n, [0] * n, bytearray(b"\1") * n
    turn, every, ended = range(n), True, False
    for _ in range(rounds):
        later, moved = [], False
        for v in turn:
            waiting[v] = 0
            begin, end = starts[v], starts[v + 1]
            if begin == end:
                continue
            around, own, k = near[begin:end], label[v], size[v]
            to = {own: 0}
            for u, w in zip(around, weight[begin:end], strict=True):
                c = label[u]
                to[c] = to.get(c, 0) + w
            here, gk = to.pop(own), g * k
            best, most = -1, 0.0
            for c, w in to.items():
                worth = w - gk * total[c]
                if worth > most or (worth == most and c > best >= 0):
                    best, most = c, worth
            gain = most - here + gk * (total[own] - k)
            if gain <= TINY:
                continue
            if best < 0:
                best = len(total)
                total.append(0)
            label[v], moved = best, True
            total[own] -= k
            total[best] += k
            gained[v] += gain
            moves[v] += 1
            for u in around:
                if label[u] != best and not waiting[u]:
                    waiting[u] = 1
                    later.append(u)
        if moved:
            turn, every = later, False
        elif every or not thorough:
            ended = True
            break
        else:
            turn, every = range(n), True
    names = _least(ids, label)
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids, id_type), "weight": pa.array(size, pa.int64()), "pid": pa.array(names, id_type), "gained": pa.array(gained, pa.float64()), "moves": pa.array(moves, pa.int32()), "ended": pa.array([ended] * n)})


def refined(batches: Iterator[pa.RecordBatch], g: float, randomness: float, seed: int, rounds: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(id, refined, merged, ended): well-connected nodes that are still alone join a well-connected part, drawn by what that adds to Q."""
    held = list(batches)
    if not sum(len(h) for h in held):
        return
    ids, size, group, starts, near, weight = _read(iter(held))
    n, (_, above) = len(ids), np.unique(group, return_inverse=True)
    whole = np.bincount(above, weights=np.array(size, dtype=float)).astype(np.int64)[above].tolist()  # the size of a node's community
    out = [sum(weight[starts[v] : starts[v + 1]]) for v in range(n)]
    mass, part, members, draw = list(size), list(range(n)), [1] * n, _draws(ids, seed)
    steady = [v for v in range(n) if out[v] >= g * size[v] * (whole[v] - size[v])]
    order = sorted(steady, key=lambda v: (draw[v], v))
    for turn in range(1, rounds + 1):
        alone, draw = len(order), _draws(ids, seed + turn)
        for v in order:
            if members[v] != 1 or part[v] != v:
                continue
            to, k, s = {}, size[v], whole[v]
            for u, w in zip(near[starts[v] : starts[v + 1]], weight[starts[v] : starts[v + 1]], strict=True):
                p = part[u]
                to[p] = to.get(p, 0) + w
            gk = g * k
            options = sorted((p, w - gk * mass[p]) for p, w in to.items() if w - gk * mass[p] > 0 and out[p] >= g * mass[p] * (s - mass[p]))
            if not options:
                continue
            top = max(gain for _, gain in options)
            shares = [(gain / top) ** randomness for _, gain in options]
            left, p = draw[v] * sum(shares), options[-1][0]
            for (p, _), share in zip(options, shares, strict=True):  # noqa: B007
                left -= share
                if left < 0:
                    break
            part[v] = p
            members[p] += 1
            members[v] = 0
            mass[p] += k
            out[p] += out[v] - 2 * to[p]
        order = [v for v in order if members[v] == 1 and part[v] == v]
        if len(order) == alone:
            ended = True
            break
        ended = not order and turn < rounds
        if ended:
            break
    merged = [int(part[v] != v) for v in range(n)]
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids, id_type), "refined": pa.array(_least(ids, part), id_type), "merged": pa.array(merged, pa.int32()), "ended": pa.array([ended] * n)})


def _least(ids: np.ndarray, label: list[int]) -> np.ndarray:
    """The smallest of ``ids``, which are in order, that has the same label."""
    _, least, inverse = np.unique(np.array(label), return_index=True, return_inverse=True)
    return ids[least][inverse]


def _draws(ids: np.ndarray, salt: int) -> list[float]:
    """A number from 0 up to 1 for each id, by a hash."""
    x = np.array([int(i) & 0xFFFFFFFFFFFFFFFF for i in ids.tolist()], dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)) * 2.0**-53).tolist()


def arrow_type(df: DataFrame, column: str = "id") -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def ddl(df: DataFrame, column: str = "id") -> str:
    return df.schema[column].dataType.simpleString()


def settle(rows: DataFrame, total: int, nodes: DataFrame, g: float, rounds: int, thorough: bool) -> DataFrame:
    kind = ddl(nodes)
    return dealt(rows, total, partial(settled, g=g, rounds=rounds, thorough=thorough, id_type=arrow_type(nodes)), f"id {kind}, weight long, pid {kind}, gained double, moves int, ended boolean")


def refine(rows: DataFrame, total: int, nodes: DataFrame, g: float, randomness: float, seed: int, rounds: int) -> DataFrame:
    kind = ddl(nodes)
    return dealt(rows, total, partial(refined, g=g, randomness=float(randomness), seed=seed, rounds=rounds, id_type=arrow_type(nodes)), f"id {kind}, refined {kind}, merged int, ended boolean")
