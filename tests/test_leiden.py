"""Local moving, refinement and the levels of Leiden against plain Python on random, dense and star-like graphs."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import quality
from loomgraph.operators import blocks, graph, leiden, moving, partitions, refining
from loomgraph.sources import edges as sources


def weighted(spark, weights):
    return spark.createDataFrame([(min(p), max(p), w) for p, w in weights.items()], "src long, dst long, weight long")


def random_graph(seed, n, m, low=0):
    rng = random.Random(seed)
    out = Counter()
    for _ in range(m):
        a, b = rng.randrange(n), rng.randrange(n)
        if rng.random() < 0.7:  # groups of seven
            b = a // 7 * 7 + rng.randrange(7)
        out[(min(a, b) + low, max(a, b) + low)] += rng.randrange(1, 4)
    return dict(out)


def score(weights, sizes, labels, g):
    total = defaultdict(int)
    for v, k in sizes.items():
        total[labels[v]] += k
    return sum(w for (a, b), w in weights.items() if labels[a] == labels[b]) - g * sum(s * (s - 1) / 2 for s in total.values())


def gains_left(weights, sizes, labels, g):
    """The best that any single move to a neighbouring community or away adds."""
    total, near = defaultdict(int), defaultdict(Counter)
    for v, k in sizes.items():
        total[labels[v]] += k
    for (a, b), w in weights.items():
        if a != b:
            near[a][labels[b]] += w
            near[b][labels[a]] += w
    best = 0.0
    for v, around in near.items():
        k, own = sizes[v], labels[v]
        loss = g * k * (total[own] - k) - around[own]
        best = max([best, loss, *(w - g * k * total[c] + loss for c, w in around.items() if c != own)])
    return best


CASES = [
    (random_graph(1, 60, 200), quality.CPM, 0.3, None),
    (random_graph(2, 90, 260, low=-45), quality.MODULARITY, 1.0, None),
    (random_graph(3, 60, 240, low=-30), quality.CPM, 2.5, 5),  # from few communities at a high resolution: nodes leave for communities of their own
    ({(0, i): 1 for i in range(1, 120)}, quality.MODULARITY, 1.0, None),
    ({(a, b): 1 for a in range(24) for b in range(a)}, quality.CPM, 0.9, 2),
    ({(a, b): 1 for a in range(24) for b in range(a, 24)}, quality.CPM, 1.5, 1),
]


@pytest.mark.parametrize("case", [1, 2, 3, 5])
def test_moves_end_where_none_gains_and_carry_q(spark, case):
    weights, objective, gamma, of = CASES[case]
    edges = weighted(spark, weights)
    ids = graph.vertices(edges)
    labels = None if of is None else ids.select("id", (F.col("id") % of).alias("pid"))
    level = leiden.start(edges, gamma, objective, labels, seed=case)
    sizes = {r["id"]: r["weight"] for r in level.nodes.collect()}
    before = score(weights, sizes, {r["id"]: r["pid"] for r in level.nodes.collect()}, level.g)
    trace = []
    nodes, added = moving.settle(level.edges, level.nodes, level.g, seed=case, thorough=True, trace=trace)
    found = {r["id"]: r["pid"] for r in nodes.collect()}
    assert set(found) == set(sizes) and {r["id"]: r["weight"] for r in nodes.collect()} == sizes
    assert score(weights, sizes, found, level.g) == pytest.approx(before + added)
    assert all(gained > 0 for _, _, gained in trace)
    assert gains_left(weights, sizes, found, level.g) <= 1e-6
    members = defaultdict(set)
    for v, c in found.items():
        members[c].add(v)
    assert all(c == min(m) for c, m in members.items())


def plain_parts(weights, sizes, supers, labels, g):
    """(well connected, gain) of the best part for each node that is well connected and still alone."""
    inner = {e: w for e, w in weights.items() if e[0] != e[1] and supers[e[0]] == supers[e[1]]}
    s, c, cut, near, n = defaultdict(int), defaultdict(int), Counter(), defaultdict(Counter), Counter(labels.values())
    for v, k in sizes.items():
        s[supers[v]] += k
        c[labels[v]] += k
    own = Counter()
    for (a, b), w in inner.items():
        own[a] += w
        own[b] += w
        near[a][labels[b]] += w
        near[b][labels[a]] += w
        if labels[a] != labels[b]:
            cut[labels[a]] += w
            cut[labels[b]] += w
    of = {labels[v]: supers[v] for v in sizes}
    well = lambda p: cut[p] >= g * c[p] * (s[of[p]] - c[p])
    steady = {v for v in sizes if own[v] >= g * sizes[v] * (s[supers[v]] - sizes[v])}
    return [(v, p) for v in steady if n[labels[v]] == 1 for p, w in near[v].items() if p != labels[v] and well(p) and w - g * sizes[v] * c[p] > 1e-9]


@pytest.mark.parametrize(("case", "groups"), [(0, 1), (3, 1), (4, 3)])
def test_refinement_leaves_no_eligible_singleton(spark, case, groups):
    weights, objective, gamma, _ = CASES[case]
    edges = weighted(spark, weights)
    supers = graph.vertices(edges).select("id", F.pmod("id", F.lit(groups)).alias("pid"))
    level = leiden.start(edges, gamma, objective, supers, seed=case)
    rows = level.nodes.collect()
    sizes, above = {r["id"]: r["weight"] for r in rows}, {r["id"]: r["pid"] for r in rows}
    trace = []
    refined = {r["id"]: r["refined"] for r in refining.refine(level.edges, level.nodes, level.g, 1.0, seed=case, trace=trace).collect()}
    assert set(refined) == set(sizes)
    for v, p in refined.items():
        assert above[v] == above[p] and p <= v
    assert not plain_parts(weights, sizes, above, refined, level.g)
    alone = {v: v for v in sizes}
    assert score(weights, sizes, refined, level.g) >= score(weights, sizes, alone, level.g) - 1e-9
    assert sum(trace) == len(sizes) - len(set(refined.values()))


def test_a_hub_is_refined_in_few_rounds(spark):
    edges = weighted(spark, {(0, i): 1 for i in range(1, 1200)})
    level = leiden.start(edges, 0.0002, quality.CPM, partitions.null_partition(graph.vertices(edges)), seed=3)
    trace = []
    refined = refining.refine(level.edges, level.nodes, level.g, 1.0, seed=3, trace=trace)
    assert refined.select("refined").distinct().count() == 1 and len(trace) <= 6


def test_levels_merge_cliques_of_cliques(spark):
    """Cliques of five strong edges each, four of them tied by weaker ones: the groups of four are one level's work, the whole that of another."""
    weights = {}
    for c in range(12):
        weights |= {(5 * c + a, 5 * c + b): 8 for a in range(5) for b in range(a)}
        weights[(5 * c, 5 * c)] = 2
    for g4 in range(3):
        for a in range(4):
            for b in range(a):
                weights |= {(5 * (4 * g4 + a) + i, 5 * (4 * g4 + b) + i): 3 for i in range(5)}
    weights |= {(19, 20): 1, (39, 40): 1}
    first = leiden.start(weighted(spark, {(min(p), max(p)): w for p, w in weights.items()}), 0.4, quality.CPM, seed=5)
    last = leiden.leiden(first, randomness=1.0)
    found = defaultdict(set)
    for r in last.labels().collect():
        found[r["pid"]].add(r["id"])
    assert sorted(map(sorted, found.values())) == [list(range(20 * i, 20 * i + 20)) for i in range(3)]
    labels = {r["id"]: r["pid"] for r in last.labels().collect()}
    assert last.quality() == pytest.approx(score({(min(p), max(p)): w for p, w in weights.items()}, {v: 1 for v in labels}, labels, 0.4))
    assert last.number >= 2


def test_labels_with_repeated_ids_are_refused(spark):
    edges = sources.edges_from_tuples(spark, [(0, 1), (1, 2)])
    twice = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (2, 1)], "id long, pid long")
    with pytest.raises(ValueError, match="more than once"):
        leiden.start(graph.canonical_edges(edges), 1.0, labels=twice)


def test_rounds_leave_no_tables(spark):
    import os

    from loomgraph.sessions import fresh_path

    edges = weighted(spark, random_graph(9, 40, 120))
    level = leiden.start(edges, 0.3, quality.CPM, seed=1)
    root = os.path.dirname(fresh_path(spark, "x"))
    before = set(os.listdir(root))
    moving.settle(level.edges, level.nodes, level.g)
    refining.refine(level.edges, level.nodes, level.g)
    left = [f for f in set(os.listdir(root)) - before if not f.startswith(".")]
    assert len(left) <= 3, left  # the nodes, and the refined labels


def test_edges_that_are_written_are_not_written_again(spark):
    import os

    from loomgraph.sessions import cut, fresh_path

    edges = cut(weighted(spark, random_graph(9, 40, 120)), "edges")
    root = os.path.dirname(fresh_path(spark, "x"))
    before = set(os.listdir(root))
    level = leiden.start(edges, 0.3, quality.CPM, seed=1)
    assert level.edges is edges and not [f for f in set(os.listdir(root)) - before if f.startswith("edges-")]


def test_edges_inside_labels_carry_quality_and_parts(spark):
    weights = random_graph(4, 60, 200) | {(3, 3): 5}
    edges = weighted(spark, weights)
    nodes = graph.vertices(edges).select("id", F.lit(1).cast("long").alias("weight"), (F.col("id") % 9).alias("pid"))
    labels = nodes.select("id", "pid")
    inner = partitions.inside(edges, labels)
    assert {(r["src"], r["dst"]): r["weight"] for r in inner.collect()} == {(a, b): w for (a, b), w in weights.items() if a % 9 == b % 9}
    assert quality.quality(inner, nodes, 0.3).first() == quality.quality(edges, nodes, 0.3).first()
    alone = nodes.withColumn("pid", F.col("id"))
    assert quality.quality(edges.filter("src = dst"), alone, 0.3).first() == quality.quality(edges, alone, 0.3).first()
    assert sorted(partitions.split_inside(inner, labels).collect()) == sorted(partitions.split_disconnected(edges, labels).collect())


def test_few_gains_are_dealt_with_as_many_are(spark):
    for n, of, seed in ((600, 25, 1), (400, 400, 2)):
        draw = lambda salt: F.shiftrightunsigned(F.xxhash64("id", F.lit(salt + 10 * seed)), 3)  # noqa: B023, E731
        rows = spark.range(n).select("id", (draw(1) % 9 + 1).alias("k"), F.struct(F.lit(-1).alias("number"), (draw(2) % of).alias("id")).alias("own"), F.lit(0).alias("founded"), F.when(draw(3) % 10 > 0, F.struct(F.lit(-1).alias("number"), (draw(4) % of).alias("id"))).alias("target"), ((draw(5) % 1000 + 1) / F.lit(100.0)).alias("gain"), (draw(6) % 20).alias("dw"))
        rows = rows.filter("target is null or target <> own").selectExpr("*", "struct(-cast(floor(log2(gain / k) * 256) as int) as level, shiftrightunsigned(xxhash64(id, 7), 2) as tie, id as by) as first")
        for g in (0.0005, 0.05):
            many, few = (sorted(map(tuple, made.collect()), key=lambda r: r[0]) for made in (moving._made(moving._offers(rows, n), g), moving._made_of_few(rows, g)))
            assert few and few == many


@pytest.mark.parametrize("within", [0, 150, 10_000])
def test_blocks_in_tasks_and_in_rounds_hold_the_same(spark, within):
    """A large and twenty small components, none, some or all of them taken node by node in a task; communities tie two of them together."""
    weights = random_graph(6, 60, 200) | {(100 + 10 * i + a, 100 + 10 * i + b): 1 + (a + b) % 2 for i in range(20) for a in range(6) for b in range(a)}
    edges = weighted(spark, {(min(p), max(p)): w for p, w in weights.items()})
    labels = graph.vertices(edges).select("id", F.when(F.col("id").between(100, 119), 100).otherwise(F.col("id")).alias("pid"))
    level = leiden.start(edges, 0.3, quality.CPM, labels, seed=2)
    sizes = {r["id"]: r["weight"] for r in level.nodes.collect()}
    start = {r["id"]: r["pid"] for r in level.nodes.collect()}
    apart = {r["id"]: r["block"] for r in blocks.apart(level.edges, level.nodes).collect()}
    assert len({apart[100 + 10 * i] for i in range(20)}) == 19 and apart[100] == apart[110] != apart[120]
    weights, trace = {(min(p), max(p)): w for p, w in weights.items()}, []
    nodes, added = moving.settle(level.edges, level.nodes, level.g, seed=2, thorough=True, within=within, trace=trace)
    found = {r["id"]: r["pid"] for r in nodes.collect()}
    assert nodes.count() == len(sizes) == len(found) and (len(trace) == 1) == (within == 10_000)
    assert score(weights, sizes, found, 0.3) == pytest.approx(score(weights, sizes, start, 0.3) + added)
    assert gains_left(weights, sizes, found, 0.3) <= 1e-6
    for i in range(20):
        assert len({found[100 + 10 * i + a] for a in range(6)}) == 1
    merges = []
    refined = {r["id"]: r["refined"] for r in refining.refine(level.edges, nodes, level.g, 1.0, seed=2, within=within and 12, trace=merges).collect()}
    assert set(refined) == set(sizes) and all(found[v] == found[p] and p <= v for v, p in refined.items())
    assert not plain_parts(weights, sizes, found, refined, 0.3) and sum(merges) == len(sizes) - len(set(refined.values()))


def test_blocks_take_ids_beyond_long(spark):
    big = 2**63
    edges = spark.createDataFrame([(i, j) for i in range(5) for j in range(i)], "a long, b long").selectExpr(f"cast(b as decimal(20, 0)) + {big} as src", f"cast(a as decimal(20, 0)) + {big} as dst", "1L as weight")
    edges = edges.select(F.col("src").cast("decimal(20,0)").alias("src"), F.col("dst").cast("decimal(20,0)").alias("dst"), "weight")
    last = leiden.leiden(leiden.start(edges, 0.3, quality.CPM, seed=1))
    assert {(int(r["id"]), int(r["pid"])) for r in last.labels().collect()} == {(big + i, big) for i in range(5)}


def test_a_small_component_is_settled_at_once(spark):
    """A chain of triangles took a round of tables for each wave of moves; a task takes them all."""
    weights = {(a, b): 1 for i in range(80) for a, b in ((3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 2), (3 * i + 2, 3 * i + 3))}
    level, trace = leiden.start(weighted(spark, weights), 1.0, seed=1), []
    moving.settle(level.edges, level.nodes, level.g, seed=1, trace=trace)
    assert len(trace) == 1
