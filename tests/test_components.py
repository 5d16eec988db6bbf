import random

from loomgraph.operators.components import connected_components


def brute(edges, vertices=()):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for v in vertices:
        find(v)
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    chain = [(1000 + i, 1001 + i) for i in range(150)]
    star = [(5000, 5001 + i) for i in range(200)]
    loose = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges = chain + star + loose + [(9000, 9000)]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges, "src long, dst long")
    lone = spark.createDataFrame([(77777,)], "id long")
    got = {r["id"]: r["component"] for r in connected_components(frame, lone).collect()}
    assert got == brute(edges, [77777])


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert connected_components(none).count() == 0


def test_chains_and_cliques_take_few_levels(spark):
    """A level leaves a constant share of the vertices at most, whatever the ids, and edges follow: one pass over them, and little more."""
    chain = [(i, i + 1) for i in range(2000)]
    dense = [(10_000 + a, 10_000 + b) for a in range(80) for b in range(a)]
    trace = []
    found = connected_components(spark.createDataFrame(chain + dense, "src long, dst long"), trace=trace)
    assert {r["id"]: r["component"] for r in found.collect()} == brute(chain + dense)
    assert len(trace) <= 25 and sum(trace[1:]) <= 4 * trace[0]
