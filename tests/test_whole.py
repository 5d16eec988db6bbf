"""Queries over whole tables: every row of lineitem becomes an edge, also where SQL is too slow to say what is right."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph import registry
from loomgraph.operators import leiden, partitions
from tests.test_components import brute


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Rows that the thin view would drop, with a hub."""
    rng = random.Random(5)
    rows = [(rng.randrange(30), rng.randrange(40), rng.choice("ANR"), float(rng.randrange(1, 51))) for _ in range(45)]
    rows += [(100 + i, 77, "N", 1.0) for i in range(15)]
    path = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_returnflag string, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return str(path), [(o * 2, p * 2 + 1) for o, p, _, _ in rows]


def test_components_of_whole_tables(spark, lines):
    path, pairs = lines
    want = brute(pairs)
    got = {r["id"]: r["component"] for r in registry.QUERIES["connected_components_whole"](spark, path).collect()}
    assert got == want
    sizes = Counter(Counter(want.values()).values())
    got = {r["size"]: r["count"] for r in registry.QUERIES["component_size_distribution_whole"](spark, path).collect()}
    assert got == sizes and max(sizes) > 15


def test_refinement_of_whole_tables(spark, lines):
    path, pairs = lines
    assert registry.QUERIES["refine_partitions_whole"](spark, path).first().asDict() == {"node_count": len(brute(pairs)), "each_once": True, "connected": True, "not_worse": True}


def test_every_thin_query_has_its_whole_one():
    thin = {n for n, sql in registry.ORACLES.items() if registry.VIEWS["order_part"] in sql}
    assert thin and {f"{n}_whole" for n in thin} <= set(registry.QUERIES)
    assert not any(registry.VIEWS["order_part"] in sql for n, sql in registry.ORACLES.items() if n.endswith("_whole"))


def test_hybrid_removes_crossing_edges_and_compares_q(spark, lines, monkeypatch):
    path, pairs = lines
    whole = {"node_count": len(brute(pairs)), "each_once": True, "connected": True, "not_worse": True}
    query = registry.QUERIES["hybrid_whole"]
    moved = lambda edges, **_: partitions.split_disconnected(edges, leiden.move_nodes(leiden.start(edges, 1.0))[0].labels())
    monkeypatch.setattr(registry.hybrid, "fast_label_propagation", moved)
    assert query(spark, path).first().asDict() == whole
    with monkeypatch.context() as m:  # edges between communities stay
        m.setattr(registry.sources, "filter_crossing_edges", lambda edges, labels: edges.withColumn("component", F.lit("0")))
        assert not query(spark, path).first()["connected"]
    with monkeypatch.context() as m:  # recovery gives singlets, of lower Q
        m.setattr(registry.hybrid.leiden, "leiden", lambda level, *_: leiden.start(registry._edges(spark, path, "order_part_whole"), 1.0))
        assert query(spark, path).first().asDict() == whole | {"not_worse": False}
