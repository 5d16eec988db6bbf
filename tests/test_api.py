import pytest

import loomgraph.__main__ as cli
from loomgraph.plans import api
from loomgraph.sources import edges as sources

# Two cliques of four, joined by one edge, and a pair on its own.
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7), (1, 4), (20, 21)]


@pytest.fixture(scope="module")
def edge_file(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "edges.parquet")
    sources.edges_from_tuples(spark, [*PAIRS, (3, 2)]).selectExpr("umi1", "umi2", "concat('row ', umi1) as tag").write.parquet(path)
    return path


def groups(spark, path):
    found = {}
    for r in spark.read.parquet(path).collect():
        found.setdefault(r["partition_id"], set()).add(r["umi"])
    return sorted(map(sorted, found.values()))


def test_statistics(spark, edge_file):
    assert api.find_graph_statistics(spark, edge_file) == (10, 15, 2, 0.8)


def test_label_propagation_writes_connected_partitions(spark, edge_file, tmp_path):
    out = str(tmp_path / "flp")
    n = api.run_label_propagation(spark, edge_file, output=out, seed=3)
    assert n == len(groups(spark, out)) and [20, 21] in groups(spark, out)


def test_leiden_parts_the_cliques(spark, edge_file, tmp_path):
    out = str(tmp_path / "leiden")
    n, q = api.run_leiden(spark, edge_file, 1.0, output=out, randomness=1.0, seed=1)
    assert (n, groups(spark, out)) == (3, [[0, 1, 2, 3], [4, 5, 6, 7], [20, 21]]) and q > 0
    assert spark.read.parquet(out).columns == ["umi", "partition_id"]
    with pytest.raises(ValueError, match="not both"):
        api.run_leiden(spark, edge_file, 1.0, merge_edge_threshold=1, merge_edge_threshold_relative=0.1)
    half = spark.createDataFrame([(0, 0)], "umi long, partition_id long")
    with pytest.raises(ValueError, match="cover"):
        api.run_leiden(spark, edge_file, 1.0, partition=half)


def test_hybrid_drops_the_edges_between_communities(spark, edge_file, tmp_path):
    out = str(tmp_path / "filtered")
    path, before, middle, end = api.run_hybrid_community_detection(spark, edge_file, 1.0, True, out, seed=1)
    kept = spark.read.parquet(path)
    assert kept.columns == ["umi1", "umi2", "tag", "component"]
    assert before.edge_weight_sum == 15 and before.n_connected_components == 2 and before.component_size_distribution == {8: 1, 2: 1}
    assert kept.count() == end.edge_weight_sum <= 15
    assert end.n_connected_components == kept.select("component").distinct().count()
    assert sum(k * v for k, v in end.component_size_distribution.items()) == end.node_count == 10


def test_command_line(spark, edge_file, tmp_path, capsys):
    cli.main([])
    cli.main(["stats", edge_file])
    assert "nodes 10, edge weight 15, components 2, fraction in largest 0.8" in capsys.readouterr().out
    cli.main(["flp", edge_file, "--output", str(tmp_path / "cli")])
    assert groups(spark, str(tmp_path / "cli"))
