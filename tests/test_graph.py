from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomgraph import registry, sessions
from loomgraph.functions import quality, scalars
from loomgraph.operators import graph, label_propagation, leiden, moving, partitions, statistics
from loomgraph.sources import edges as sources

TWO_TRIANGLES = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)]
TWO_COMMUNITIES = [(0, 1), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (1, 4), (4, 5), (6, 4), (6, 5), (7, 4), (7, 5), (7, 6)]
BOW = [(0, 1), (0, 2), (1, 2), (3, 4), (0, 3), (2, 4)]


def edges_of(spark, pairs):
    return graph.canonical_edges(sources.edges_from_tuples(spark, pairs))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def groups(labels):
    found = {}
    for r in labels.collect():
        found.setdefault(r["pid"], set()).add(r["id"])
    return sorted(map(sorted, found.values()))


def test_parallel_edges_and_loops(spark):
    edges = edges_of(spark, [(0, 1), (1, 2), (2, 0), (0, 0), (0, 1)])
    assert rows(graph.totals(edges)) == [(4, 5)]
    assert rows(graph.neighbors(edges, 0)) == [(1,), (2,)]
    assert rows(graph.degrees(edges)) == [(0, 3), (1, 2), (2, 2)]
    assert rows(graph.edge_weight(edges, 1, 0)) == [(2,)]
    assert rows(graph.edge_weight(edges, 1, 9)) == [(None,)]


def test_null_endpoint_is_an_error(spark):
    broken = spark.createDataFrame([(1, None)], "umi1 long, umi2 long")
    with pytest.raises(Exception, match="null in umi2"):
        graph.canonical_edges(broken).collect()


def test_properties_of_small_graphs(spark):
    ids = spark.range(3)
    for pairs, want in (([(0, 1), (1, 2)], (3, 2, 1, 1.0)), ([(0, 1)], (3, 1, 2, 2 / 3)), ([], (3, 0, 3, 1 / 3))):
        got = statistics.graph_properties(edges_of(spark, pairs) if pairs else spark.createDataFrame([], "src long, dst long, weight long"), ids).first()
        assert (got[0], got[1], got[2], round(got[3], 9)) == (*want[:3], round(want[3], 9))


def test_quality_goldens(spark):
    edges = edges_of(spark, BOW)
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)], "id long, pid long")
    ids = labels.select("id")
    cpm = quality.CPM.node_sizes(edges, ids).join(labels, "id")
    assert quality.quality(edges, cpm, 0.5).first()[0] == pytest.approx(2.0)
    nodes = quality.MODULARITY.node_sizes(edges, ids).join(labels, "id")
    assert quality.quality(edges, nodes, quality.MODULARITY.scaled(0.5, 6)).first()[0] == pytest.approx(31 / 12)
    assert rows(graph.contract(edges, labels)) == [(0, 0, 3), (0, 1, 2), (1, 1, 1)]


def test_move_delta_goldens(spark):
    edges = edges_of(spark, [(0, 2), (1, 2), (2, 3), (2, 4), (3, 4)])
    labels = [0, 0, 0, 1, 1]
    nodes = quality.MODULARITY.node_sizes(edges, spark.range(5)).join(spark.createDataFrame(list(enumerate(labels)), "id long, pid long"), "id")
    assert quality.move_delta(edges, nodes, 0.1, 2, 1).first()[0] == pytest.approx(-0.8)
    weighted = spark.createDataFrame([(i, w, p) for i, (w, p) in enumerate(zip([1, 1, 8, 2, 2], labels, strict=True))], "id long, weight long, pid long")
    assert quality.move_delta(edges, weighted, 1 / 14, 2, 1).first()[0] == pytest.approx(-32 / 28)


def test_well_connected_goldens(spark):
    example = [(3, 4), (3, 7), (0, 2), (2, 4), (4, 7), (2, 8), (4, 8), (5, 4), (5, 7), (8, 5), (5, 6), (1, 8)]
    edges = edges_of(spark, example)
    nodes = spark.range(2, 9).select("id", F.lit(1).cast("long").alias("weight"), F.lit(0).cast("long").alias("super"))
    assert rows(quality.well_connected_nodes(edges, nodes, 0.5)) == [(4,), (5,), (7,), (8,)]


def test_best_move_ties_and_fresh(spark):
    pair = edges_of(spark, [(0, 1)])
    both = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "id long, weight long, pid long")
    assert [r["target"] for r in quality.best_moves(pair, both, 10.0).collect()] == [None, None]


def test_normalise_and_split(spark):
    labels = spark.createDataFrame(list(enumerate([3, 10, 3, 10, 10])), "id long, pid long")
    assert rows(partitions.normalize(labels)) == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 1)]
    edges = edges_of(spark, [(0, 2), (1, 3)])
    assert groups(partitions.split_disconnected(edges, labels)) == [[0, 2], [1, 3], [4]]


def test_label_propagation_keeps_components_and_seed(spark):
    edges = edges_of(spark, TWO_TRIANGLES)
    once = label_propagation.fast_label_propagation(edges, epochs=1, seed=3)
    assert groups(once) == [[0, 1, 2], [3, 4, 5]]


def test_leiden_finds_the_planted_communities(spark):
    level = leiden.leiden(leiden.start(edges_of(spark, TWO_COMMUNITIES), 0.5, quality.CPM, seed=1), randomness=1.0)
    assert groups(level.labels()) == [[0, 1, 2, 3], [4, 5, 6, 7]]


def test_refinement_merges_every_eligible_pair(spark):
    edges = edges_of(spark, [(2 * i, 2 * i + 1) for i in range(64)])
    pairs = graph.vertices(edges).select("id", F.floor(F.col("id") / 2).alias("pid"))
    level = leiden.start(edges, 0.2, quality.CPM, pairs, seed=7)
    refined = leiden.refine(level, randomness=1.0).select("id", F.col("refined").alias("pid"))
    assert groups(refined) == [[2 * i, 2 * i + 1] for i in range(64)]
    with pytest.raises(RuntimeError, match="eligible singletons are left"):
        leiden.refine(level, randomness=1.0, rounds=1)


def test_rounds_end_where_nothing_is_left_or_raise(spark):
    edges = edges_of(spark, TWO_COMMUNITIES)
    level = leiden.start(edges, 0.5, quality.CPM, seed=1)
    done, _ = leiden.move_nodes(level, thorough=True)
    assert quality.best_moves(done.edges, done.nodes, done.g).filter(F.col("gain") > moving.TINY).isEmpty()
    with pytest.raises(RuntimeError, match="moves that gain are left"):
        leiden.move_nodes(level, rounds=1)
    singlets = partitions.singlets(graph.vertices(edges))
    with pytest.raises(RuntimeError, match="vertices are active"):
        label_propagation.epoch(edges, singlets, max_rounds=1)


def test_a_tie_keeps_the_label(spark):
    adj = graph.adjacency(edges_of(spark, [(0, i) for i in range(1, 9)]))
    labels = spark.createDataFrame([(0, 3), *((i, i) for i in range(1, 9))], "id long, pid long")
    for salt in range(3):
        assert rows(label_propagation.neighbour_mode(adj, labels, spark.range(1), salt)) == [(0, 3)]


def test_merge_by_threshold(spark):
    weighted = spark.createDataFrame([(0, 1, 6), (1, 2, 6), (0, 2, 15)], "src long, dst long, weight long")
    level = leiden.merge_highly_connected(leiden.start(weighted, 1.0), absolute=10)
    assert rows(level.edges) == [(0, 0, 15), (0, 1, 12)]
    with pytest.raises(ValueError):
        leiden.merge_highly_connected(level, 1, 2)


def test_crossing_edges_keep_rows_and_columns(spark):
    raw = spark.createDataFrame([(0, 1, "a"), (0, 1, "a"), (1, 2, "b")], "umi1 long, umi2 long, tag string")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id long, pid long")
    assert rows(sources.filter_crossing_edges(raw, labels)) == [(0, 1, "a", "0")] * 2


def test_unsigned_ids_and_random_edges(spark):
    big = spark.createDataFrame([(Decimal(2**64 - 1), Decimal(1))], "umi1 decimal(20,0), umi2 decimal(20,0)")
    assert sources.narrow_ids(big).dtypes[0][1] == "decimal(20,0)"
    assert sources.narrow_ids(big.filter("umi1 < 5")).dtypes[0][1] == "bigint"
    drawn = sources.random_edges(spark, 10, 200, 4)
    assert drawn.filter("umi1 = umi2").count() == 0
    assert rows(drawn) == rows(sources.random_edges(spark, 10, 200, 4).repartition(3))


def test_outer_and_trace(spark):
    one = spark.createDataFrame([(0, 1), (1, 2)], "i int, value int")
    assert rows(scalars.outer(one, one)) == [(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 4)]
    assert scalars.trace(spark.createDataFrame([(0, 0, 3), (0, 1, 9), (1, 1, 4)], "i int, j int, value int")).first()[0] == 7


def test_edge_table_from_a_stream(spark, tmp_path):
    from loomgraph.streaming.edge_table import keep_edge_table, read_edge_table

    source = str(tmp_path / "in")
    sources.edges_from_tuples(spark, [(1, 2), (2, 1), (3, 4)]).write.parquet(source)
    stream = spark.readStream.schema("umi1 long, umi2 long").parquet(source)
    keep_edge_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert rows(read_edge_table(spark, str(tmp_path / "out"))) == [(1, 2, 2), (3, 4, 1)]


def test_matrix_has_to_be_symmetric(spark):
    cells = [(0, 1, 2), (1, 0, 2), (1, 1, 5), (2, 1, 1), (1, 2, 1)]
    frame = lambda rows: spark.createDataFrame(rows, "i long, j long, weight long")
    assert rows(graph.from_matrix(frame(cells))) == [(0, 1, 2), (1, 1, 5), (1, 2, 1)]
    for broken in ([*cells, (3, 0, 1)], [(0, 1, 2), (1, 0, 3)], [*cells, (0, 1, 2)], [*cells, (1, 1, 5)]):
        with pytest.raises(Exception, match="not symmetric"):
            graph.from_matrix(frame(broken)).collect()
    assert rows(graph.from_matrix(frame([]))) == []


def test_packed_hubs_are_chunks(spark):
    edges = edges_of(spark, [(0, i) for i in range(0, 300)] + [(7, 8)])
    packed = graph.packed_adjacency(edges, chunk=32).collect()
    assert max(len(r["near"]) for r in packed) < 64 and {r["chunk"] for r in packed if r["id"] == 0} == set(range(10))
    assert all(list(r["near"]) == sorted(r["near"]) for r in packed)
    assert rows(graph.unpacked(graph.packed_adjacency(edges, chunk=32))) == rows(graph.adjacency(edges))


def test_hops_from_several_sources(spark):
    edges = edges_of(spark, [(i, i + 1) for i in range(20)] + [(30, 31)])
    start = spark.createDataFrame([(0,), (12,), (12,)], "id long")
    assert dict(rows(graph.bfs_levels(edges, start))) == {i: min(i, abs(12 - i)) for i in range(21)}
    assert dict(rows(graph.bfs_levels(edges, start, max_hops=1))) == {0: 0, 1: 1, 11: 1, 12: 0, 13: 1}
    assert dict(rows(graph.bfs_levels(edges, start, F.col("src") < 3))) == {0: 0, 1: 1, 2: 2, 3: 3, 12: 0}


def test_first_appearances_over_files(spark, tmp_path):
    for n, part in enumerate([[(9, 4), (4, 9), (2, 9)], [(1, 4), (0, 2)]]):
        sources.edges_from_tuples(spark, part).coalesce(1).write.parquet(f"{tmp_path}/x/part={n}")
    got = graph.first_appearances(spark.read.parquet(f"{tmp_path}/x"))
    assert [i for i, _ in sorted(rows(got), key=lambda r: r[1])] == [9, 4, 2, 1, 0]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "edges.csv").write_text("umi1,umi2,weight\n1,2,7\n3,x,1\n2,2,1\n")
    (tmp_path / "labels.csv").write_text("id,pid\n1,0\n2,5\n")
    assert rows(sources.read_edges_csv(spark, str(tmp_path / "edges.csv"))) == [(1, 2), (2, 2)]
    assert rows(sources.read_partitions_csv(spark, str(tmp_path / "labels.csv"))) == [(1, 0), (2, 5)]


def test_joins_with_counted_keys_split_heavy_ones(spark):
    from loomgraph.operators.skew import join_counted

    left = spark.createDataFrame([(1 if i < 90 else i, i) for i in range(120)], "k long, v long")
    sizes = left.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 119").withColumn("tag", F.col("k") * 2)
    for how in ("inner", "left"):
        assert rows(join_counted(left, sizes, "k", "n", 120, how, least=10)) == rows(left.join(sizes, "k", how).drop("n"))


def test_edge_tables_stay_in_their_buckets(spark, tmp_path):
    raw = spark.createDataFrame([(0, 1, "a"), (0, 1, "a"), (1, 2, "b"), (3, 3, None)], "umi1 long, umi2 long, tag string")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "id long, pid long")
    sources.write_edge_table(raw, "some_edges", str(tmp_path / "edges"), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = sources.filter_crossing_table(spark, "some_edges", labels)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, kept.collect())) == sorted(map(str, sources.filter_crossing_edges(raw, labels).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table some_edges")
    lines = plan.split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "tag" in line)
    depth = lines[scan].index("FileScan")
    above = []
    for line in reversed(lines[:scan]):  # the nodes that stand over the scan of whole rows
        at = len(line) - len(line.lstrip(" :|+-*()0123456789"))
        if at < depth:
            above.append(line)
            depth = at
    assert any("Join" in line for line in above) and not any("Exchange" in line for line in above), plan


def test_two_that_swap_labels_look_again(spark):
    """Both ends of an edge may draw in one round and take each other's label: that is no end."""
    edges = sources.edges_from_tuples(spark, [(2 * i, 2 * i + 1) for i in range(60)])
    labels = label_propagation.fast_label_propagation(graph.canonical_edges(edges), seed=7).collect()
    assert {r["id"]: r["pid"] for r in labels} == {v: v // 2 * 2 for v in range(120)}


def test_label_rounds_leave_the_adjacency_where_it_is_and_dont_hang_on_the_layout(spark, monkeypatch):
    edges = graph.canonical_edges(spark.range(40).selectExpr("id % 11 as umi1", "11 + (id * id) % 13 as umi2"))
    adj = sessions.dealt(graph.adjacency(edges).select("src", "dst"), "adjacency", "src", 3)
    plan = adj.join(spark.range(50).withColumnRenamed("id", "src").hint("shuffle_hash"), "src")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(src#" in plan
    sessions.drop_table(adj)
    want = rows(label_propagation.epoch(edges, seed=5))
    for owed, few, of in ((10**9, 0, 30), (1, 10**6, 10**6)):
        monkeypatch.setattr(label_propagation, "OWED", owed)
        monkeypatch.setattr(label_propagation, "FEW", few)
        monkeypatch.setattr(sessions, "BUCKET_ROWS", of)
        assert rows(label_propagation.epoch(edges, seed=5)) == want


def test_parts_of_a_matrix_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(sessions, "BUCKET_ROWS", 1000)
    found = registry.QUERIES["graph_from_matrix"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    parts = sessions.buckets_of(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count())
    assert parts > 4 and all(f", {n}), REPARTITION_BY_NUM" in plan for n in (parts, 2 * parts))
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_suppkey * 2 as a", "l_partkey * 2 + 1 as b")
    assert rows(found) == rows(lineitem.selectExpr("least(a, b) as src", "greatest(a, b) as dst").groupBy("src", "dst").count())


def test_buckets_of_an_edge_table_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(sessions, "BUCKET_ROWS", 500)
    seen = []
    write = sources.write_edge_table
    monkeypatch.setattr(sources, "write_edge_table", lambda *given: seen.append(given[3]) or write(*given))
    found = registry.QUERIES["filter_crossing_table"](spark, "/root/testdata/sf0.001")
    assert seen[0] > 8 and found.count() > 0


def test_pushed_labels_are_those_that_are_pulled(spark, monkeypatch):
    """Rounds in which most vertices are active take the labels that their neighbours send; before, there was no such way."""
    edges = sources.random_edges(spark, 300, 900, seed=4).union(spark.createDataFrame([(7, 7), (900, 900)], "umi1 long, umi2 long"))
    edges = graph.canonical_edges(edges)
    one, two = [], []
    pushed = rows(label_propagation.epoch(edges, seed=3, trace=one))
    monkeypatch.setattr(label_propagation, "neighbour_mode_of_many", label_propagation.neighbour_mode)
    monkeypatch.setattr(label_propagation, "MANY", 1)
    assert rows(label_propagation.epoch(edges, seed=3, trace=two)) == pushed and one == two
