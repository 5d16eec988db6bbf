import os

import pytest

from loomgraph import sessions


class Cluster:
    """As much of a session as ``shared_dir`` asks: a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_no_folder_of_the_driver_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        sessions.shared_dir(Cluster)


def test_tables_are_cut_and_dropped(spark):
    table = sessions.cut(spark.range(5), "some")
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert spark.sparkContext.applicationId in folder and os.path.isdir(folder) and table.count() == 5
    sessions.drop_table(table)
    assert not os.path.exists(folder)


def test_rounds_broadcast_little_and_leave_settings(spark):
    """A table of 200,000 rows has few MB in its files: Spark would broadcast it, a loop of rounds doesn't."""
    from loomgraph.sessions import cut, sparing

    name, wide, other = "spark.sql.autoBroadcastJoinThreshold", spark.range(200_000), spark.range(400_000)
    table = cut(wide.selectExpr("id", "id as pid"), "wide")
    plan = lambda df: df.join(cut(other.toDF("id"), "other"), "id")._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get(name)
    assert "BroadcastHashJoin" in plan(table) and "BroadcastHashJoin" not in sparing(plan)(table)
    assert spark.conf.get(name) == before
    spark.conf.set(name, "-1")
    try:
        assert sparing(lambda df: df.sparkSession.conf.get(name))(table) == "-1" == spark.conf.get(name)
    finally:
        spark.conf.unset(name)
