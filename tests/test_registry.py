"""Every query of the graph library against the SQL it is registered with, and invariants of those without."""

import math
import os

import duckdb
import pytest

from loomgraph import registry

DATA = os.environ.get("LOOMGRAPH_TEST_DATA", "/root/testdata/sf0.001")
TABLES = ("lineitem", "orders", "customer", "events", "nation", "region")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value if value is None or isinstance(value, (bool, int, str)) else float(value)


def in_order(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted(([plain(r[i]) for i in at] for r in rows), key=lambda r: [(x is None, str(type(x)), x) for x in r])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    said = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in said.description]
    assert in_order(got.columns, got.collect()) == in_order(names, said.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_repeats_itself(spark, name):
    once, again = (in_order((df := registry.QUERIES[name](spark, DATA)).columns, df.collect()) for _ in range(2))
    assert once == again and once[1]


def test_every_oracle_has_its_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
