"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    verdict, rows = compare(QUERIES[name](spark, SF_DIR), con, SQL.get(name))
    assert verdict in ("ok", "rows-only"), verdict


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "scene_id" and df.count() > 0
