import pytest

import __spark_entry__ as entry_module
from check_queries import compare, duck

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 11


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), SQL[name], con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    assert got
    if "floor" in df.columns:
        for r in got:
            better = r.value <= r.floor if r.metric in ("rmse", "mae") else r.value >= r.floor
            assert better, r
