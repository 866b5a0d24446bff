"""Every registered core query against its SQL; those without SQL have to give rows of a stable schema."""

import pytest

from loomline.queries import files, news, panel, streams, text, words
from sqlcheck import assert_same, connect

PARTS = (words, text, news, panel, streams, files)
QUERIES = {k: v for p in PARTS for k, v in p.queries().items()}
SQL = {k: v for p in PARTS for k, v in p.oracle_sql().items()}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, con, name):
    assert_same(con, QUERIES[name](spark, data), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    frame = QUERIES[name](spark, data)
    assert frame.columns and frame.count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["src", "dst", "weight"]
