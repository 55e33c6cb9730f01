"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from pageloom.plans import catalog, oracles

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracles.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, connection, name):
    assert difference(spark, connection, FOLDER, name) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 50
    assert all(row["title"] and row["text"] for row in rows)
