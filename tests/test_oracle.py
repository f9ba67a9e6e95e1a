"""Every catalogue query against its DuckDB oracle on the smallest supplied tables.

The driver runs the same comparison at sf0.01 (``python tests/oracle.py`` does
that by hand); sf0.001 keeps the suite quick and exercises small-input edges.
"""

import os

import pytest

import __spark_entry__ as E
from tests.oracle import compare, duck

SF = os.environ.get("PLATEWISE_TEST_SF", "/root/testdata/sf0.001")
QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    ok, msg = compare(spark, key, SF, QUERIES, ORACLES, con)
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "representation" in df.columns
