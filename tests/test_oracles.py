"""Every SQL-checkable registered query equals its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

from conftest import SF_SMALL

SQL_QUERIES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_query_matches_oracle(spark, con, name):
    status, n, _, msg = compare(spark, con, SF_SMALL, name, E.queries()[name], E.oracle_sql()[name])
    assert status == "ok", msg


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["column_name", "column_type", "drift_score", "drift_detected"]
    assert df.count() == 11
