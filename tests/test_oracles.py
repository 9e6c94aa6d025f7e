"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import pytest
from places import SF001
from oracle_harness import compare, duck

import __spark_entry__ as E

# the training-data operators have their own tests
SQL = {k: v for k, v in E.oracle_sql().items() if k in E.catalog.queries()}


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("key", sorted(SQL))
def test_oracle(spark, con, key):
    problems, _ = compare(spark, con, E.queries()[key], SQL[key], SF001)
    assert not problems, problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["CardUsed", "total_transactions", "fraud_count", "fraud_rate"]


def test_every_query_has_sql_or_is_rows_only():
    assert set(E.catalog.queries()) == set(SQL) | E.ROWS_ONLY
