"""Every registered query against its DuckDB oracle on the smallest scale factor
(queries without an oracle must run and return a stable schema)."""

import pytest

import __spark_entry__ as entry
from shapes import SF_SMALL
from spindle.plans.oracle_check import compare, duck

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    if name not in ORACLES:
        assert df.count() >= 0 and len(df.columns) > 0
        return
    ok, msg = compare(df, con, ORACLES[name])
    assert ok, msg


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == entry.entry(spark).columns
