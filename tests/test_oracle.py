"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from tidemark.plans.catalog import oracle_sql, queries
from tidemark.plans.check import compare, duckdb_con

# the incremental chain is exercised separately (tests/test_streaming.py)
NAMES = sorted(n for n in queries() if n != "incremental_user_stats")


@pytest.fixture(scope="module")
def con(sf_small):
    return duckdb_con(sf_small)


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, con, name):
    df = queries()[name](spark, sf_small)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(oracle_sql()[name])
    err = compare(rows, df.columns, res.fetchall(), [d[0] for d in res.description])
    assert err is None, err
