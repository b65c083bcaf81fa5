"""Every registered query against its DuckDB oracle SQL (same tables, same column names)."""

import pytest

import __spark_entry__ as E
from tabsmith.plans.registry import all_oracle_sql, all_queries
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck

SQL = all_oracle_sql()
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(QUERIES[name](spark, SF_SMALL), SQL[name], con)
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_query_runs(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {r["__ml_split__"] for r in rows} == {"train", "test"}
    assert df.columns == ["__ml_split__", "n", "rmse", "mae", "r2"]
