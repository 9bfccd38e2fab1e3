"""Every registered query of the engine runs; those with SQL give the same rows as DuckDB."""

import pytest
from oracle import assert_same, connect

import patchlake.plans.assess_queries  # noqa: F401  (registers its queries)
import patchlake.plans.record_queries  # noqa: F401  (registers its queries)
import patchlake.plans.split_queries  # noqa: F401  (registers its queries)
from patchlake.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    assert_same(spark, con, QUERIES[name], ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).collect() is not None
