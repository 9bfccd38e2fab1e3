"""The training-data queries that SQL can express give the same rows as DuckDB."""

import pytest
from oracle import assert_same, connect

from patchlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(spark, connect(SF), QUERIES[name], ORACLE_SQL[name], SF)
