"""Registered queries of splits by time and by seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits
from .derived import table
from .queries import query


def _custkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as groups that stay together, with the day of the last."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("component")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))


@query("""WITH g AS (SELECT o_custkey AS component, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY o_custkey),
c AS (SELECT component, row_number() OVER w AS place, sum(n) OVER w AS upto FROM g WINDOW w AS (ORDER BY latest, component)),
t AS (SELECT sum(n) AS rows, count(*) AS k FROM g),
e AS (SELECT k, (SELECT min(place) FROM c WHERE upto >= round_even(rows * 0.60::DOUBLE, 0)) AS p1, (SELECT min(place) FROM c WHERE upto >= round_even(rows * 0.75::DOUBLE, 0)) AS p2, (SELECT min(place) FROM c WHERE upto >= round_even(rows * 0.85::DOUBLE, 0)) AS p3 FROM t),
e1 AS (SELECT *, least(greatest(1, p1), k - 3) AS a FROM e), e2 AS (SELECT *, least(greatest(a + 1, p2), k - 2) AS b FROM e1), e3 AS (SELECT *, least(greatest(b + 1, p3), k - 1) AS d FROM e2)
SELECT component, CASE WHEN place <= a THEN 'train' WHEN place <= b THEN 'development' WHEN place <= d THEN 'calibration' ELSE 'test' END AS split FROM c, e3""")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.temporal_splits(_custkeys(spark, sf_dir))


@query()
def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest group first, each to the split that lacks most rows; the tests hold it against a plain loop."""
    return splits.seeded_splits(_custkeys(spark, sf_dir))
