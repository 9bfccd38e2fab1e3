"""Splits of groups of rows that must stay together, by time or by seed.

Input is a row for each group: (component, n) and, for the policy by time, the latest instant of its
rows. Fewer than three groups are refused; three leave out calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import SPLITS, _checkpoint


def active_splits(n_groups: int) -> list[tuple[str, float]]:
    """The splits that so many groups can fill, and the share of rows that each should have."""
    if n_groups < 3:
        raise ValueError("At least three independent groups are needed")
    active = [(s, r) for s, r in SPLITS if n_groups > 3 or s != "calibration"]
    return [(s, r / sum(r for _, r in active)) for s, r in active]


def _running(sizes: DataFrame, order: list[str]) -> DataFrame:
    """``sizes`` with ``place`` (from 1) and ``upto`` (rows to here), in ``order``.

    Ranges of the order are summed apart and only their sums meet, so no task sees all groups.
    """
    ranged = _checkpoint(sizes.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_k"), F.sum("n").alias("_n"))  # one row for each partition
    parts = parts.select("_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_place", F.row_number().over(within)).withColumn("_upto", F.sum("n").over(within))
    return summed.join(F.broadcast(parts), "_part").withColumn("place", F.col("_place") + F.col("_k")).withColumn("upto", F.col("_upto") + F.col("_n")).drop("_part", "_place", "_upto", "_k", "_n")


def temporal_splits(sizes: DataFrame, latest: str = "latest") -> DataFrame:
    """(component, split): groups in the order of their latest instant, cut where a split has its rows.

    Each split has a group at least, and leaves one for each split after it. A group without an
    instant is refused; equal instants go by the group's name.
    """
    total = sizes.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.count_if(F.col(latest).isNull()).alias("unknown")).first()
    if total["unknown"]:
        raise ValueError("Splits by time need an instant for every row")
    active = active_splits(total["groups"])
    targets = [round(total["n"] * sum(r for _, r in active[: i + 1])) for i in range(len(active) - 1)]
    placed = _checkpoint(_running(sizes, [latest, "component"]))
    reached = placed.agg(*[F.min(F.when(F.col("upto") >= t, F.col("place"))).alias(f"t{i}") for i, t in enumerate(targets)]).first()
    split, last = F.lit(active[-1][0]), 0
    ends = []
    for i in range(len(targets)):
        last = min(max(last + 1, reached[i]), total["groups"] - (len(targets) - i))
        ends.append(last)
    for (name, _), end in reversed(list(zip(active, ends, strict=False))):
        split = F.when(F.col("place") <= end, name).otherwise(split)
    return placed.select("component", split.alias("split"))


def seeded_splits(sizes: DataFrame, seed: int = 42) -> DataFrame:
    """(component, split): the largest group first, each to the split that lacks most rows.

    The first groups go to one split each. Groups of equal size go by the hash of seed and name.
    The rule is sequential: it runs in one task over a row for each group, holding four counters.
    """
    total = sizes.agg(F.count("*").alias("groups"), F.sum("n").alias("n")).first()
    active = active_splits(total["groups"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled, done = [0] * len(active), 0
        for batch in batches:
            out = []
            for n in batch["n"].tolist():
                i = done if done < len(active) else max(range(len(active)), key=lambda k: (active[k][1] * total["n"] - filled[k], -k))
                filled[i] += n
                done += 1
                out.append(active[i][0])
            yield pd.DataFrame({"component": batch["component"], "split": out})

    drawn = sizes.select("component", "n", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("component").cast("string")), 256).alias("_draw"))
    kind = sizes.schema["component"].dataType.simpleString()
    return drawn.repartition(1).sortWithinPartitions(F.desc("n"), "_draw").mapInPandas(run, f"component {kind}, split string")
