"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows up to which a two-column side may be broadcast (about 64 MB as a hash relation).
BROADCAST_ROWS = 1_000_000
#: Bytes up to which any other side may be.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(c, UPPER, LOWER)


def lower_for_ascii_match(c: Column) -> Column:
    """Lower case that is exact for ASCII words, several times faster than ``lower_ascii``.

    Letters beyond ASCII may change, but none becomes ASCII: of all characters only the
    Kelvin sign has an ASCII lower case alone, and texts with it take the slow way.
    Word boundaries are the same either way.
    """
    return F.when(F.contains(c, F.lit("\u212a")), lower_ascii(c)).otherwise(F.lower(c))


def rolling_grams(w: str, k: int) -> Column:
    """The k-grams of the array column ``w`` as structs of k words, the last k - 1 with nulls.

    Shifted arrays are zipped, which stays in generated code; lambdas over positions don't.
    """
    return F.arrays_zip(F.col(w), *[F.slice(F.col(w), j + 1, 2**31 - 1).alias(f"w{j}") for j in range(1, k)])


def gram_words(x: str, k: int) -> list[Column]:
    return [F.col(x)[name] for name in ("w", *[f"w{j}" for j in range(1, k)])]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one is set only where none is named.

    A session that names ``spark.checkpoint.dir`` gets exactly that folder. Without it a local
    session (tests) takes a temporary folder, which its driver and executor share; any other
    is refused, for a folder of one machine would not hold what the others write.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "patchlake-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_by_size(left: DataFrame, right: DataFrame, on: Iterable[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``right`` broadcast only if it is counted to be within ``limit`` rows.

    Beyond the bound both sides are shuffled, and adaptive execution splits hot keys.
    The rows of the result are the same either way.
    """
    small = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right, list(on), how)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a compressed table in the shared folder, for what is too large to checkpoint as rows."""
    at = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
