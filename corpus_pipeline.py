"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.llm.common import shared_dir, table
from patchlake.llm.decontaminate import decontaminate
from patchlake.llm.line_dedup import dedup_lines
from patchlake.llm.near_dedup import drop_near_duplicates
from patchlake.llm.packing import pack
from patchlake.llm.toxicity import reject_toxic

#: Similarity in percent from which documents are near duplicates here.
NEAR = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from every document with lines of its own; n_chars follows the text that is left."""
    return dedup_lines(docs).select(*[c for c in docs.columns if c != "n_chars"], F.length("text").cast("long").alias("n_chars")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest id."""
    return drop_near_duplicates(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their places in sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Training, tokenizing and similarity links are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each leaves is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return made
        made.write.parquet(f"{at}/{n}-{name}")
        docs = spark.read.parquet(f"{at}/{n}-{name}")
    return docs
