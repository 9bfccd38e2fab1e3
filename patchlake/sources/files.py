"""JSON lines, CSV and staged tables: readers that keep where a row came from, writers that publish at once."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without it takes a temporary one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "patchlake-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line): the physical lines of text files, from 1.

    A file is read as one value, as numbers run through it; give many files, not large ones.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    parts = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n", -1)
    return whole.select("file", F.posexplode(parts).alias("at", "line")).select("file", (F.col("at") + 1).alias("line_number"), "line")


def parsed_objects(lines: DataFrame, schema: StructType | str, line: str = "line") -> DataFrame:
    """Rows of ``lines`` that aren't blank, with ``row`` and, where a line is no JSON object, ``issue``."""
    some = lines.filter(F.trim(F.col(line)) != "")
    text = F.trim(F.col(line))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    return some.withColumn("row", F.when(is_object, F.from_json(text, schema))).withColumn("issue", F.when(~is_object, "invalid_json"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, numbered: bool = True) -> DataFrame:
    """(file, line_number, row, issue) of JSON lines; blank lines are skipped but counted.

    Without numbers (null then) large files are split among tasks.
    """
    lines = numbered_lines(spark, path) if numbered else spark.read.text(path).select(F.input_file_name().alias("file"), F.lit(None).cast("int").alias("line_number"), F.col("value").alias("line"))
    return parsed_objects(lines, schema).drop("line")


def refuse_issues(rows: DataFrame) -> DataFrame:
    """Rows without issues; the first one found ends the job with its place."""
    at = F.concat(F.lit("Invalid JSON at "), F.col("file"), F.lit(":"), F.col("line_number").cast("string"))
    return rows.filter(F.when(F.col("issue").isNotNull(), F.raise_error(at).cast("boolean")).otherwise(True)).drop("issue")


def jsonl_lines(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object with its keys in order of name; nulls are written."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def publish(spark: SparkSession, write, path: str) -> None:
    """``write`` into a folder beside ``path``, which is renamed to it at the end; an existing one is refused."""
    jvm = spark.sparkContext._jvm
    target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.staged-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    try:
        write(staged.toString())
        if not fs.rename(staged, target):
            raise FileExistsError(path)
    finally:
        fs.delete(staged, True)


def write_jsonl(df: DataFrame, path: str) -> None:
    publish(df.sparkSession, lambda at: jsonl_lines(df).write.text(at), path)


# What stands for a null in CSV; a text of backslashes and N that could be taken for one has a backslash more in the file.
_NULL, _LIKE_NULL = "\\N", r"^\\+N$"


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, columns in order of name; nulls stay apart from empty texts, white space at the ends is kept."""
    names = sorted(df.columns)
    text = {c: F.col(f"`{c}`") for c in names if df.schema[c].dataType.simpleString() == "string"}
    ordered = df.select(*[F.when(text[c].rlike(_LIKE_NULL), F.concat(F.lit("\\"), text[c])).otherwise(text[c]).alias(c) if c in text else F.col(f"`{c}`") for c in names])
    writer = {"header": True, "nullValue": _NULL, "emptyValue": '""', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}
    publish(df.sparkSession, lambda at: ordered.write.options(**writer).csv(at), path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """By the header's names; all texts without a schema."""
    reader = spark.read.option("header", True).option("nullValue", _NULL).option("emptyValue", "").option("escape", '"').option("multiLine", True).option("mode", "FAILFAST")
    rows = (reader.schema(schema) if schema else reader).csv(path)
    text = {f.name: F.col(f"`{f.name}`") for f in rows.schema if f.dataType.simpleString() == "string"}
    return rows.select(*[F.when(text[c].rlike(_LIKE_NULL), F.substring(text[c], 2, 2**31 - 1)).otherwise(text[c]).alias(c) if c in text else F.col(f"`{c}`") for c in rows.columns])


def split_issues(rows: DataFrame, key: str, split: str, known: Sequence[str]) -> DataFrame:
    """(key, issue) of assignments without an id, to no known split, or given twice."""
    blank: Column = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    single = rows.select(F.col(key), F.when(blank, "missing_id").when(~F.coalesce(F.col(split).isin(*known), F.lit(False)), "unknown_split").alias("issue")).filter("issue IS NOT NULL")
    twice = rows.filter(~blank).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit("repeated_id").alias("issue"))
    return single.unionByName(twice)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, n_bytes) of whole files; Spark lists no empty ones."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def hash_issues(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, issue) of files that are missing, not listed, or of another hash than the manifest (file, sha256) says."""
    both = found.select("file", F.col("sha256").alias("is")).join(manifest.select("file", F.col("sha256").alias("should")), "file", "full_outer")
    issue = F.when(F.col("is").isNull(), "missing").when(F.col("should").isNull(), "not_listed").when(F.col("is") != F.col("should"), "changed")
    return both.select("file", issue.alias("issue")).filter("issue IS NOT NULL")
