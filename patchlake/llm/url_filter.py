"""URL filter as a sort-merge range join of hosts with rule intervals.

A host is turned into its labels from the right, each ended by a full stop
(``www.example.org`` is ``org.example.www.``), so a rule's host and all its subdomains
are the keys in one interval ``[key, key with the last stop replaced by a slash)``. Rules' intervals
nest or are disjoint. Each rule host carries the stack of the rules that are open where
its interval begins; a sorted sweep hands every URL the stack of the last rule host at or
before its key. The URL pops what has ended before its key and takes the longest rule
whose path begins its own path.

The sweep is dealt by a salt over the URLs and not by host or domain, so a host with a
third of all URLs spreads over all tasks; each salt gets its own copy of the rules. Both
sides are sorted and can spill; nothing is broadcast.

Defined cases: a null URL or one without ``://`` has empty host and path and fits no rule;
where no rule fits, the verdict is ``default``; of two rules of equal length the one with
the longer host wins, then the smaller text; repeated rows get a row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, shuffle_partitions

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for each rule host the open rules there, its own and its ancestors'."""
    keyed = rules.select("verdict", "path", F.concat("host", "path").alias("rule"), "host", host_key(F.col("host")).alias("key"))
    open_rule = F.struct(F.length("rule").alias("size"), F.length("host").alias("host_size"), "rule", "path", "verdict", F.expr("concat(substring(key, 1, length(key) - 1), '/')").alias("end"))
    own = keyed.groupBy("key").agg(F.collect_set(open_rule).alias("own"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.", -1)
    up = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("ancestor"))
    nested = up.join(own.select(F.col("key").alias("ancestor"), "own"), "ancestor")
    return nested.groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow", salts: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of ``pages``."""
    spark = pages.sparkSession
    salts = salts or 4 * shuffle_partitions(spark)
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    stacks = rule_stacks(rules)
    urls = pages.select(
        F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt"),
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
        F.lit(1).alias("kind"), F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"),
    ).withColumn("key", host_key(F.col("host")))
    opened = stacks.select(
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
        F.lit(0).alias("kind"), "stack", "key",
    )
    sweep = Window.partitionBy("salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = urls.unionByName(opened).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    fits = F.filter("open", lambda r: (F.col("key") < r["end"]) & F.startswith(F.col("path"), r["path"]))
    best = F.reduce(fits, F.lit(None).cast(stacks.schema["stack"].dataType.elementType), lambda a, r: F.when(a.isNull() | (r["size"] > a["size"]) | ((r["size"] == a["size"]) & ((r["host_size"] > a["host_size"]) | ((r["host_size"] == a["host_size"]) & (r["rule"] < a["rule"])))), r).otherwise(a))
    return met.select("page_id", "host", "path", best.alias("best")).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
