"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import find_leaks
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .packing import pack
from .quality import judge_quality
from .secret_scan import scan_secrets
from .substring_dedup import remove_repeats
from .toxicity import score_toxicity
from .url_filter import filter_urls


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks: a row for each document and benchmark item that it takes up."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_packing": op3_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": r"""
WITH p AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT p.*, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
    "op10_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(source, chr(0)) AS site, text FROM documents),
l AS (SELECT n, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL),
b AS (SELECT trim(line) AS t FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 10),
c AS (SELECT n, count(*) AS n_lines, count(*) FILTER (t IS NOT NULL) AS gone, count(*) FILTER (t IS NULL AND trim(line) <> '') AS own, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (t IS NULL), '') AS kept FROM l LEFT JOIN b ON trim(line) = t GROUP BY n)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, CASE WHEN gone > 0 AND own > 0 THEN gone ELSE 0 END AS n_removed, CASE WHEN gone > 0 AND own > 0 THEN kept ELSE text END AS text FROM d LEFT JOIN c USING (n)""",
}
