"""A world of diffs derived from the test tables, in Spark and in SQL alike.

Each document is a suggestion: its lines are added to a file (every other one is deleted
where doc_id is divisible by 5). What landed lacks some of the lines, has one more, and is
in another file where doc_id is divisible by 6.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt anew, as a file of few row groups would be read, and its diffs parsed, by few tasks."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text").repartition("doc_id")


def _diff(path, lines):
    count = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign))).cast("string")
    head = F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,"), count("-"), F.lit(" +1,"), count("+"), F.lit(" @@\n"))
    return F.concat(head, F.array_join(lines, "\n"))


def diff_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, path, suggested, landed)."""
    docs = spread_documents(spark, sf_dir).select("doc_id", "source", "lang", F.split("text", "\n", -1).alias("l"))
    path = F.concat("source", F.lit("/f"), (F.col("doc_id") % 7).cast("string"), F.lit(".txt"))
    other = F.when(F.col("doc_id") % 6 == 0, F.concat("source", F.lit("/g.txt"))).otherwise(path)
    signed = F.transform("l", lambda x, i: F.concat(F.when((F.col("doc_id") % 5 == 0) & (i % 2 == 0), "-").otherwise("+"), x))
    some = F.filter("signed", lambda x, i: (i * 7 + F.col("doc_id")) % 4 != 0)
    docs = docs.withColumn("signed", signed)
    landed = F.concat(some, F.array(F.concat(F.lit("+extra "), F.col("doc_id").cast("string"))))
    return docs.select("doc_id", "source", "lang", path.alias("path"), _diff(path, F.col("signed")).alias("suggested"), _diff(other, landed).alias("landed"))


WORLD = r"""
WITH lines AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
sug AS (
  SELECT doc_id, i, source || '/f' || (doc_id % 7) || '.txt' AS path, CASE WHEN doc_id % 5 = 0 AND i % 2 = 0 THEN 'deletion' ELSE 'addition' END AS op, line FROM lines),
land AS (
  SELECT doc_id, i, CASE WHEN doc_id % 6 = 0 THEN regexp_replace(path, 'f[0-9]+[.]txt$', 'g.txt') ELSE path END AS path, op, line FROM sug WHERE (i * 7 + doc_id) % 4 <> 0
  UNION ALL
  SELECT doc_id, 1000000000, CASE WHEN doc_id % 6 = 0 THEN source || '/g.txt' ELSE source || '/f' || (doc_id % 7) || '.txt' END, 'addition', 'extra ' || doc_id FROM documents),
su AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM (SELECT doc_id, i, path, op AS kind, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM sug) WHERE text <> ''),
lu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM (SELECT doc_id, i, path, op AS kind, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM land) WHERE text <> ''),
strict AS (
  SELECT s.doc_id, s.kind, s.text, s.unit AS suggested_unit, l.unit AS landed_unit, s.path AS suggested_path, l.path AS landed_path, 'strict_same_file' AS scope
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, text, path ORDER BY unit) AS k FROM su) s
  JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, text, path ORDER BY unit) AS k FROM lu) l USING (doc_id, kind, text, path, k)),
relaxed AS (
  SELECT s.doc_id, s.kind, s.text, s.unit AS suggested_unit, l.unit AS landed_unit, s.path AS suggested_path, l.path AS landed_path, 'relaxed_cross_file' AS scope
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, text ORDER BY unit) AS k FROM su WHERE (doc_id, unit) NOT IN (SELECT (doc_id, suggested_unit) FROM strict)) s
  JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, text ORDER BY unit) AS k FROM lu WHERE (doc_id, unit) NOT IN (SELECT (doc_id, landed_unit) FROM strict)) l USING (doc_id, kind, text, k)),
matches AS (SELECT * FROM strict UNION ALL SELECT * FROM relaxed)
"""


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, size, actual, predicted): values of 0 to 100 for the metric queries."""
    d = table(spark, sf_dir, "documents")
    actual = (F.col("doc_id") * 37 + F.col("n_chars")) % 101
    size = F.when(F.col("n_chars") < 500, "small").when(F.col("n_chars") < 3000, "medium").otherwise("large")
    predicted = F.greatest(F.lit(0), F.least(F.lit(100), actual + (F.col("doc_id") * 13) % 41 - 20 + F.when(F.col("doc_id") % 17 == 0, 60).otherwise(0)))
    return d.select("doc_id", "source", "lang", size.alias("size"), actual.alias("actual"), predicted.alias("predicted"))


SCORED = """
WITH scored AS (
  SELECT doc_id, source, lang, CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 3000 THEN 'medium' ELSE 'large' END AS size,
    (doc_id * 37 + n_chars) % 101 AS actual,
    greatest(0, least(100, (doc_id * 37 + n_chars) % 101 + (doc_id * 13) % 41 - 20 + CASE WHEN doc_id % 17 = 0 THEN 60 ELSE 0 END)) AS predicted
  FROM documents)
"""


#: Files among which a document's lines are dealt; each takes runs of seven lines, so it has several hunks.
MULTI_PATHS = ("app/main.py", "conf/settings.yaml", "docs/guide.md", "Dockerfile", "data/table.json")


def multi_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, suggested, landed): each document's lines as additions to up to five files of several hunks.

    What landed lacks every fourth line and has every third run of lines in the next file.
    """
    l = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 7).cast("int")), lambda r: F.struct(r.alias("r"), F.slice("l", r * 7 + 1, 7).alias("x")))
    paths = F.array(*map(F.lit, MULTI_PATHS))
    at = lambda r, moved: F.try_element_at(paths, ((r + F.col("doc_id") + moved) % 5 + 1).cast("int"))
    hunk = lambda r, x: F.concat(F.lit("@@ -"), (r * 10 + 1).cast("string"), F.lit(",0 +"), (r * 10 + 1).cast("string"), F.lit(","), F.size(x).cast("string"), F.lit(" @@\n"), F.array_join(F.transform(x, lambda v: F.concat(F.lit("+"), v)), "\n"))

    def whole(runs, moved, some):
        placed = F.transform(runs, lambda z: F.struct(at(z["r"], F.when(z["r"] % 3 == 2, moved).otherwise(0)).alias("p"), z["r"].alias("r"), some(z["x"]).alias("x")))
        placed = F.filter(placed, lambda z: F.size(z["x"]) > 0)
        each = lambda p: F.concat(F.lit("--- a/"), p, F.lit("\n+++ b/"), p, F.lit("\n"), F.array_join(F.transform(F.filter(placed, lambda z: z["p"] == p), lambda z: hunk(z["r"], z["x"])), "\n"))
        return F.array_join(F.transform(F.array_distinct(placed["p"]), each), "\n")

    docs = spread_documents(spark, sf_dir).select("doc_id", l.alias("l")).withColumn("runs", runs)
    fewer = lambda x: F.filter(x, lambda _, i: (i + F.col("doc_id")) % 4 != 0)
    return docs.select("doc_id", whole(F.col("runs"), F.lit(0), lambda x: x).alias("suggested"), whole(F.col("runs"), F.lit(1), fewer).alias("landed"))
