"""Registered queries of well-formedness, support and landing paths of diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assess, diff
from .derived import WORLD, diff_pairs, spread_documents, table
from .queries import KEY, query


def faulty_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, diff): each document's lines added to a file, in thirteen ways, twelve of them faulty."""
    d = spread_documents(spark, sf_dir).select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("l"), F.concat("source", F.lit("/f"), (F.col("doc_id") % 7).cast("string"), F.lit(".txt")).alias("p"))
    p, n, way = F.col("p"), F.size("l"), F.col("doc_id") % 13
    added = F.array_join(F.transform("l", lambda x: F.concat(F.lit("+"), x)), "\n")
    words = F.array_join(F.transform("l", lambda x: F.concat(F.lit("| "), x)), "\n")
    old, new, git = F.concat(F.lit("--- a/"), p), F.concat(F.lit("+++ b/"), p), F.concat(F.lit("diff --git a/"), p)
    head = lambda more: F.concat(F.lit("@@ -0,0 +1,"), (n + more).cast("string"), F.lit(" @@"))
    text = lambda *lines: F.concat_ws("\n", *lines)
    good = text(old, new, head(0), added)
    ways = [
        good, F.lit(" "), words, text(old, new, head(1), added), text(old, new, head(-1), added), text(old, new, F.lit("@@ bad @@"), added), old, text(old, new),
        text(new, old, head(0), added), text(git, good), text(F.concat(F.lit("--- "), p), new, head(0), added),
        text(F.concat(git, F.lit(" b/"), p), F.concat(F.lit("rename from "), p), F.lit("--- a/other"), new, head(0), added), text(old, new, head(0), F.lit("words"), added),
    ]
    chosen = F.lit(None).cast("string")
    for i, x in enumerate(ways):
        chosen = F.when(way == i, x).otherwise(chosen)
    return d.select("doc_id", chosen.alias("diff"))


@query("""WITH d AS (SELECT doc_id, source || '/f' || (doc_id % 7) || '.txt' AS p, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents),
w(way, nth, code, line, more, path, hunk) AS (VALUES (1, 1, 'empty_input', NULL, 0, NULL, NULL), (2, 1, 'non_diff_input', 1, 0, NULL, NULL), (3, 1, 'incomplete_hunk', 3, 0, 'p', 1), (4, 1, 'overflowing_hunk', 3, 1, 'p', 1),
  (5, 1, 'malformed_hunk_header', 3, 0, 'p', 1), (6, 1, 'missing_file_marker_pair', 1, 0, 'p', NULL), (7, 1, 'missing_hunk', 2, 0, 'p', NULL), (8, 1, 'reordered_file_markers', 1, 0, 'p', NULL), (9, 1, 'malformed_git_header', 1, 0, NULL, NULL),
  (10, 1, 'invalid_file_marker', 1, 0, NULL, NULL), (10, 2, 'reordered_file_markers', 2, 0, 'p', NULL), (10, 3, 'missing_file_marker_pair', 3, 0, 'p', 1),
  (11, 1, 'conflicting_file_path', 3, 0, 'other', NULL), (11, 2, 'partial_rename_metadata', 2, 0, 'p', NULL), (12, 1, 'invalid_hunk_body_line', 4, 0, 'p', 1))
SELECT doc_id, CAST(nth AS INT) AS nth, code, CAST(line + more * n AS BIGINT) AS line_number, CASE WHEN path = 'p' THEN p ELSE path END AS file_path, CAST(hunk AS BIGINT) AS hunk_index FROM d JOIN w ON doc_id % 13 = way""")
def diff_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.diagnostics_of_texts(faulty_diffs(spark, sf_dir), KEY).select("doc_id", F.col("nth").cast("int").alias("nth"), "code", "line_number", "file_path", "hunk_index")


@query(WORLD + f""", s AS (SELECT doc_id, coalesce(bool_or(op = 'addition' AND trim(line) <> ''), false) AS adds, coalesce(bool_or(op = 'deletion' AND trim(line) <> ''), false) AS removes FROM sug GROUP BY doc_id)
SELECT doc_id, CASE WHEN removes OR NOT adds THEN 'valid_but_unsupported' ELSE 'valid' END AS status, concat_ws('; ', CASE WHEN NOT adds THEN '{assess.NOTHING_ADDED}' END, CASE WHEN removes THEN '{assess.REMOVES}' END) AS reasons FROM s""")
def support_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.support_state(diff_pairs(spark, sf_dir), KEY, "suggested").select("doc_id", "status", F.array_join("reasons", "; ").alias("reasons"))


@query("""SELECT doc_id, source AS path, CASE doc_id % 4 WHEN 0 THEN source || '.new' WHEN 1 THEN NULL ELSE source END AS landed_path, CASE doc_id % 4 WHEN 0 THEN 'renamed' WHEN 1 THEN 'deleted' ELSE 'same' END AS change FROM documents""")
def landing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's source as a file that the merged diff renames, deletes, changes or leaves alone."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"))
    git = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path")
    side = lambda sign, p: F.concat(F.lit(sign), p)
    change = lambda old, new: F.concat_ws("\n", git, old, new, F.lit("@@ -1 +1 @@\n same"))
    renamed = F.concat_ws("\n", F.concat(git, F.lit(".new")), side("rename from ", "path"), F.concat(F.lit("rename to "), "path", F.lit(".new")))
    way = F.col("doc_id") % 4
    text = F.when(way == 0, renamed).when(way == 1, change(side("--- a/", "path"), F.lit("+++ /dev/null"))).when(way == 2, change(side("--- a/", "path"), side("+++ b/", "path"))).otherwise("diff --git a/else b/else\n--- a/else\n+++ b/else\n@@ -1 +1 @@\n same")
    files = diff.diff_files(diff.read_rows(d.withColumn("diff", text), KEY), KEY)
    return assess.landing_paths(d, files, KEY)
