"""Unified diffs as relations: one row of text to many rows of files, lines and units.

The parser is a set of windows over the numbered lines of each diff, all partitioned by
the diff's key, so a diff corpus is parsed with one shuffle and without Python. What a line
means depends on its hunk alone, not on all lines before it:

* a region begins at each ``diff --git`` and each ``@@`` line. In a region with counted
  sides, running sums of old and new lines give the row at which both are reached exactly;
  there the hunk closes, and if it never comes about the hunk stays open.
* ``---`` and ``+++`` lines are file markers unless they stand in an open counted hunk; in a hunk
  without counts the first of them ends it.
* a file begins at ``diff --git``, at an old-side marker unless nothing has come since such
  a header, and at a new-side marker if no file has begun.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HUNK = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"


def _after(line: Column, prefix: str) -> Column:
    return F.substring(line, F.lit(len(prefix) + 1), F.length(line))


def hunk_number(line: Column, group: int, default: int) -> Column:
    """A number of a hunk's header; those that no long can hold are the largest one."""
    digits = F.regexp_extract(line, HUNK, group)
    return F.when(digits == "", F.lit(default)).otherwise(F.coalesce(digits.try_cast("long"), F.lit(1 << 62)))


def read_rows(diffs: DataFrame, keys: Sequence[str], text: str = "diff") -> DataFrame:
    """Every line of every diff with what it is: file_ord (0: before any), kind, hunk_index, paths, numbers."""
    keys = list(keys)
    l = F.col("line")
    rows = diffs.select(*keys, F.posexplode(T.split_lines(F.coalesce(F.col(text), F.lit("")))).alias("line_ord", "line"))
    all_rows = Window.partitionBy(*keys).orderBy("line_ord")
    so_far, before = all_rows.rowsBetween(Window.unboundedPreceding, 0), all_rows.rowsBetween(Window.unboundedPreceding, -1)
    git, minus, plus, moved_from, moved_to = (l.startswith(x) for x in ("diff --git ", "--- ", "+++ ", "rename from ", "rename to "))
    git_old, git_new = T.header_sides(l)
    raw_old = F.when(git, git_old).when(minus, _after(l, "--- ")).when(moved_from, _after(l, "rename from "))
    raw_new = F.when(git, git_new).when(plus, _after(l, "+++ ")).when(moved_to, _after(l, "rename to "))
    rows = rows.withColumn("clean", F.when(git | minus | plus | moved_from | moved_to, F.transform(F.array(raw_old, raw_new), T.clean_path)))
    rows = rows.withColumn("named", F.transform("clean", T.stripped_path))
    rows = rows.withColumns({
        "git": git, "old_marker": minus & F.coalesce(T.is_diff_path(F.col("clean")[0]), F.lit(False)), "new_marker": plus & F.coalesce(T.is_diff_path(F.col("clean")[1]), F.lit(False)),
        "named": F.when(~git | (F.forall("clean", T.is_diff_path) & F.forall("named", lambda x: x.isNotNull())), F.col("named")),
    })
    rows = rows.withColumn("header", l.startswith("@@") & F.coalesce(F.max(F.col("git") | F.col("old_marker") | F.col("new_marker")).over(before), F.lit(False)))
    rows = rows.withColumns({"region": F.count_if(F.col("git") | F.col("header")).over(so_far), "git_no": F.count_if("git").over(so_far)})

    region = Window.partitionBy(*keys, "region").orderBy("line_ord")
    upto, whole = region.rowsBetween(Window.unboundedPreceding, 0), region.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = F.col("header") & l.rlike(HUNK)
    head = F.struct(
        F.col("header").alias("hunk"), counted.alias("counted"), F.col("line_ord").alias("at"),
        F.when(counted, hunk_number(l, 1, 0)).otherwise(0).alias("old_start"), F.when(counted, hunk_number(l, 2, 1)).alias("old_count"),
        F.when(counted, hunk_number(l, 3, 0)).otherwise(0).alias("new_start"), F.when(counted, hunk_number(l, 4, 1)).alias("new_count"),
    )
    body = ~F.col("git") & ~F.col("header")
    on_old, on_new = (body & l.rlike("^[- ]")).cast("long"), (body & l.rlike("^[+ ]")).cast("long")
    rows = rows.withColumns({"head": F.first(head).over(upto), "old_sum": F.sum(on_old).over(upto), "new_sum": F.sum(on_new).over(upto)})
    reached = F.col("head.counted") & (F.col("old_sum") == F.col("head.old_count")) & (F.col("new_sum") == F.col("head.new_count"))
    rows = rows.withColumns({"closed_at": F.min(F.when(reached, F.col("line_ord"))).over(whole), "first_marker": F.min(F.when(F.col("old_marker") | F.col("new_marker"), F.col("line_ord"))).over(whole)})
    under = F.col("head.hunk") & (F.col("line_ord") > F.col("head.at"))
    open_counted = F.coalesce(under & F.col("head.counted") & (F.col("closed_at").isNull() | (F.col("line_ord") <= F.col("closed_at"))), F.lit(False))
    open_bare = F.coalesce(under & ~F.col("head.counted") & (F.col("first_marker").isNull() | (F.col("line_ord") < F.col("first_marker"))), F.lit(False))
    rows = rows.withColumns({"in_counted": open_counted, "inside": open_counted | open_bare})

    kind = (
        F.when(F.col("git"), "git")
        .when(F.col("header"), "hunk")
        .when(F.col("old_marker") & ~F.col("in_counted"), "old_marker")
        .when(F.col("new_marker") & ~F.col("in_counted"), "new_marker")
        .when(F.col("inside") & l.startswith("+"), "addition")
        .when(F.col("inside") & l.startswith("-"), "deletion")
        .when(F.col("inside") & l.startswith(" "), "context")
        .when(~F.col("inside") & l.startswith("rename from "), "rename_from")
        .when(~F.col("inside") & l.startswith("rename to "), "rename_to")
    )
    rows = rows.withColumn("kind", kind)
    event = F.when(F.col("kind").isin("git", "old_marker", "new_marker", "addition", "deletion", "context"), F.col("kind"))
    rows = rows.withColumn("prior", F.last(event, ignorenulls=True).over(before))
    starts = (F.col("kind") == "git") | ((F.col("kind") == "old_marker") & (F.col("prior").isNull() | (F.col("prior") != "git"))) | ((F.col("kind") == "new_marker") & F.col("prior").isNull())
    rows = rows.withColumn("file_ord", F.count_if(F.coalesce(starts, F.lit(False))).over(so_far))
    rows = rows.withColumn("hunk_index", F.count_if("header").over(Window.partitionBy(*keys, "git_no").orderBy("line_ord").rowsBetween(Window.unboundedPreceding, 0)))

    in_file = Window.partitionBy(*keys, "file_ord").orderBy("line_ord").rowsBetween(Window.unboundedPreceding, 0)
    side = lambda n: F.struct(F.col("named")[n].alias("path"))
    last = lambda value: F.last(value, ignorenulls=True).over(in_file)["path"]
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    rows = rows.withColumns({
        "old_path": last(F.when(is_("git", "old_marker", "rename_from"), side(0))), "new_path": last(F.when(is_("git", "new_marker", "rename_to"), side(1))),
        "rename_from": last(F.when(is_("rename_from"), side(0))), "rename_to": last(F.when(is_("rename_to"), side(1))),
    })
    old_at = F.col("head.old_start") + F.col("old_sum") - F.when(F.col("kind").isin("deletion", "context"), 1).otherwise(0)
    new_at = F.col("head.new_start") + F.col("new_sum") - F.when(F.col("kind").isin("addition", "context"), 1).otherwise(0)
    return rows.select(
        *keys, "line_ord", "file_ord", "kind", "line", "hunk_index", "old_path", "new_path", "rename_from", "rename_to",
        F.when(F.col("kind").isin("deletion", "context"), old_at).alias("old_line_number"), F.when(F.col("kind").isin("addition", "context"), new_at).alias("new_line_number"),
    )


def diff_lines(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The hunks' lines: operation, text, path of the line's side, paths as they stood at the line."""
    path = F.when(F.col("kind") == "deletion", F.col("old_path")).otherwise(F.col("new_path"))
    some = rows.filter("kind IN ('addition', 'deletion', 'context') AND file_ord > 0")
    return some.select(*keys, "file_ord", "hunk_index", "line_ord", F.col("kind").alias("operation"), F.substring("line", 2, 2**31 - 1).alias("text"), path.alias("path"), "old_path", "new_path", "old_line_number", "new_line_number")


def diff_files(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files with their final paths; a file without paths, renames and lines is none."""
    last = lambda c: F.max_by(c, "line_ord")
    content = F.col("kind").isin("addition", "deletion", "context")
    files = rows.filter("file_ord > 0").groupBy(*keys, "file_ord").agg(
        *[last(c).alias(c) for c in ("old_path", "new_path", "rename_from", "rename_to")],
        F.count_if(content).alias("n_lines"), F.count_if(F.col("kind") == "addition").alias("n_added"), F.count_if(F.col("kind") == "deletion").alias("n_deleted"),
        F.count_distinct(F.when(content, F.col("hunk_index"))).alias("n_hunks"),
    )
    some = F.coalesce("old_path", "new_path", "rename_from", "rename_to").isNotNull() | (F.col("n_lines") > 0)
    return files.filter(some).withColumn("canonical_path", F.coalesce("new_path", "old_path"))


def change_units(rows: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Renames, then added and deleted lines of each file, numbered after blank ones are gone."""
    keys = list(keys)
    moved = diff_files(rows, keys).filter("rename_from IS NOT NULL AND rename_to IS NOT NULL")
    empty = F.lit(None).cast("long")
    renames = moved.select(*keys, "file_ord", F.lit(-1).alias("line_ord"), F.lit("rename").alias("kind"), F.col("rename_to").alias("path"), F.concat("rename_from", F.lit(" -> "), "rename_to").alias("text"), F.lit(0).cast("long").alias("hunk_index"), F.col("rename_from").alias("old_path"), F.col("rename_to").alias("new_path"), empty.alias("source_line"), empty.alias("target_line"))
    lines = diff_lines(rows, keys).filter("operation <> 'context'")
    changed = lines.select(*keys, "file_ord", "line_ord", F.col("operation").alias("kind"), F.coalesce(F.nullif("path", F.lit("")), F.lit("unknown")).alias("path"), "text", "hunk_index", "old_path", "new_path", F.col("old_line_number").alias("source_line"), F.col("new_line_number").alias("target_line"))
    units = renames.unionByName(changed).withColumn("text", T.collapse(F.col("text"))).filter("text <> ''")
    units = units.withColumn("unit", F.row_number().over(Window.partitionBy(*keys).orderBy("file_ord", "line_ord")))
    return units.withColumn("unit_id", F.concat(F.lit(f"{prefix}-"), F.col("unit").cast("string"))).drop("file_ord", "line_ord")


def diff_stats(diffs: DataFrame, keys: Sequence[str], text: str = "diff") -> DataFrame:
    """Counts from line beginnings alone, whatever the hunks say."""
    lines = T.split_lines(F.coalesce(F.col(text), F.lit("")))
    many = lambda test: F.size(F.filter(lines, test)).cast("long")
    named = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^diff --git a/(.+) b/.+$", 1)), lambda x: x != "")
    return diffs.select(
        *keys, F.array_sort(F.array_distinct(named)).alias("files"), many(lambda x: x.startswith("+") & ~x.startswith("+++")).alias("added"),
        many(lambda x: x.startswith("-") & ~x.startswith("---")).alias("deleted"), many(lambda x: x.startswith("@@")).alias("hunks"),
    )


#: Fenced blocks of a comment that hold a change.
FENCE = r"(?is)`{3,}(diff|patch|suggestion)\s*\n(.*?)\n`{3,}"


def fence_to_diff(language: Column, body: Column, path: Column) -> Column:
    """A fenced block, without the space around it, as a diff.

    ``diff`` and ``patch`` fences get file markers where they have none, others become added lines;
    without a path the block stays as it is, and is null if it is empty.
    """
    text = T.strip(body)
    markers = F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"))
    is_diff, marked = F.lower(language).isin("diff", "patch"), F.startswith(text, F.lit("diff --git ")) | F.startswith(text, F.lit("--- "))
    added = F.concat(markers, F.lit("@@\n"), F.when(text == "", "").otherwise(F.array_join(F.transform(T.split_lines(text), lambda x: F.concat(F.lit("+"), x)), "\n")))
    bare = F.nullif(path, F.lit("")).isNull()
    return F.when(bare | (is_diff & marked), F.nullif(text, F.lit(""))).when(is_diff, F.concat(markers, text)).otherwise(added)


def comment_suggestions(comments: DataFrame, keys: Sequence[str], body: str, path: str) -> DataFrame:
    """(keys, n, language, diff): the fenced changes of each comment, counted from 1 in their order."""
    found = comments.select(*keys, path, F.posexplode(F.regexp_extract_all(body, F.lit(FENCE), F.lit(0))).alias("_at", "_fence"))
    part = lambda g: F.regexp_extract("_fence", FENCE, g)
    made = found.select(*keys, (F.col("_at") + 1).alias("n"), F.lower(part(1)).alias("language"), fence_to_diff(part(1), part(2), F.col(path)).alias("diff"))
    return made.filter("diff IS NOT NULL")


def edit_shape(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """edit_type (operations joined by +, rename too) and size (small to 3 changes, medium to 10, else large)."""
    ops = diff_lines(rows, keys).filter("operation <> 'context'").groupBy(*keys).agg(F.collect_set("operation").alias("ops"), F.count("*").alias("n"))
    moved = diff_files(rows, keys).groupBy(*keys).agg(F.bool_or(F.col("rename_from").isNotNull() & F.col("rename_to").isNotNull()).alias("renamed"))
    both = moved.join(ops, list(keys), "left")
    named = F.array_union(F.coalesce("ops", F.array().cast("array<string>")), F.when(F.col("renamed"), F.array(F.lit("rename"))).otherwise(F.array().cast("array<string>")))
    n = F.coalesce("n", F.lit(0))
    return both.select(*keys, F.array_join(F.array_sort(named), "+").alias("edit_type"), F.when(n <= 3, "small").when(n <= 10, "medium").otherwise("large").alias("size"))
