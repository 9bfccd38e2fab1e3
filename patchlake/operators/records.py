"""Checks, projections, rankings and summaries of rows of suggestions, labels and scores.

All are expressions, aggregations or joins of built-in functions. A value that fails a check is null,
so callers keep, drop or refuse such rows; ``failing`` counts them where a set must be clean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def continuous_percentage(text: Column) -> Column:
    """A number of 0 to 100; null for anything else, truth values and NaN included."""
    v = F.trim(text).try_cast("double")
    return F.when(~F.isnan(v) & v.between(0, 100), v)


def integer_percentage(text: Column) -> Column:
    v = continuous_percentage(text)
    return F.when(v == F.floor(v), v.cast("int"))


def clipped_percentage(v: Column) -> Column:
    """Within 0 to 100, rounded half to even."""
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(100.0), v))).cast("int")


def truth(text: Column) -> Column:
    s = F.lower(F.trim(text))
    return F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False)


def in_domain(name: str, v: Column) -> Column:
    """Whether a feature's value may stand in a column of its name: shares within 0 to 1, counts and sizes not negative."""
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    if name.endswith(("_recall", "_precision", "_f1", "_ratio", "_overlap", "_similarity")):
        return finite & v.between(0, 1)
    return finite & (v >= 0) if name.endswith(("_count", "_size", "_norm")) else finite


def size_bucket(changed: Column) -> Column:
    return F.when(changed <= 3, "small").when(changed <= 10, "medium").otherwise("large")


def edit_types(lines: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, edit_type, size): the kinds of change in a diff, sorted and joined, and how large it is."""
    kinds = lines.filter("operation <> 'context'").select(*keys, F.col("operation").alias("kind"), F.lit(1).alias("n"))
    renames = files.filter("rename_from IS NOT NULL AND rename_to IS NOT NULL").select(*keys, F.lit("rename").alias("kind"), F.lit(0).alias("n"))
    return kinds.unionByName(renames).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("edit_type"), size_bucket(F.sum("n")).alias("size"))


def identity(url: Column) -> Column:
    """host/owner/repo#number of a pull request's address, whatever its case, scheme, query and ``.git``."""
    parts = [F.regexp_extract(F.lower(url), r"^(?:https?://)?([^/?#]+)/([^/?#]+)/([^/?#]+?)(?:\.git)?/pull/([0-9]+)", n) for n in (1, 2, 3, 4)]
    return F.when(parts[3] != "", F.concat(parts[0], F.lit("/"), parts[1], F.lit("/"), parts[2], F.lit("#"), parts[3]))


def middle_truncated(text: Column, most: int, marker: str = "\n...\n") -> Column:
    """The ends of a text of more than ``most`` characters, with a marker between them."""
    left = (most - len(marker)) // 2
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, left), F.lit(marker), F.right(text, F.lit(most - len(marker) - left)))).otherwise(text)


def percent_text(share: Column) -> Column:
    """A share as a whole percentage, rounded half to even."""
    return F.concat(F.rint(share * 100).cast("int").cast("string"), F.lit("%"))


def chunks(items: Column, size: int, overlap: int) -> Column:
    """Arrays of ``size`` items, each with the last ``overlap`` of the one before; the last may be shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(items) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.size(items) > 0, F.transform(starts, lambda i: F.slice(items, i + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def instant(text: Column) -> Column:
    """A time with an offset or Z; null without."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")))


def truly_before(first: Column, second: Column) -> Column:
    return F.coalesce(instant(first) < instant(second), F.lit(False))


def out_of_order(rows: DataFrame, group: str, at: Sequence[str], rank: str) -> DataFrame:
    """Rows whose rank is less than one before them in their group: splits that run back in time."""
    before = Window.partitionBy(group).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("highest_before", F.max(rank).over(before)).filter(F.col("highest_before") > F.col(rank))


def dealt(rows: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """Each row for two of ``n`` readers in turn, by its place in the order.

    Places come from a sort by ranges and the sizes of the ranges before, not from one task.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_own": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    at = (F.col("_before") + F.col("_own")).alias("_at")
    return placed.join(F.broadcast(before), "_part").select(*rows.columns, at).select(*rows.columns, F.explode(F.array(F.col("_at") % n, (F.col("_at") + 1) % n)).alias("reader"))


def first_of(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with their places."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= n)


def baselines(rows: DataFrame, actual: str, train: Column, columns: Sequence[str]) -> DataFrame:
    """(name, n, mae) of the training mean and median and of columns, on the rows that are not for training."""
    mean, median = F.avg(F.when(train, F.col(actual))), F.median(F.when(train, F.col(actual)))
    level = rows.agg(mean.alias("mean"), median.alias("median"))
    held = rows.filter(~train).crossJoin(F.broadcast(level))  # of one row
    guesses = {"mean": F.col("mean"), "median": F.col("median"), **{c: F.col(c) for c in columns}}
    each = held.select(actual, F.explode(F.create_map(*[x for k, v in guesses.items() for x in (F.lit(k), v.cast("double"))])).alias("name", "guess"))
    return each.groupBy("name").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("guess") - F.col(actual))).alias("mae"))


def best_by(rows: DataFrame, error: str, order: str) -> DataFrame:
    """The row of the least error, the first in order of equal ones."""
    return rows.agg(F.min_by(F.struct("*"), F.struct(error, order)).alias("r")).select("r.*")


def macro_means(rows: DataFrame, group: str, error: Column, least: int) -> DataFrame:
    """(n_groups, macro, micro): the mean of the means of groups of ``least`` rows or more, and of their rows."""
    of = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(error).alias("m"), F.sum(error).alias("s")).filter(F.col("n") >= least)
    return of.agg(F.count("*").alias("n_groups"), F.avg("m").alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"))


def folds(rows: DataFrame, group: str, n: int, seed: int = 0) -> DataFrame:
    """Rows with the fold of their group, by a seeded hash of the group: groups stay whole."""
    fold = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")), 256), 1, 8), 16, 10).cast("long") % n
    return rows.withColumn("fold", fold)


def joined_checked(left: DataFrame, right: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """Rows of both sides by key with what is wrong: missing on a side, or another value in a column of both."""
    a, b = left.alias("a"), right.alias("b")
    wrong = F.when(F.col(f"b.{key}").isNull(), "missing_right").when(F.col(f"a.{key}").isNull(), "missing_left")
    for c in same:
        wrong = wrong.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), f"other_{c}")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), wrong.alias("issue"))


def sample_weight(source: Column, confidence: Column, floor: float = 0.25) -> Column:
    """Own rows weigh their confidence, at least ``floor``; others half of that."""
    own = F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(floor))
    return F.when(source == "internal", own).otherwise(own / 2)


def blended(a: Column, b: Column, weight: float, most: float) -> Column:
    """A convex blend of two predictions, the first alone where they differ by more than ``most``, within 0 to 100."""
    v = F.when(F.abs(a - b) > most, a).otherwise(weight * a + (1 - weight) * b)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), v))


def overlap_estimate(files: Column, lines: Column) -> Column:
    """The rough percentage of two overlaps of 4 places each."""
    return F.rint((0.35 * F.bround(files, 4) + 0.65 * F.bround(lines, 4)) * 100).cast("int")


def holds_any(text: Column, needles: Sequence[str]) -> Column:
    """Whether a text holds one of the needles, whatever their case."""
    low, out = F.lower(text), F.lit(False)
    for x in needles:
        out = out | F.contains(low, F.lit(x.lower()))
    return F.coalesce(out, F.lit(False))


def plain_lines(text: Column) -> Column:
    """Lines that are no part of a diff's syntax, without the white space around them."""
    syntax = r"^(?:[+\-]|@@|diff --git |index |new file|deleted file|similarity |rename |old mode|new mode|\\)"
    return F.filter(F.transform(T.split_lines(F.coalesce(text, F.lit(""))), T.strip), lambda x: (x != "") & ~x.rlike(syntax))


def diff_flags(text: Column) -> dict[str, Column]:
    """Whether a diff renames, changes settings files, or has lines of context."""
    header = r"(?m)^(?:\+\+\+|---) [^\n]*\.(?:ya?ml|toml|ini|cfg|json|env|properties|conf)\s*$"
    return {
        "has_renames": F.contains(text, F.lit("rename from ")) & F.contains(text, F.lit("rename to ")),
        "touches_config": text.rlike(header),
        "has_context": text.rlike(r"(?m)^ [^\n]*$"),
    }


#: What a candidate of the benchmark needs, in the order in which what is missing is told.
EVIDENCE = {
    "repository_identity": "repository identity",
    "pr_identity": "PR URL or PR identifier",
    "suggestion_anchor": "stable inline suggestion anchor",
    "suggested_diff": "suggested diff",
    "original_file_path": "original file path",
    "original_snapshot_or_context": "original file snapshot or enough pre-suggestion context",
    "merged_pr_diff": "merged PR diff",
    "final_snapshot_or_context": "final file snapshot or enough final evidence",
    "merge_revision": "merge commit or comparable final revision",
    "final_path_mapping": "final path mapping when a rename is involved",
    "suggestion_provenance": "validated suggestion provenance",
}
#: Those of them that can't be made up for later.
NOT_REBUILT = ("repository_identity", "pr_identity", "suggestion_anchor", "suggested_diff", "original_file_path", "merged_pr_diff", "merge_revision")


def missing_evidence(flags: dict[str, Column]) -> Column:
    """Names of what a row lacks; a null flag is lacking."""
    return F.filter(F.array(*[F.when(~F.coalesce(flags[k], F.lit(False)), F.lit(name)) for k, name in EVIDENCE.items()]), lambda x: x.isNotNull())


def evidence_status(flags: dict[str, Column]) -> Column:
    has = lambda names: F.least(*[F.coalesce(flags[k], F.lit(False)) for k in names])
    return F.when(has(EVIDENCE), "benchmark_ready").when(has(NOT_REBUILT), "needs_reconstruction").otherwise("quarantined")


def audit(confidence: Column, flags: Column, statuses: Column) -> Column:
    """(status, weight): how far a label is trusted, by its reviewer's confidence, its flags and the states of its units."""
    any_of = lambda *names: F.exists(statuses, lambda s: s.isin(*names))
    out = lambda name, weight: F.struct(F.lit(name).alias("status"), F.lit(weight).alias("weight"))
    mixed = any_of("landed_exactly", "landed_equivalently") & any_of("landed_partially", "absent", "different_implementation")
    fuzzy = (F.size(statuses) > 0) & F.forall(statuses, lambda s: s == "landed_partially")
    return (
        F.when(F.array_contains(flags, "manually_verified"), out("manually_verified", 1.25))
        .when(confidence == "high", out("accepted_high_confidence", 0.85))
        .when((confidence == "medium") & mixed, out("accepted_mixed_evidence", 0.85))
        .when(confidence == "medium", out("accepted_medium_confidence", 0.50))
        .when(F.array_contains(flags, "possible_moved_implementation"), out("uncertain_cross_file", 0.08))
        .when(fuzzy, out("uncertain_fuzzy_only", 0.08))
        .otherwise(out("uncertain_metric_disagreement", 0.12))
    )
