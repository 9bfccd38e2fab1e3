"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. A HyperLogLog sketch of the sites is kept
for each line's hash and merged by aggregation, so a line that stands in a third of all
documents is summed up before the shuffle. Lines whose estimate is far from the threshold
are decided by it; those near the threshold get exact distinct counts. Boilerplate lines
are taken out of every document that has other lines left; one without them is a copy as a
whole, which is left to document dedup. With ``max_share`` documents stay whole too if
boilerplate makes up more than that share of their characters.

Defined cases: lines are split at ``\\n`` and compared without the spaces around them; blank
lines are never boilerplate; a null text has no lines and stays null; a null site is a
site of its own; null doc_ids are matched null-safely; a line on exactly ``min_sites`` sites is
boilerplate; an empty table gives no rows; texts are taken whole, however long; repeated rows
count like others and get the same result each; other columns are kept whatever their names,
but for n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_by_size


def _lines(docs: DataFrame, site: str) -> DataFrame:
    line = F.trim(F.col("line"))
    each = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("\x00")).alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    return each.filter(line != "").select("site", F.xxhash64(line).alias("line_hash"))


def boilerplate_lines(docs: DataFrame, site: str = "source", min_sites: int = 10, lg_k: int = 11, margin: float = 0.15) -> DataFrame:
    """(line_hash): lines on ``min_sites`` distinct sites or more.

    ``margin`` is the part of the threshold within which the exact count decides: over six
    standard errors of a sketch with 2**lg_k registers.
    """
    lines = _lines(docs, site)
    spread = lines.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    wide = spread.filter(F.col("sites") >= F.floor(F.lit(min_sites * (1 - margin)))).withColumn("sure", F.col("sites") > min_sites * (1 + margin))
    wide = checkpoint(wide.select("line_hash", "sure"))  # both branches below read it
    near = wide.filter(~F.col("sure")).select("line_hash")
    exact = join_by_size(lines, near, ["line_hash"], "inner").distinct().groupBy("line_hash").agg(F.count("*").alias("sites"))
    return wide.filter("sure").select("line_hash").unionByName(exact.filter(F.col("sites") >= min_sites).select("line_hash"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = 10, max_share: float | None = None, **how) -> DataFrame:
    """``docs`` with the boilerplate taken out of ``text``, and n_lines and n_removed (long)."""
    flagged = boilerplate_lines(docs, site, min_sites, **how)
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    placed = docs.select("doc_id", text_hash.alias("text_hash"), F.explode(F.transform(F.split("text", "\n"), lambda x: F.xxhash64(F.trim(x)))).alias("line_hash"))
    of_doc = join_by_size(placed, flagged, ["line_hash"], "inner").groupBy(F.col("doc_id").alias("id"), "text_hash").agg(F.collect_set("line_hash").alias("gone"))
    # the caller's columns travel as one, so no name of theirs meets one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_hash.alias("own_hash"))
    met = rows.join(of_doc, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")), "left").select("row", "gone", F.split("row.text", "\n").alias("lines"))
    stay: Column = F.filter("lines", lambda x: ~F.array_contains("gone", F.xxhash64(F.trim(x))))
    cut = met.withColumn("stay", F.when(F.col("gone").isNotNull(), stay)).withColumn("kept", F.array_join("stay", "\n"))
    enough = F.exists("stay", lambda x: F.trim(x) != "")
    if max_share is not None:
        enough &= F.length("kept") >= (1 - max_share) * F.length("row.text")
    take = F.coalesce(enough, F.lit(False))
    own = [F.when(take, F.col("kept")).otherwise(F.col("row.text")).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines"))
    return cut.select(*own, n_lines.cast("long").alias("n_lines"), F.when(take, F.size("lines") - F.size("stay")).otherwise(0).cast("long").alias("n_removed"))
