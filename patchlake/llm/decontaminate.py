"""Benchmark decontamination by template canonicalisation.

Names, numbers and units become typed placeholders, so a question asked again with other
values keeps its template. Rolling windows of template words are hashed and joined with
those of the benchmark items; only windows whose words agree count. For the windows that
match, each value of the item must stand for one value of the text throughout; the share
of slots for which it does is the slot consistency. A text that takes up ``min_coverage``
of an item's windows with consistent slots is a leak of the item, and is called
re-parameterised if a slot has another value than the item's. This is asked of the text as a
whole and of each place where the item stands in it (windows at about one distance from the
item's); the text is a leak if any passes, and the whole is reported before the best place.

The benchmark's windows are broadcast only if their bytes are counted to be within a bound;
else both sides are shuffled by the hash, and adaptive execution splits hot passages.

Defined cases: null texts are empty and match nothing; an item of fewer than ``k`` words is found
as a whole text alone, not within longer ones; texts are read whole, however long; of places
that are equally good the first is reported; empty tables give no rows; rows that repeat
(doc_id, text) or (item_id, text) count once; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, gram_words, lower_for_ascii_match, rolling_grams

NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
UNITS = "km|kg|cm|mm|mg|ml|lb|oz|ft|mph|kmh|hours?|minutes?|seconds?|days?|weeks?|months?|years?|metres?|meters?|miles?|grams?|litres?|liters?|dollars?|euros?|percent"
K = 5


def _spaced(text: Column) -> Column:
    """Without punctuation; a token never becomes two."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"[^\\p{{L}}\\p{{N}}\\s{NAME}-{UNIT}]", ""), r"\s+", " "))


def template_words(text: Column) -> Column:
    """Template words of a text, lower-cased, with placeholders for names, numbers and units."""
    named = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N},;] )\p{Lu}[\p{L}'-]*", NAME)
    has_digit = F.rlike(text, F.lit("[0-9]"))
    numbered = F.when(has_digit, F.regexp_replace(F.regexp_replace(named, r"[$€£]?[0-9][0-9.,]*", NUMBER), f"(?<={NUMBER} ?)(?i:{UNITS})(?![\\p{{L}}\\p{{N}}])", UNIT)).otherwise(named)
    return F.split(lower_for_ascii_match(_spaced(numbered)), " ")


def raw_words(text: Column) -> Column:
    """The words themselves, one for each template word."""
    return F.split(_spaced(text), " ")


def _windows(df: DataFrame, ident: str, k: int) -> DataFrame:
    read = df.select(F.col(ident).alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    words = read.select("id", F.xxhash64("t").alias("text_hash"), "t", template_words(F.col("t")).alias("w"))
    rolled = words.select("id", "text_hash", "t", F.size("w").alias("n"), F.posexplode(rolling_grams("w", k)).alias("pos", "x"))
    gram = gram_words("x", k)
    # a text of fewer words than a window has one window, which is all of it
    whole = (F.col("pos") == 0) & (F.col("n") < k) & (gram[0] != "")
    return rolled.filter(gram[-1].isNotNull() | whole).select("id", "text_hash", "t", "pos", F.xxhash64(*gram).alias("gram_hash"), F.array(*gram).alias("gram"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = K, min_coverage: float = 0.5, min_consistency: float = 0.8, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, n_matched, coverage, consistency, reparameterised): the leaks only."""
    has_slot = F.exists("gram", lambda g: g.rlike(f"[{NAME}-{UNIT}]"))
    values = lambda gram, text, pos: F.when(F.exists(gram, lambda g: g.rlike(f"[{NAME}-{UNIT}]")), F.slice(raw_words(text), pos + 1, k))
    items = _windows(benchmark, "item_id", k).dropDuplicates(["id", "text_hash", "pos"])
    items = items.select(F.col("id").alias("item_id"), F.col("text_hash").alias("item_hash"), F.col("pos").alias("item_pos"), "gram_hash", F.col("gram").alias("item_gram"), values("gram", F.col("t"), F.col("pos")).alias("item_values"))
    # a row takes its characters, up to three bytes each, and some 300 bytes of numbers and offsets
    size = items.agg(F.sum(300 + 3 * F.length(F.concat_ws("", "item_gram", "item_values")))).first()[0] or 0
    small = size <= broadcast_bytes
    windows = _windows(docs, "doc_id", k)
    if not small:  # else the values are taken of the windows that match alone
        windows = windows.withColumn("doc_values", values("gram", F.col("t"), F.col("pos"))).drop("t")
    hits = windows.join(F.broadcast(items) if small else items, "gram_hash").filter((F.col("gram") <= F.col("item_gram")) & (F.col("gram") >= F.col("item_gram")))
    if small:
        hits = hits.withColumn("doc_values", values("gram", F.col("t"), F.col("pos")))
    slots = F.when(
        has_slot,
        F.array_distinct(F.filter(F.transform(F.arrays_zip(F.col("gram").alias("g"), F.col("item_values").alias("i"), F.col("doc_values").alias("d")), lambda z: F.when(z["g"].rlike(f"[{NAME}-{UNIT}]"), F.struct(z["i"].alias("i"), z["d"].alias("d")))), lambda z: z.isNotNull())),
    ).otherwise(F.array().cast("array<struct<i:string,d:string>>"))
    pair = ["id", "text_hash", "item_id", "item_hash"]
    diagonal = (F.col("pos") - F.col("item_pos")).alias("diagonal")
    matched = hits.select(*pair, "item_pos", diagonal, slots.alias("slots")).groupBy(*pair, "diagonal").agg(F.collect_set("item_pos").alias("at"), F.collect_set("slots").alias("slots"))
    # copies of an item lie ``k`` words apart at least, so diagonals nearer than that are one place
    by_diagonal = Window.partitionBy(*pair).orderBy("diagonal")
    starts = matched.withColumn("starts", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_diagonal) >= k).cast("int"), F.lit(0)))
    placed = starts.withColumn("place", F.sum("starts").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("place", F.explode(F.array(F.lit(-1).cast("long"), "place")))  # -1: the document as a whole
    of_pair = placed.groupBy(*pair, "place").agg(F.size(F.array_distinct(F.flatten(F.collect_set("at")))).cast("long").alias("n_matched"), F.array_distinct(F.flatten(F.flatten(F.collect_set("slots")))).alias("slots"))
    sizes = items.groupBy("item_id", "item_hash").agg(F.count("*").alias("n_windows"))
    sized = of_pair.alias("p").join((F.broadcast(sizes) if small else sizes).alias("s"), F.col("p.item_id").eqNullSafe(F.col("s.item_id")) & (F.col("p.item_hash") == F.col("s.item_hash")))
    n_values = F.size(F.array_distinct(F.transform("slots", lambda s: s["i"])))
    coverage = F.col("n_matched") / F.col("n_windows")
    n_same = F.size(F.filter("slots", lambda s: s["i"] == s["d"]))  # an exact copy beside others is a leak still
    consistency = F.when(F.size("slots") == 0, 1.0).otherwise(F.greatest(n_values / F.greatest(F.size("slots"), F.lit(1)), n_same / F.greatest(n_values, F.lit(1))))
    found = sized.select(
        F.col("id").alias("doc_id"), "text_hash", "p.item_id", "p.item_hash", "place", "n_windows", "n_matched", coverage.alias("coverage"), consistency.alias("consistency"),
        F.exists("slots", lambda s: s["i"] != s["d"]).alias("reparameterised"),
    ).filter((F.col("coverage") >= min_coverage) & (F.col("consistency") >= min_consistency))
    told = ["n_windows", "n_matched", "coverage", "consistency", "reparameterised"]
    best = F.max_by(F.struct(*told), F.struct(F.col("place") < 0, "coverage", "consistency", -F.col("place")))
    return found.groupBy("doc_id", "text_hash", "item_id", "item_hash").agg(best.alias("best")).select("doc_id", "text_hash", "item_id", *[f"best.{c}" for c in told])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, that leak no item."""
    leaks = find_leaks(docs, benchmark, **how).select(F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_hash")).distinct()
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["_leak_id"]) & (text_hash == leaks["_leak_hash"]), "left_anti")
