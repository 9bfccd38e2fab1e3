"""Secret scan with multipart credential linking.

Six kinds of parts are found in every text by one pass of regular expressions:

* ``assign``, ``access``, ``hex`` are strong and always reported;
* ``id`` (account names and client ids), ``key`` (long random-looking strings) and
  ``endpoint`` (service addresses) are weak. A weak key is reported only if an identifier
  (``access``, ``id``) or an endpoint lies in its scope, a weak id only if a secret
  (``assign``, ``hex``, ``key``) does. Endpoints link parts and are not reported.

A scope is ``scope`` code points to either side. The interval join is a sorted sweep over the
edges of a text's parts, once in each direction: at its start a part knows the greatest end of
the complementary classes so far, at its end the least start of those behind it. Frames only
grow, so a text with thousands of parts makes no pairs. Parts that overlap are one piece of
text, not two that occur together, and don't link: a long path within an address is no key.

Defined cases: a null text is an empty text, an empty table gives no rows; texts are scanned
whole, however long; of parts at one place each kind counts by itself, and of parts equally near
any links; rows that repeat a (doc_id, text) pair get the same result each; null doc_ids are
matched null-safely; other columns are ignored. Positions are code points, ends exclusive, and
span whole matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ID = "(" + "|".join(map(_any_case, ("client_id", "access_key_id", "account_id", "username", "login"))) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@-]+)"

#: kind, pattern, shortest reported length (of group 2 for assign and id, else of the match), text that every match contains
KINDS = (
    ("assign", ASSIGN, 6, None),
    ("access", "AKIA[A-Z0-9]+", 20, "AKIA"),
    ("hex", "[0-9a-f]{24,}", 24, None),
    ("id", ID, 3, None),
    ("key", "[A-Za-z0-9+/]{32,}={0,2}", 32, None),
    ("endpoint", "[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~:@/?&=%-]+", 8, "://"),
)
BASE = ("assign", "access", "hex")


def _parts(text: Column, n: int, kind: str, pattern: str, least: int, holds: str | None) -> Column:
    """The matches of one kind as structs; each has the length of the text between it and the one before."""
    regex, of_group = F.lit(pattern), kind in ("assign", "id")
    found = F.regexp_extract_all(text, regex, F.lit(0))
    there = (F.contains(text, F.lit(holds)) if holds else F.lit(True)) & F.rlike(text, regex)
    value = F.regexp_extract_all(text, regex, F.lit(2)) if of_group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    shape = F.struct(F.lit(n).alias("kind"), F.lit(0).alias("at"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(True).alias("ok"))
    zipped = F.arrays_zip(F.transform(found, F.length).alias("size"), F.transform(value, F.length).alias("value"), F.transform(value, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")).alias("mixed"), gaps.alias("gap"))
    made = F.transform(
        F.slice(zipped, 1, F.size(found)),
        lambda x, i: F.struct(F.lit(n).alias("kind"), i.alias("at"), x["gap"].alias("gap"), x["size"].alias("size"), ((x["value"] >= least) & (x["mixed"] if kind == "key" else F.lit(True))).alias("ok")),
    )
    return F.when(there, made).otherwise(F.slice(F.array(shape), 1, 0))


def credential_parts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kind, start, end): every part of every kind, weak ones too."""
    text = F.col("t")
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    each = read.select("doc_id", F.xxhash64("t").alias("text_hash"), F.explode(F.concat(*[_parts(text, n, *k) for n, k in enumerate(KINDS)])).alias("p"))
    rows = each.select("doc_id", "text_hash", "p.kind", "p.at", "p.gap", "p.size", "p.ok").dropDuplicates(["doc_id", "text_hash", "kind", "at"])
    so_far = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    return placed.filter("ok").select("doc_id", "text_hash", "kind", "start", "end")


def secret_spans(docs: DataFrame, scope: int = 400) -> DataFrame:
    """(doc_id, text_hash, kind, start, end) of all strong parts and of the weak ones that are linked."""
    number = {k[0]: n for n, k in enumerate(KINDS)}
    part = ["doc_id", "text_hash", "kind", "start", "end"]
    edges = credential_parts(docs).select(*part, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("opens")), F.struct(F.col("end").alias("at"), F.lit(0).alias("opens")))).alias("edge"))
    edges = edges.select(*part, "edge.at", "edge.opens")
    text = Window.partitionBy("doc_id", "text_hash")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    up, down = text.orderBy("at", "opens").rowsBetween(*so_far), text.orderBy(F.desc("at"), F.desc("opens")).rowsBetween(*so_far)
    opens = F.col("opens") == 1

    def near(*kinds: str) -> Column:
        of = F.col("kind").isin([number[k] for k in kinds])
        left, right = F.max(F.when(of & ~opens, F.col("at"))).over(up), F.min(F.when(of & opens, F.col("at"))).over(down)
        return F.coalesce(F.when(opens, F.col("at") - left <= scope).otherwise(right - F.col("at") <= scope), F.lit(False))

    swept = edges.withColumn("to_id", near("access", "id", "endpoint")).withColumn("to_secret", near("assign", "hex", "key"))
    linked = swept.groupBy(*part).agg(F.bool_or("to_id").alias("to_id"), F.bool_or("to_secret").alias("to_secret"))
    strong = F.col("kind").isin([number[k] for k in BASE])
    weak = ((F.col("kind") == number["key"]) & F.col("to_id")) | ((F.col("kind") == number["id"]) & F.col("to_secret"))
    return linked.filter(strong | weak).select(*part)


def scan_secrets(docs: DataFrame, scope: int = 400) -> DataFrame:
    """One row for each document: counts of the base kinds, digest of base spans, all spans."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])

    def joined(base: bool) -> Column:
        some = F.col("all") if not base else F.filter("all", lambda s: s["kind"] < len(BASE))
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    n = {k: F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(BASE)}
    of_doc = secret_spans(docs, scope).groupBy("doc_id", "text_hash").agg(*n.values(), F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    of_doc = of_doc.select("doc_id", "text_hash", *[f"n_{k}" for k in BASE], F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans"))
    all_docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).alias("d")
    out = all_docs.join(of_doc.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash")), "left")
    return out.select(
        "d.doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
