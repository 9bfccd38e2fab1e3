"""MinHash near-dedup with odd sketches.

One pass makes, for each document, the digest of its set of word shingles, MinHash samples,
band keys of them and an odd sketch: a bitmap into which each sample is folded by flipping a
bit, so the population count of two bitmaps' XOR tells how many samples differ. Documents of
equal sets form a class by aggregation, and only the class's smallest id goes on.

Candidates share a band. Within a bucket each document meets a pivot, the member that shares
most buckets with others, instead of every other; a group of copies has mostly one pivot in
all its bands. Pairs whose odd sketches differ too much are dropped, the others are confirmed
on full sets and linked.

Documents of buckets whose members are not all connected by then are joined by the rarest of
their shingles: documents linked with each other share one of these, at places in the order
of rarity that leave enough shingles in common. Shingles that stand in one component alone
are left out, so pairs within a component are not made; sizes are part of the join key, so
documents with many edits of their own do not meet a large group of copies. No partner is
capped, and each pair of a bucket is connected, compared or ruled out by its counts.

Links are never gathered in the driver. Tasks of a bounded number of links find their
components by union-find; where that takes more than one task, label propagation with
pointer jumping over checkpointed tables joins what the tasks have found.

Defined cases: a null or blank text has an empty set and is linked with nothing; a text with
fewer words than a shingle has its whole word sequence as one; texts are read whole, however
long; ties don't arise, for a group's smallest id stands for it; an empty table gives no rows;
rows that repeat a doc_id, or have none, are a document each, told apart by their texts: rows of
one id and text get the same result each, and a group of null ids alone has a null component_id;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, checkpoint, shuffle_partitions, stored

SHINGLE, BANDS, ROWS, BITS = 5, 22, 5, 512

#: Links that one task takes.
TASK_LINKS = 500_000
#: Ratio of a size class's largest size to its smallest.
SIZE_STEP = 1.04
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DOWN = str.maketrans(UPPER, LOWER)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text."""
    words = _WORD.findall((text or "").translate(_DOWN))
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, np.uint64(len(h) if len(h) < k else k), np.uint64)
    for j in range(min(k, len(h))):
        out = _mixed(out * _MIX[0] + h[j : j + n])
    return np.unique(out)


def _coefficients(n: int) -> np.ndarray:
    return (_mixed(np.arange(1, n + 1, dtype=np.uint64) * _MIX[0]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minhash(s: np.ndarray, a: np.ndarray, step: int = 1024) -> np.ndarray:
    """Samples of a set, by 32-bit products, which numpy makes several at a time."""
    high, low = (s >> np.uint64(32)).astype(np.uint32), np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(s), step):
        np.minimum(low, (high[None, i : i + step] * a[:, None]).min(axis=1), out=low)
    return low.astype(np.uint64)


SIGNATURE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_hi", T.LongType()), T.StructField("set_lo", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])


def _signatures(k: int, bands: int, rows: int, bits: int):
    a = _coefficients(bands * rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.arange(bands * rows, dtype=np.uint64)
        for batch in batches:
            made = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(text, k)
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                if len(s):
                    m = minhash(s, a)
                    key = np.zeros(bands, np.uint64)
                    for r in range(rows):
                        key = _mixed(key * _MIX[0] + m[r::rows])
                    flips = np.bincount((_mixed(m + place * _MIX[0]) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
                    odd = np.packbits(flips.astype(np.uint8)).view(np.int64)
                    key = key.view(np.int64)
                else:
                    key = odd = np.empty(0, np.int64)
                made.append((doc_id, len(s), (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, key, odd))
            yield pd.DataFrame(made, columns=SIGNATURE.fieldNames())

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[str, np.ndarray] | None = None
        for batch in batches:
            links = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if last is None or last[0] != x:
                    last = (x, shingle_set(x, k))
                s, t = last[1], shingle_set(y, k)
                both = len(np.intersect1d(s, t, assume_unique=True))
                links.append((a, b, 100 * both >= percent * (len(s) + len(t) - both)))
            yield pd.DataFrame(links, columns=["a", "b", "linked"])

    return run


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            if (x := root(a)) != (y := root(b)):
                up[max(x, y)] = min(x, y)
    ids = list(up)
    yield pd.DataFrame({"id": np.array(ids, np.int64), "component": np.array([root(x) for x in ids], np.int64)})


def connected(links: DataFrame, n_links: int, at_once: int = TASK_LINKS) -> DataFrame:
    """(id, component): the smallest id reachable from each id in ``links`` (a, b)."""
    n_tasks = max(1, -(-n_links // at_once))
    if n_tasks == 1:
        return checkpoint(links.coalesce(1).mapInPandas(_forest, "id long, component long"))
    forest = links.repartition(n_tasks, F.xxhash64("a")).mapInPandas(_forest, "id long, component long").toDF("a", "b")
    met = checkpoint(forest.union(forest.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = met.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component"))
    while True:
        # a label that is itself labelled lower is followed twice before each look at the neighbours
        for _ in range(2):
            label = label.join(label.toDF("component", "upper"), "component").select("id", F.col("upper").alias("component"))
        label = checkpoint(label)
        near = met.join(label.toDF("b", "low"), "b").groupBy(F.col("a").alias("id")).agg(F.min("low").alias("low"))
        step = checkpoint(label.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "low").alias("component")))
        label = step.select("id", "component")
        if step.filter("was <> component").isEmpty():
            return label


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "component": batch["component"], "shingles": [shingle_set(t, k).view(np.int64) for t in batch["text"]]})

    return run


def _rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that may be linked, among ``sets`` (id, component, shingles).

    In the order of rarity, linked documents share a shingle that is at place i of one and j
    of the other so that what is left from there on is as large as the intersection must be.
    """
    n = F.size("shingles").cast("long")
    each = sets.select("id", "component", n.alias("n"), F.explode("shingles").alias("shingle"))
    spread = each.groupBy("shingle").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high"))
    spread = spread.select("shingle", "df", (F.col("low") != F.col("high")).alias("across"))
    at = F.row_number().over(Window.partitionBy("id").orderBy("df", "shingle")) - 1
    ranked = each.join(spread, "shingle").withColumn("rest", F.col("n") - at)
    prefix = ranked.filter(F.col("across") & (100 * F.col("rest") >= percent * F.col("n"))).select("shingle", "id", "component", "n", "rest")
    size_class = lambda c: F.floor(F.log(c) / F.log(F.lit(SIZE_STEP)) + 1e-9)
    # (100 + percent) * intersection >= percent * (n_a + n_b), and a is the smaller
    largest = F.least(F.col("n"), F.floor((100 + percent) * F.col("rest") / percent) - F.col("n"))
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    asks = prefix.filter(largest >= least).withColumn("size", F.explode(F.sequence(size_class(least), size_class(largest)))).toDF("shingle", "b", "cb", "n_b", "rest_b", "size")
    held = prefix.withColumn("size", size_class(F.col("n"))).toDF("shingle", "a", "ca", "n_a", "rest_a", "size")
    need = percent * (F.col("n_a") + F.col("n_b"))
    enough = ((100 + percent) * F.col("rest_a") >= need) & ((100 + percent) * F.col("rest_b") >= need) & (100 * F.col("n_a") >= percent * F.col("n_b"))
    first = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    return asks.join(held, ["shingle", "size"]).filter((F.col("ca") != F.col("cb")) & enough & first).select("a", "b").distinct()


def _xor_bits(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _most_bits(percent: int, n: int, bits: int) -> int:
    """XOR bits that a pair at the threshold does not exceed but once in about 1e9."""
    differ = n * (1 - percent / 100)
    differ += 5 * (differ * percent / 100) ** 0.5
    flips = 2 * differ
    return int(bits * (1 - np.exp(-2 * flips / bits)) / 2 + 5 * (bits / 4) ** 0.5 * (1 - np.exp(-2 * flips / bits)) ** 0.5)


def _linked(own: DataFrame, percent: int, k: int, bands: int, rows: int, bits: int, at_once: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of texts whose ids tell them apart."""
    signed = own.mapInPandas(_signatures(k, bands, rows, bits), SIGNATURE)
    signed = stored(signed)
    one = signed.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "set_hi", "set_lo")).alias("s")).select("doc_id", "s.*")
    # a class's members meet its smallest id by parts, so no class lands in one task; each part has one row, and at most as many as partitions
    one = one.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(shuffle_partitions(own.sparkSession))))
    parts = one.filter("n_shingles > 0").groupBy("set_hi", "set_lo", "part").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    classes = parts.groupBy("set_hi", "set_lo").agg(F.min("low").alias("rep"), F.sum("n").alias("n"), F.collect_list("part").alias("parts")).filter("n > 1").select("set_hi", "set_lo", F.explode("parts").alias("part"), "rep")
    members = checkpoint(one.join(classes, ["set_hi", "set_lo", "part"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
    reps = signed.join(members.filter("doc_id = rep AND n_shingles > 0").select("doc_id", F.col("n_shingles").alias("_n")), "doc_id").filter("n_shingles = _n").dropDuplicates(["doc_id"])
    banded = reps.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    sizes = banded.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = checkpoint(banded.join(sizes, ["band", "key"]).select(F.xxhash64("band", "key").alias("bucket"), "id", "n"))
    sketches = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch")
    most = _most_bits(percent, bands * rows, bits)

    def likely(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(sketches.toDF("a", "n_a", "s_a"), "a").join(sketches.toDF("b", "n_b", "s_b"), "b")
        return checkpoint(sized.filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (_xor_bits("s_a", "s_b") <= most)).select("a", "b"))

    shared = buckets.groupBy("id").agg(F.sum("n").alias("shared"))
    pivots = buckets.join(shared, "id").groupBy("bucket").agg(F.min_by("id", F.struct(-F.col("shared"), "id")).alias("pivot"))
    pairs = buckets.join(pivots, "bucket").filter("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    texts = own
    with_text = likely(pairs).join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    found = checkpoint(with_text.mapInPandas(_confirm(k, percent), "a long, b long, linked boolean").filter("linked").select("a", "b"))
    n_found = found.count()
    label = connected(found, n_found, at_once)
    placed = buckets.select("bucket", "id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    open_ = checkpoint(placed.join(apart, "bucket").select("id", "component").distinct())
    if not open_.isEmpty():
        sets = stored(open_.join(texts.toDF("id", "text"), "id").dropDuplicates(["id"]).mapInPandas(_sets(k), "id long, component long, shingles array<long>"))
        of = sets.select("id", "shingles")
        met = likely(_rare_pairs(sets, percent)).join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b")
        both = F.size(F.array_intersect("x", "y"))
        more = checkpoint(met.filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"))
        if n_more := more.count():
            # the components found before are a link for each document
            label = connected(label.toDF("a", "b").unionByName(more), label.count() + n_more, at_once)
    found = members.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _keyed(docs: DataFrame) -> DataFrame | None:
    """``docs`` with a ``key`` that tells texts apart, or None if doc_id does."""
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id IS NULL OR n > 1").select(F.col("doc_id").alias("_shared"), F.lit(True).alias("_is_shared"))
    if shared.isEmpty():
        return None
    text_key = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).bitwiseOR(F.lit(1 << 62))
    return docs.join(shared, F.col("doc_id").eqNullSafe(F.col("_shared")), "left").withColumn("key", F.when(F.col("_is_shared"), text_key).otherwise(F.col("doc_id").cast("long"))).drop("_shared", "_is_shared")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bits: int = BITS, at_once: int = TASK_LINKS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each document.

    Documents with ``100 * intersection >= percent * union`` of their shingle sets are
    linked; ``component_id`` is the smallest id reachable.
    """
    how = (percent, k, bands, rows, bits, at_once)
    own = docs.select(F.col("doc_id").cast("long"), "text")
    if (keyed := _keyed(own)) is None:
        return _linked(own, *how)
    found = _linked(keyed.select(F.col("key").alias("doc_id"), "text").dropDuplicates(["doc_id"]), *how)
    each = stored(keyed.select("doc_id", "key").join(found.select(F.col("doc_id").alias("key"), "n_shingles", F.col("component_id").alias("component")), "key"))
    low = each.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return each.join(low, "component").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their group: one row of each."""
    how = (percent, SHINGLE, BANDS, ROWS, BITS, TASK_LINKS)
    if (keyed := _keyed(docs.select("doc_id", "text"))) is None:
        gone = _linked(docs.select(F.col("doc_id").cast("long"), "text"), *how).filter("NOT kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    gone = _linked(keyed.select(F.col("key").alias("doc_id"), "text").dropDuplicates(["doc_id"]), *how).filter("NOT kept").select(F.col("doc_id").alias("key"))
    packed = _keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    return packed.join(gone, "key", "left_anti").dropDuplicates(["key"]).select("row.*")
