"""Quality rules with a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into buckets and counted over the whole corpus, and over its
trusted documents, those labelled with quality 1. A bucket's weight for a document is taken from
the other rows alone: ``log p(trusted | bucket) - log p(trusted)``, where p(trusted | bucket) is
drawn to p(trusted) by ``prior`` occurrences, so buckets with little evidence weigh little
however large the corpus is. A document's score is the mean weight of its n-grams, so it grows
neither with its length nor with the corpus; documents below a fixed threshold, and those that
fail the base rules, are rejected.

Words and pairs have as many buckets each as ``BUCKETS`` times the cube root of the corpus's
characters, so the table grows with the corpus: 0.1 million in 1 GB, 7 million in 100 TB, where
the two counts of all buckets take 110 MB in each worker. That is what is broadcast at most.
Rare n-grams share a bucket, whose weight is then near that of the corpus, which is 0.

Defined cases: a null or blank text has no words and fails the base rules; without trusted
documents all scores are 0, as is that of a text whose n-grams no other row holds; a score equal
to the threshold is kept; an empty table gives no rows; texts are taken whole, however long;
rows that repeat a doc_id are judged each, and count each; null ids are never trusted; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_size

THRESHOLD, PRIOR, BUCKETS = -0.2, 10.0, 128
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _grams(h: np.ndarray) -> np.ndarray:
    pairs = (h[:-1] * _P + h[1:]) * _M
    return np.concatenate((h, pairs ^ (pairs >> np.uint64(29)))).view(np.int64)


def base_counts(text: str, words: list[str], h: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    repeat = 0
    if len(h) > 3:
        windows = ((h[:-2] * _P + h[1:-1]) * _M + h[2:]) * _P
        _, group, n = np.unique(windows, return_inverse=True, return_counts=True)
        twice = n[group] > 1
        hit = np.zeros(len(h), bool)
        for j in range(3):
            hit[j : len(h) - 2 + j] |= twice
        repeat = int(hit.sum())
    return sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeat


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each word, from 0 on, and of each pair of words, from ``n`` on."""
    at = (_grams(h).view(np.uint64) >> np.uint64(8)) % np.uint64(n)
    at[len(h) :] += np.uint64(n)
    return at.astype(np.int64)


def n_buckets(characters: int) -> int:
    return max(1024, int(BUCKETS * characters ** (1 / 3)))


def _count(n: int, at_once: int = 2_000_000):
    def summed(held: list[np.ndarray], good: list[np.ndarray]) -> pd.DataFrame:
        bucket, raw = np.unique(np.concatenate(held), return_counts=True)
        trusted = np.zeros(len(bucket), np.int64)
        if good:
            some, k = np.unique(np.concatenate(good), return_counts=True)
            trusted[np.searchsorted(bucket, some)] = k
        return pd.DataFrame({"bucket": bucket.astype(np.int32), "raw": raw, "trusted": trusted})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, good, size = [], [], 0
        for batch in batches:
            for text, trusted in zip(batch["text"], batch["trusted"], strict=True):
                if words := _WORD.findall(text or ""):
                    at = _buckets(_hashes(words), n)
                    held.append(at)
                    if trusted:
                        good.append(at)
                    size += len(at)
                    if size > at_once:
                        yield summed(held, good)
                        held, good, size = [], [], 0
        if held:
            yield summed(held, good)

    return run


def bucket_counts(marked: DataFrame, n: int) -> DataFrame:
    """(bucket, raw, trusted) of the n-grams of (text, trusted)."""
    rows = marked.select("text", "trusted").mapInPandas(_count(n), "bucket int, raw long, trusted long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def _judge(table, n: int, share: float, prior: float, threshold: float):
    def score(h: np.ndarray, trusted: bool) -> float:
        if not share or not len(h):
            return 0.0
        raw, good = table.value
        some, k = np.unique(_buckets(h, n), return_counts=True)
        w = np.log((good[some] - k * trusted + prior * share) / ((raw[some] - k + prior) * share))
        return float((w * k).sum() / k.sum())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, trusted, text in zip(batch["doc_id"], batch["trusted"], batch["text"], strict=True):
                text = text or ""
                words = _WORD.findall(text)
                h = _hashes(words)
                counts = base_counts(text, words, h)
                failed = len(words) < 50 or 100 * counts[3] > 50 * len(words)
                s = score(h, trusted)
                rows.append((doc_id, len(words), *counts, failed, s, not failed and s >= threshold))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    return run


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    marked = join_by_size(docs.select("doc_id", "text"), good, ["doc_id"], "left").select("doc_id", F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")
    n = n_buckets(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    counts = bucket_counts(marked, n).toPandas()
    raw, trusted = np.zeros(2 * n), np.zeros(2 * n)
    raw[counts["bucket"]], trusted[counts["bucket"]] = counts["raw"], counts["trusted"]
    share = float(trusted.sum() / max(raw.sum(), 1))
    table = docs.sparkSession.sparkContext.broadcast((raw.astype(np.float32), trusted.astype(np.float32)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return marked.mapInPandas(_judge(table, n, share, prior, threshold), out)
