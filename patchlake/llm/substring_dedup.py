"""Exact substring dedup by prefix doubling over ranks in a sampled suffix array.

A byte is removed if a string of ``size`` bytes covers it that also starts earlier (smaller
doc_id, or earlier in the same document). Sorting all byte positions in each round would
move many times the input, so positions enter the rounds as late as they can and leave them
as soon as their rank is unique:

1. offset 0: of all strings of ``size`` bytes, each picks the ``seed``-byte piece of least hash
   within it, so equal strings pick equal pieces at equal places. Every picked place has a rank
   that takes in about half of ``size``: the bytes up to the piece for the strings that hold
   it in their second half, those from it on for the others. Places are sorted by rank, about
   one for thirty bytes; unique ones leave.
2. the rank is paired with that of all bytes that the strings around the piece may reach, to
   either side. Places whose pair agrees with an earlier one are repeats as a whole; where
   all of a piece's places agree, the first leaves.
3. the strings that are left start between pieces that agree and surroundings that don't.
   They are split into blocks of neighbouring starts at fixed distances from the piece;
   blocks are ranked by what their strings have in common, nearly a whole string, and paired
   with all that they reach, as before.
4. the strings of the few blocks that are still open are sorted by the pair (rank of the
   first half, rank of the half at offset size/2). All but the first of equal pairs are repeats.

Ranks are 64-bit fingerprints rather than dense numbers, so the rank at an offset comes from
the text itself and needs no join; round 4 compares 128 bits. Each round reads the texts by
the same exchange.

Defined cases: null texts are empty; texts shorter than ``size`` bytes keep all; null doc_ids
sort before others; rows that repeat a doc_id count as one document each, in order of 15 bits
of their text's hash, and those that agree there too as the same document (no repeats of each
other); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SIZE, SEED, CHUNK, BLOCK = 100, 8, 1 << 20, 8
_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TABLE = np.frombuffer(np.random.RandomState(7).bytes(256 * 8), np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        m = max(n, 4096)
        with np.errstate(over="ignore"):
            for k, base in (("p", _P), ("i", _PI)):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["i"][:n]


class Prints:
    """Fingerprints of all pieces of a byte string, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, raw: np.ndarray):
        p, self.inverse = _powers(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * p, out=self.sums[1:])

    def rolling(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values, by running minima within blocks from both ends."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - w + 1], right[w - 1 : n])


def packed(tie, first, length, off):
    """A tie, a first start, a number of further starts and the piece's distance from the first, in one number that sorts by tie and start."""
    return (tie << 48) | (first << 14) | (length << 7) | off


def unpacked(spots: np.ndarray) -> tuple[np.ndarray, ...]:
    """tie, first, last and the piece's place."""
    first = (spots >> 14) & ((1 << 34) - 1)
    return spots >> 48, first, first + ((spots >> 7) & 127), first + (spots & 127)


def places(raw: bytes, size: int = SIZE, seed: int = SEED, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """(piece, around, first, last) of each picked place: its ranks and the strings that pick it, by start."""
    return (x[:4] for x in _placed(raw, size, seed, chunk))


def _placed(raw: bytes, size: int, seed: int, chunk: int) -> Iterator[tuple[np.ndarray, ...]]:
    """As ``places``, with the piece's own place."""
    data = np.frombuffer(raw, np.uint8)
    w = size - seed + 1
    for base in range(0, len(data) - size + 1, chunk):
        part = data[base : base + chunk + size - 1]
        prints = Prints(part)
        h = prints.rolling(seed)
        # the least hash, then the leftmost place: both in one number, for a chunk has less than 2**24 bytes
        v = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        at = (_sliding_min(v, w) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, len(at) - 1]
        place = at[first]
        half = (size - seed) // 2
        # strings that start by ``place - half`` hold that many bytes before the piece; the others hold as many after it
        parts = []
        left, right = first <= place - half, last > place - half
        for some, a, e, at_a, at_e in (
            (left, first, np.minimum(last, place - half), place - half, place + seed),
            (right, np.maximum(first, place - half + 1), last, place, place + size - half + 1),
        ):
            a, e, q = a[some], e[some], place[some]
            piece = prints.at(at_a[some], at_e[some]) + np.uint64(at_a is place)
            around = prints.at(a, e + size) + (q - a).astype(np.uint64) * _M1 + (e - a).astype(np.uint64) * _M2
            parts.append((piece, _mixed(around), base + a, base + e, base + q))
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _gathered(frames: Iterator[pd.DataFrame], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for made in frames:
        held.append(made)
        n += len(made)
        if n > rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _picked(size: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, tie, text in zip(batch["doc_id"], batch["tie"], batch["text"], strict=True):
                for piece, around, first, last, place in _placed(_bytes(text), size, seed, CHUNK):
                    yield pd.DataFrame({"piece": piece.view(np.int64), "around": around.view(np.int64), "doc_id": doc_id, "spot": packed(int(tie), first, last - first, place - first)})

    return lambda batches: _gathered(run(batches))


def _blocks(size: int, chunk: int = CHUNK):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text, spots in zip(batch["doc_id"], batch["text"], batch["spots"], strict=True):
                if spots is None:
                    continue
                tie, first, last, place = unpacked(np.unique(np.asarray(spots, np.int64)))
                low, high = (place - last) // BLOCK, (place - first) // BLOCK
                of = np.repeat(np.arange(len(first)), high - low + 1)
                k = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
                place, core = place[of], place[of] - BLOCK * k
                a, e = np.maximum(first[of], core - BLOCK + 1), np.minimum(last[of], core)
                data = np.frombuffer(_bytes(text), np.uint8)
                for base in np.unique(a // chunk) * chunk:
                    some = (a >= base) & (a < base + chunk)
                    prints = Prints(data[base : base + chunk + size + BLOCK])
                    x, y, c, q = a[some] - base, e[some] - base, core[some] - base, place[some] - base
                    piece = _mixed(prints.at(c, c + size - BLOCK + 1) + (q - c).astype(np.uint64) * _M1)
                    around = _mixed(prints.at(x, y + size) + (q - x).astype(np.uint64) * _M1 + (y - x).astype(np.uint64) * _M2)
                    yield pd.DataFrame({"piece": piece.view(np.int64), "around": around.view(np.int64), "doc_id": doc_id, "spot": packed(int(tie[0]), a[some], (e - a)[some], 0)})

    return lambda batches: _gathered(run(batches))


def _starts(size: int, chunk: int = CHUNK):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text, spots in zip(batch["doc_id"], batch["text"], batch["spots"], strict=True):
                if spots is None:
                    continue
                tie, first, last, _ = unpacked(np.asarray(spots, np.int64))
                data, n = np.frombuffer(_bytes(text), np.uint8), last - first + 1
                want = np.unique(np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()))
                half = size // 2
                for base in np.unique(want // chunk) * chunk:
                    some = want[(want >= base) & (want < base + chunk)] - base
                    prints = Prints(data[base : base + chunk + size - 1])
                    yield pd.DataFrame({"low": prints.at(some, some + half).view(np.int64), "high": prints.at(some + half, some + size).view(np.int64), "doc_id": doc_id, "spot": packed(int(tie[0]), some + base, 0, 0)})

    return lambda batches: _gathered(run(batches))


def covered(first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of bytes covered by the strings that start in first..last."""
    order = np.argsort(first, kind="stable")
    a, e = first[order], np.maximum.accumulate(last[order] + size)
    new = np.r_[True, a[1:] > e[:-1]]
    at = np.flatnonzero(new)
    return a[at], e[np.r_[at[1:] - 1, len(a) - 1]]


def _cut(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, spots in zip(batch["doc_id"], batch["text"], batch["spots"], strict=True):
                raw = _bytes(text)
                kept, n_spans, spans = raw, 0, []
                if spots is not None and len(spots):
                    _, first, last, _ = unpacked(np.asarray(spots, np.int64))
                    start, end = covered(first, last, size)
                    edges = np.r_[0, np.column_stack((start, end)).ravel(), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in edges.reshape(-1, 2))
                    n_spans, spans = len(start), np.column_stack((start, end)).tolist()
                rows.append((doc_id, len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), spans))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def _own(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(32768)).cast("int").alias("tie"), "text")


def _with_spots(own: DataFrame, spots: DataFrame, all_texts: bool = False) -> DataFrame:
    """(doc_id, text, spots) of all documents, the texts of those without spots only if asked for.

    A left join whatever is asked for, so every round's plan reads the same exchange of texts.
    """
    of_doc = spots.groupBy(F.col("doc_id").alias("_id"), F.shiftright("spot", 48).cast("int").alias("_tie")).agg(F.collect_list("spot").alias("spots"))
    met = own.join(of_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    return met.select("doc_id", F.col("text") if all_texts else F.when(F.col("spots").isNotNull(), F.col("text")).alias("text"), "spots")


def _ranked(rows: DataFrame) -> DataFrame:
    """(doc_id, spot, repeat) of the rows (piece, around, doc_id, spot) whose piece stands elsewhere too.

    ``repeat``: an earlier row agrees in piece and surroundings. Of pieces that are alike all
    around, the first is left out.
    """
    by_piece = Window.partitionBy("piece").orderBy("around", "doc_id", "spot")
    of_piece = by_piece.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_pair = Window.partitionBy("piece", "around").orderBy("doc_id", "spot")
    # dealt out here, so plans that need the repeats alone read the same exchange
    alike = rows.repartition("piece").select("*", F.first("around").over(of_piece).alias("low"), F.last("around").over(of_piece).alias("high"))
    # rows that repeat a document agree in both, and so in their rank
    return alike.withColumn("nth", F.dense_rank().over(by_pair)).filter("low <> high OR nth > 1").select("doc_id", "spot", (F.col("nth") > 1).alias("repeat"))


def repeated_ranges(docs: DataFrame, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """(doc_id, spot): packed starts of strings that also start earlier."""
    own = _own(docs)
    made = f"piece long, around long, doc_id {own.schema['doc_id'].dataType.simpleString()}, spot long"
    by_place = stored(_ranked(own.mapInPandas(_picked(size, seed), made)))
    by_block = _ranked(_with_spots(own, by_place.filter("NOT repeat")).mapInPandas(_blocks(size), made))
    starts = _with_spots(own, by_block.filter("NOT repeat")).mapInPandas(_starts(size), made.replace("piece", "low").replace("around", "high"))
    nth = F.dense_rank().over(Window.partitionBy("low", "high").orderBy("doc_id", "spot"))
    again = starts.withColumn("nth", nth).filter("nth > 1")
    return by_place.filter("repeat").select("doc_id", "spot").unionByName(by_block.filter("repeat").select("doc_id", "spot")).unionByName(again.select("doc_id", "spot"))


def remove_repeats(docs: DataFrame, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), a row for each row of ``docs``."""
    own = _own(docs)
    met = _with_spots(own, repeated_ranges(docs, size, seed), all_texts=True)
    return met.mapInPandas(_cut(size), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
