"""Harmonic packing of token sequences.

The classes of the harmonic method hold lengths up to ``capacity / j``, and a bin of class j
takes j pieces. Documents may be cut, so each is cut greedily into pieces of exactly the
classes' largest lengths (4096, 2048, 1365, 1024, ...; below 64 tokens every length is a
class): the part that remains shrinks with its square, four pieces do for most documents,
and a full bin of class j lacks less than j tokens.

A piece's bin follows from its number in its class. Numbers are dealt in two steps that run
independently on all workers: within (class, bucket), and by the sums of the buckets before.
Pieces beyond a class's last full bin are fewer than j, so about twenty thousand in all at
any size of the corpus; these alone are packed by best fit in one task.

Defined cases: a null text is an empty text, which is its end token alone; rows that repeat
a doc_id are packed each; null doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

CAPACITY, END, CACHED = 4096, 2, 125_000


def class_lengths(capacity: int) -> list[int]:
    """The pieces' lengths, longest first."""
    root = max(1, int(capacity**0.5))
    return sorted({capacity // j for j in range(1, root + 1)} | set(range(1, capacity // root + 1)), reverse=True)


def cuts(n: int, lengths: list[int]) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    out, start = [(i * lengths[0], lengths[0]) for i in range(n // lengths[0])], n // lengths[0] * lengths[0]
    for size in lengths:
        while n - start >= size:
            out.append((start, size))
            start += size
    return out


class Recent:
    """Remembers at least the last ``limit`` entries, and at most twice as many: what is found in ``before`` is put in ``now`` again."""

    def __init__(self, limit: int):
        self.limit, self.now, self.before = limit, {}, {}

    def trim(self) -> None:
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now


class CachedTokenizer:
    """Token ids as little-endian 32-bit bytes; each word is encoded once as long as it is remembered.

    A tokenizer that turns white space into single spaces, lower-cases and splits by a pattern
    that no white space matches gives a text the ids of its chunks between spaces in order, and a
    chunk those of its words. Such chunks and words are looked up: chunks as they stand, words
    lower-cased; a word of plain letters is remembered as a chunk. Chunks with white space of other kinds, special tokens or characters beyond
    Latin letters are encoded by the tokenizer as a whole, and so are all texts where it is of
    another form. What is remembered takes about 200 bytes for each of at most five times
    ``cached`` entries.
    """

    def __init__(self, path: str | None, name: str = "word_bpe_49k.json", cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        self.inner, self.chunks, self.words = Tokenizer.from_file(path), Recent(2 * cached), Recent(cached // 2)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        splits = (form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        self.by_chunk = (
            [n.get("type") for n in (form.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [(s.get("type"), s.get("behavior"), s.get("invert")) for s in splits] == [("Split", "Removed", True), ("ByteLevel", None, None)]
            and not splits[1].get("use_regex")
            and not splits[1].get("add_prefix_space")
        )
        if self.by_chunk:
            self.split = regex.compile(splits[0]["pattern"]["Regex"]).findall
            special = [regex.escape(t["content"]) for t in form["added_tokens"]]
            #: chunks that the tokenizer takes as a whole; to NFC, letters up to here are the same
            self.odd = regex.compile("|".join([r"\s", r"[\x1c-\x1f]", r"[^\x00-\u024f]", *special])).search
            self.letters = _byte_letters()

    def _whole(self, text: str) -> bytes:
        ids = self.inner.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.inner.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        # a word of plain letters is a chunk with the same ids
        of = self.chunks if word.isalpha() and word.isascii() else self.words
        if (value := of.now.get(word)) is None:
            if (value := of.before.get(word)) is None:
                value = self._ids(word)
            of.now[word] = value
        return value

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and max(chunk) < "\u0130":
            word = chunk.lower()
            return self._ids(word) if word == chunk else self._word(word)
        return self._whole(chunk) if self.odd(chunk) else b"".join([self._word(w) for w in self.split(chunk.lower())])

    def __call__(self, text: str) -> bytes:
        if not self.by_chunk:
            return self._whole(text)
        now, before = self.chunks.now, self.chunks.before
        chunks = text.replace("\n", " ").split(" ")
        parts = list(map(now.get, chunks))
        if None in parts:
            for i, value in enumerate(parts):
                if value is None:
                    chunk = chunks[i]
                    if (value := now.get(chunk)) is None:
                        if (value := before.get(chunk)) is None:
                            value = self._chunk(chunk)
                        now[chunk] = value
                    parts[i] = value
            self.chunks.trim()
            self.words.trim()
        return b"".join(parts)


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones are themselves, others follow from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in own)}


#: One tokenizer for each path in a worker: reused workers keep what they have learned.
_TOKENIZERS: dict[str | None, CachedTokenizer] = {}


def tokenizer(path: str | None) -> CachedTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def _pieces(capacity: int, end: int, path: str | None, with_ids: bool):
    lengths = class_lengths(capacity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = encode(text or "") + tail
                n = len(raw) // 4
                for start, length in cuts(n, lengths):
                    part = raw[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(part), n, np.frombuffer(part, "<i4") if with_ids else None))
            made = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            yield made if with_ids else made.drop(columns="ids")

    return run


def _best_fit(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # fewer pieces than the capacity times its logarithm
        if not parts:
            return
        rest = pd.concat(parts, ignore_index=True).sort_values(["length", "rank"], ascending=[False, True], kind="stable")
        room, where, at = np.empty(0, np.int64), [], []
        for n in rest["length"]:
            fits = np.where(room >= n, room, capacity + 1)
            if not len(room) or fits[b := int(fits.argmin())] > capacity:
                room, b = np.append(room, capacity), len(room)
            where.append(b)
            at.append(capacity - int(room[b]))
            room[b] -= n
        yield pd.DataFrame({"length": rest["length"], "rank": rest["rank"], "last_bin": where, "last_offset": at})

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset), a row for each piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = stored(docs.select("doc_id", "text").mapInPandas(_pieces(capacity, end, tokenizer_path, with_ids), schema))
    buckets = shuffle_partitions(docs.sparkSession)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counted = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("length").orderBy("bucket")
    before = counted.select("length", "bucket", (F.sum("n").over(by_class) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("length")).alias("total"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    numbered = dealt.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own"))
    j = F.floor(F.lit(capacity) / F.col("length"))
    numbered = numbered.withColumn("j", j).withColumn("full", F.col("rank") < F.floor(F.col("total") / F.col("j")) * F.col("j"))
    rest = numbered.filter(~F.col("full")).select("length", "rank").coalesce(1).mapInPandas(_best_fit(capacity), "length long, rank long, last_bin long, last_offset long")
    # a sequence's number holds its class and its place there; the last sequences have class 0
    sequence = F.when(F.col("full"), F.col("length") * F.lit(1 << 44) + F.floor(F.col("rank") / F.col("j"))).otherwise(F.col("last_bin"))
    offset = F.when(F.col("full"), F.pmod(F.col("rank"), F.col("j")) * F.col("length")).otherwise(F.col("last_offset"))
    return numbered.join(rest, ["length", "rank"], "left").select(*pieces.columns, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
