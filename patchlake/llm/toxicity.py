"""Toxicity by a counterfactual-regularised linear classifier.

A logistic regression over hashed words and word beginnings; a feature's value is the
logarithm of one more than the number of a text's distinct words that have it. In labelled texts
that name a group (``IDENTITY``), the group's name is swapped for the others', and the loss adds
the squared change of the score, so naming a group weighs nothing by itself and neutral
mentions aren't flagged.

It is fitted on at most ``max_train`` labelled rows (those of least hash of doc_id, each with all
its swaps); the features are the ``max_features`` that tell the labels of these rows apart best.
Only the features' counts, the rows' selected features and what each swap changes in them reach
the driver: at most max_train * max_features numbers, and for each swap those of two words.
Every document is scored, on its whole text, and alike however the rows are dealt out.

Defined cases: a null or blank text gets the score of a text without features; without labels of
both kinds all scores are 0; of labels that repeat a doc_id the greatest counts, and of texts that
do the greatest is fitted on, while each is scored; a score equal to the threshold is predicted 1;
an empty table gives no rows; null ids are never trained on; label, language, source and id are
no inputs, and other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRAIN, MAX_FEATURES, THRESHOLD = 12_000, 2_048, 0.7
_WORD = re.compile(r"\w+")

#: Names of groups, by kind; one is swapped for another of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "autistic"),
    ("femmes", "hommes"), ("mujeres", "hombres"), ("frauen", "männer"),
    ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"), ("muslime", "christen", "juden"),
)
_GROUP = {w: kind for kind in IDENTITY for w in kind}


def _features(word: str) -> list[int]:
    """Hashed features of a word: itself, and how it begins."""
    own = [f"w:{word}"] + [f"p{n}:{word[:n]}" for n in (3, 4, 5, 6, 7, 8) if len(word) > n]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in own]


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _all_features(words: set[str]) -> Counter[int]:
    return Counter(f for w in words for f in _features(w))


def _values(words: set[str], chosen: dict[int, int]) -> tuple[list[int], list[float]]:
    n = Counter(chosen[f] for w in words for f in _features(w) if f in chosen)
    return list(n), [math.log1p(k) for k in n.values()]


def _as_rows(n: Counter, toxic: int) -> pd.DataFrame:
    made = pd.DataFrame(list(n), columns=["feature", "level"]) if n else pd.DataFrame({"feature": np.empty(0, np.int64), "level": np.empty(0, np.int64)})
    return made.assign(n=np.array(list(n.values()), np.int64), toxic=toxic)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            n[int(toxic)].update((f, math.isqrt(k)) for f, k in _all_features(_words(text)).items())
            if len(n[0]) + len(n[1]) > 300_000:
                yield from map(_as_rows, n, (0, 1))
                n = Counter(), Counter()
    yield from map(_as_rows, n, (0, 1))


def _selected(chosen: dict[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, toxic in zip(batch["doc_id"], batch["text"], batch["toxic"], strict=True):
                words = _words(text)
                x, v = _values(words, chosen)
                before, swaps, changes = dict(zip(x, v, strict=True)), [], []
                for w in sorted(words & _GROUP.keys()):
                    for other in _GROUP[w]:
                        if other != w:
                            after = dict(zip(*_values(words - {w} | {other}, chosen), strict=True))
                            at = sorted(f for f in before.keys() | after.keys() if before.get(f) != after.get(f))
                            swaps.append(at)
                            changes.append([after.get(f, 0.0) - before.get(f, 0.0) for f in at])
                rows.append((doc_id, int(toxic), x, v, swaps, changes))
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "x", "v", "swaps", "changes"])

    return run


class Model:
    """Weights by hashed feature, and a bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def score(self, text: str | None) -> float:
        z, seen = self.bias, Counter()
        for w in _words(text):
            if (own := self.known.get(w)) is None:
                own = self.known[w] = tuple(f for f in _features(w) if f in self.weights)
                if len(self.known) > 150_000:
                    self.known = {}
            seen.update(own)
        z += sum(self.weights[f] * math.log1p(seen[f]) for f in sorted(seen))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(x: np.ndarray, y: np.ndarray, changes: np.ndarray, l2: float, swap: float, rounds: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression with ``swap`` times the mean squared score change, by Adam over all rows.

    ``changes`` is the mean of the outer products of all swaps' changes of the features.
    """
    w, b = np.zeros(x.shape[1], np.float32), np.float32(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        e = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        g, gb = x.T @ e / len(y) + l2 * w + 2 * swap * (changes @ w), e.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        b = b - rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return w, float(b)


def mean_product(swaps: list, changes: list, n: int, at_once: int = 1_000) -> np.ndarray:
    """The mean outer product of sparse rows of ``n`` numbers, all zeros without rows."""
    out = np.zeros((n, n), np.float32)
    for i in range(0, len(swaps), at_once):
        some = np.zeros((len(swaps[i : i + at_once]), n), np.float32)
        for row, at, u in zip(some, swaps[i : i + at_once], changes[i : i + at_once], strict=True):
            row[np.asarray(at, int)] = u
        out += some.T @ some
    return out / max(len(swaps), 1)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, l2: float = 1e-4, swap: float = 1.0) -> Model:
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    sample = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # one text for each id, so what is fitted on is bounded and the same however the rows are dealt out
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    counts = rows.mapInPandas(_counted, "feature long, level long, n long, toxic int").groupBy("feature", "level").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
    total = sample.groupBy().agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n")).first()
    if not total["p"] or not total["n"]:
        return Model({}, -30.0)
    p, n = (F.col("pos") + 0.5) / (total["p"] + 1), (F.col("neg") + 0.5) / (total["n"] + 1)
    telling = F.abs(F.log(p / n)) * F.abs(p - n)
    groups = sorted({f for w in _GROUP for f in _features(w)})
    best = counts.filter(F.col("pos") + F.col("neg") >= 3).groupBy("feature").agg(F.sum(telling).alias("telling"), F.sum("pos").alias("pos")).orderBy(F.desc("telling"), "feature").limit(max_features).toPandas()["feature"].tolist()
    chosen = {int(f): i for i, f in enumerate(dict.fromkeys([*best, *groups]))}
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInPandas(_selected(chosen), f"doc_id {kind}, toxic int, x array<int>, v array<double>, swaps array<array<int>>, changes array<array<double>>").toPandas().sort_values("doc_id")
    x = np.zeros((len(made), len(chosen)), np.float32)
    for row, on, v in zip(x, made["x"], made["v"], strict=True):
        row[np.asarray(on, int)] = v
    changes = mean_product([s for row in made["swaps"] for s in row], [s for row in made["changes"] for s in row], len(chosen))
    w, bias = fit(x, made["toxic"].to_numpy(np.float32), changes, l2, swap)
    return Model({f: float(w[i]) for f, i in chosen.items()}, bias)


def _scored(model, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(model.value.weights, model.value.bias)
        for batch in batches:
            score = np.array([own.score(t) for t in batch["text"]], float)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score, "predicted": (score >= threshold).astype("int32")})

    return run


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are scored below ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.value.weights, model.value.bias)
        for batch in batches:
            keep = [own.score(t) < threshold for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return docs.select("doc_id", "text").mapInPandas(_scored(model, threshold), f"doc_id {kind}, score double, predicted int").select("doc_id", held_out.alias("held_out"), "score", "predicted")
