"""Quality classifier: logistic regression over hashed word n-grams, learned by FTRL.

Features are word and word-shape n-grams (one and two long), hashed to a fixed number of
weights; a shape keeps the case pattern, the marks around a word, and whether it repeats
the word before. Values are term frequencies scaled to length one. The weights are
learned by follow-the-regularised-leader updates for each coordinate, over a bounded
sample of labelled documents in a fixed order, and scoring is one sparse dot product.

Defined cases: null and empty texts have no features and score by the bias alone;
documents labelled more than once count once, with the larger label; of rows of one id
only one is learned from (the one of smallest features); without any label
every score is 0.5; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm._shared import held_out

#: Hashed weights; the last is the bias.
BINS = 1 << 18
#: Labelled documents to learn from, at most: those of smallest id hash.
FIT_ROWS = 8000
#: N-gram bins of these documents that are learned from, at most: documents beyond it, in the same order, are left out.
FIT_FEATURES = 1 << 25
#: Passes over them, and the learner's step, smoothing and penalties.
PASSES, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.2, 0.1
#: From this score on a document is predicted to be good.
THRESHOLD = 0.7

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class _Words(dict):
    """Hash of the word in the upper, hash of its shape in the lower 32 bits."""

    limit = 1 << 18

    def __missing__(self, word: str) -> int:
        core = word.strip(_EDGE)
        case = "n" if not core else "u" if core.isupper() and len(core) > 1 else "l" if core.islower() else "t" if core[:1].isupper() else "d" if core.isdigit() else "m"
        left, right = word[: len(word) - len(word.lstrip(_EDGE))], word[len(word.rstrip(_EDGE)) :] if core else ""
        shape = f"{left[:4]} {case}{min(len(core), 12) // 4} {right[:4]}"
        value = zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(shape.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


_words = _Words()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bins of a text's n-grams and their values."""
    found = text.split() if text else []
    both = np.array(list(map(_words.__getitem__, found)), np.uint64)
    if not len(both):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    shape[1:] += (word[1:] == word[:-1]).astype(np.uint64) << np.uint64(33)
    keys = [word, word[:-1] * _A + word[1:], shape + np.uint64(1 << 40), shape[:-1] * _B + shape[1:]]
    mixed = np.concatenate(keys) * _A
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _B
    bins, counts = np.unique((mixed >> np.uint64(40)) % np.uint64(BINS - 1), return_counts=True)
    values = counts.astype(np.float32)
    return bins.astype(np.int32), values / np.sqrt((values * values).sum())


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> np.ndarray:
    """Weights after ``passes`` rounds of FTRL-proximal over the examples in order."""
    z, n = np.zeros(BINS), np.zeros(BINS)

    def weights(bins):
        own, root = z[bins], np.sqrt(n[bins])
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + root) / ALPHA + L2))

    for _ in range(passes):
        for bins, values, label in examples:
            bins, values = np.append(bins, BINS - 1), np.append(values, 1.0)
            w = weights(bins)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
            z[bins] += g - (np.sqrt(n[bins] + g * g) - np.sqrt(n[bins])) / ALPHA * w
            n[bins] += g * g
    return weights(np.arange(BINS)).astype(np.float32)


def score(weights: np.ndarray, text: str | None) -> float:
    """Probability that the text is good."""
    bins, values = features(text)
    margin = float(weights[bins] @ values) + float(weights[-1])
    return 1 / (1 + np.exp(-min(35.0, max(-35.0, margin))))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES) -> np.ndarray:
    """Weights learned from at most ``fit_rows`` labelled documents outside the held-out fold.

    Features are made on the executors; one task, whose input has that bound, learns.
    """
    named = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    named = named.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "bins": [b.tobytes() for b, _ in parts], "vals": [v.tobytes() for _, v in parts]}
            )

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, held = [], 0
        for batch in batches:
            for b, v, y in zip(batch.column("bins").to_pylist(), batch.column("vals").to_pylist(), batch.column("label").to_pylist(), strict=True):
                held += len(b) // 4
                if held <= fit_features:
                    examples.append((np.frombuffer(b, np.int32), np.frombuffer(v, np.float32), y))
        yield pa.RecordBatch.from_pydict({"weights": [train(examples).tobytes()]})

    rows = taught.mapInArrow(made, "doc_id long, label int, bins binary, vals binary")
    # One row a document, so that the last task has at most ``fit_rows``, each of at most BINS features.
    least = rows.groupBy("doc_id", "label").agg(F.min(F.struct("bins", "vals")).alias("x")).select("doc_id", "label", "x.*")
    one = least.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = one.mapInArrow(learned, "weights binary").first()
    return np.frombuffer(found.weights, np.float32) if found else np.zeros(BINS, np.float32)


def classify(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BINS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(shared.value, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(scores, pa.float64()),
                    "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32()),
                }
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
