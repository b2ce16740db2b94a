"""Language identification by mixture inference over character n-grams.

A text's n-grams (three characters, letters only, case folded, words padded) are seen as
draws from a mixture of language distributions. Expectation-maximisation estimates the
share of each language; the set of languages is the one of highest likelihood after a
penalty for each language in it. The score is the share of the predicted language: in the
selected set if that has several languages, else among all. Each text is iterated on its
own until it has converged, so its result doesn't depend on the texts it is batched with.

The distributions are counts over all documents that may be learned from, added up on
the executors. What reaches the driver is one table of ``BINS`` numbers a language, after
the languages were counted.

Defined cases: texts that are null or have no letter are ``und`` with score 0, as is
every text where nothing could be learned; equal shares go to the smaller language name;
documents without a language teach nothing; repeated rows count as often as they occur;
other columns are ignored; an empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm._shared import Scratch, held_out

#: Bins of the n-gram hash, and what is added to each count.
BINS, SMOOTHING = 1 << 16, 0.25
#: Rounds of expectation-maximisation, at most, and the change of shares below which a text has converged.
ROUNDS, CONVERGED = 12, 1e-3
#: Log-likelihood that a further language must gain for each log of the n-grams.
PENALTY = 4.0
#: Smallest share for which a further language is tried.
LEAST_SHARE = 0.05
#: Languages that a model may have; more are an error, as the model is held by the driver.
MOST_LANGUAGES = 200


@cache
def _letters() -> np.ndarray:
    """1 for code points of letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def grams(text: str) -> np.ndarray:
    """Bins of the n-grams of a text, in order."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint32)
    x = np.zeros(len(points) + 2, np.uint32)
    x[1:-1] = np.where(letter, points, 0)
    a, b, c = x[:-2], x[1:-1], x[2:]
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77) + (c * np.uint32(0xC2B2AE3D) >> np.uint32(3)))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16))[letter]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language and bin of a partition; at most 64 languages are held at a time."""
    held: dict[str, np.ndarray] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            bins = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(bins), pa.string()), "bin": bins.astype(np.int32), "n": counts[bins]})
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in held and len(held) >= 64:
                yield from given()
            held.setdefault(lang, np.zeros(BINS, np.int64))
            held[lang] += np.bincount(grams(text), minlength=BINS) if len(text) > 20_000 else 0
            if len(text) <= 20_000:
                np.add.at(held[lang], grams(text), 1)
    yield from given()


class Model:
    """Languages in order, and the log-probability of each bin in each."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.chance = smooth / smooth.sum(0)


def learn(docs: DataFrame) -> Model:
    """The model of all rows of ``docs`` that have a text and a language."""
    taught = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = taught.mapInArrow(_counted, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    counts = Scratch(docs.sparkSession, "language").cut(counts)
    languages = sorted(r.lang for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages can't be learned")
    found = counts.toArrow()
    table = np.zeros((BINS, len(languages)))
    names = found.column("lang").combine_chunks().dictionary_encode()
    at = {lang: k for k, lang in enumerate(languages)}
    columns = np.array([at[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    table[found.column("bin").to_numpy(), columns] = found.column("n").to_numpy()
    return Model(languages, table)


def shares(chance: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Shares of the languages of one text, from n-gram probabilities and counts."""
    pi = np.full(chance.shape[1], 1 / chance.shape[1])
    for _ in range(rounds):
        part = chance * pi
        moved = (part * (counts / part.sum(1))[:, None]).sum(0) / counts.sum()
        done = np.abs(moved - pi).max() < CONVERGED
        pi = moved
        if done:
            break
    return pi


def select(chance: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """The languages of one text, and their shares, by penalised likelihood."""
    fit = lambda s: float(counts @ np.log(chance[:, s] @ shares(chance[:, s], counts)))
    order = list(np.argsort(-shares(chance, counts), kind="stable"))
    alone = counts @ np.log(chance)
    chosen = [int(np.argmax(alone))]
    best = float(alone[chosen[0]])
    for k in order:
        if k not in chosen:
            gained = fit([*chosen, int(k)])
            if gained - best <= penalty * np.log(max(2.0, counts.sum())):
                break
            chosen, best = [*chosen, int(k)], gained
    return chosen, shares(chance[:, chosen], counts)


def infer(model: Model, texts: list[str | None]) -> list[tuple[str, float, str]]:
    """Predicted language, its share, and all languages with shares, of each text."""
    out = [("und", 0.0, "")] * len(texts)
    rows, bins, counts = [], [], []
    for k, text in enumerate(texts):
        g = grams(text) if text and model.languages else ()
        if len(g):
            b, n = np.unique(g, return_counts=True)
            rows.append(k)
            bins.append(b)
            counts.append(n.astype(float))
    if not rows:
        return out
    begin = np.cumsum([0, *map(len, bins)])
    chance, weight = model.chance[np.concatenate(bins)], np.concatenate(counts)
    total = np.add.reduceat(weight, begin[:-1])
    lengths = np.diff(begin)
    pi = np.full((len(rows), len(model.languages)), 1 / len(model.languages))
    done = np.zeros(len(rows), bool)
    for _ in range(ROUNDS):
        part = chance * np.repeat(pi, lengths, axis=0)
        part *= (weight / part.sum(1))[:, None]
        moved = np.add.reduceat(part, begin[:-1], axis=0) / total[:, None]
        # A text that has converged stays as it is, however long others take.
        change = np.abs(moved - pi).max(1)
        pi = np.where(done[:, None], pi, moved)
        done |= change < CONVERGED
        if done.all():
            break
    for k, share, a, b in zip(rows, pi, begin, begin[1:], strict=False):
        top = int(np.argmax(share))
        chosen, parts, score = [top], np.ones(1), share[top]
        if np.partition(share, -2)[-2] >= LEAST_SHARE if len(share) > 1 else False:
            chosen, parts = select(chance[a:b], weight[a:b])
            best = max(range(len(chosen)), key=lambda i: (parts[i], -chosen[i]))
            top = chosen[best]
            score = parts[best] if len(chosen) > 1 else share[top]
        listed = sorted(zip(parts, (model.languages[i] for i in chosen), strict=True), key=lambda x: (-x[0], x[1]))
        out[k] = (model.languages[top], float(min(1.0, score)), ",".join(f"{lang}:{p:.2f}" for p, lang in listed))
    return out


_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages string"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The language of every text. Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                found = infer(shared.value, batch.column("text").to_pylist())
                names = ("lang_pred", "score", "languages")
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out")} | {n: [x[i] for x in found] for i, n in enumerate(names)}
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, _SCHEMA)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their columns, whose main language has at least this share."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                batch = whole.slice(k, 128)
                found = infer(shared.value, batch.column(at).to_pylist())
                yield batch.filter(pa.array([lang != "und" and share >= least for lang, share, _ in found]))

    return docs.mapInArrow(run, docs.schema)
