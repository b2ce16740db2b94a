"""Document fingerprints: bottom-k sketches of word shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a text's five-word shingles.
Sketches of parts merge to the sketch of the whole; two sketches estimate resemblance,
containment and the number of distinct shingles.

Defined cases: a null text is the empty text, whose sketch is empty; two empty sketches
resemble each other fully, an empty and another one not at all. A text of fewer than
five words has one shingle. Rows are ordered by ``doc_id`` with nulls first, rows of one
id by text; rows of one id, and those without one, are in one range, which one task sorts
with spilling and streams. Extra columns are ignored; an empty table yields no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm._shared import partitions
from eventlens.llm._shingles import shingles

#: Hashes of a sketch. The standard error of a resemblance r is sqrt(r(1-r)/K).
K = 128
#: Bytes of input for each range of ids, and most ranges: as many as quantiles can be told apart and named in a
#: plan. Beyond both, ranges grow; they are sorted with spilling and streamed, so memory doesn't depend on their size.
RANGE_BYTES, MOST_RANGES = 128 << 20, 4096


def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    """The bottom-k sketch of each text."""
    return [s[:k] for s in shingles(texts)]


def merge(*parts: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of everything that the parts sketch."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.empty(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated shingles in common for each shingle of either text."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k=k)
    return float(np.isin(both, a).__and__(np.isin(both, b)).mean())


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    union = distinct(merge(a, b, k=k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    """The sketch as text: its hashes, rising, big-endian, in base64."""
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    """The sketch of a text that ``to_text`` made."""
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def edited(text: str, other: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``other``."""
    n = len(text) // 4
    return text[: len(text) - n] + other[:n]


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_shingles_est double"
)


def _rows(batch: list[tuple], donor: tuple, k: int) -> Iterator[tuple]:
    """Finished rows of ``batch``, of which ``donor`` is the next one: ids, texts, sketches."""
    chain = [*batch, donor]
    texts = [edited(a[1], b[1]) for a, b in zip(chain, chain[1:], strict=False)]
    for (doc_id, text, own), after, changed, sketch in zip(batch, chain[1:], texts, sketches(texts, k), strict=True):
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        yield (
            doc_id, len(text), digest, to_text(own), to_text(sketch),
            resemblance(own, sketch, k), resemblance(own, after[2], k), distinct(own, k),
        )


def _streamed(k: int):
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: tuple | None = None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column("text").to_pylist()
                rows = list(zip(batch.column("doc_id").to_pylist(), texts, sketches(texts, k), strict=True))
                if carried is not None:
                    rows.insert(0, carried)
                done = list(_rows(rows[:-1], rows[-1], k))
                carried = rows[-1]  # a range's last row is the donor, which isn't returned here
                columns = zip(*done, strict=True) if done else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def ranges(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """As many ranges as the session has shuffle partitions, or more for a large input."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # else the plan can't tell
    return min(MOST_RANGES, max(partitions(docs.sparkSession), -(-size // range_bytes) if known else 1))


def fingerprint_with_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's start.

    The order by id is met without one global sort of texts in a single task: ids are
    cut into ranges at quantiles, the first document of each range is also sent to the
    range before it (that of the first range to the last), and each range is sorted and
    streamed on its own. Texts are shuffled once.
    """
    many = ranges(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = [i / many for i in range(1, many)]
    cuts = slim.agg(F.percentile_approx("doc_id", marks, 10 * MOST_RANGES).alias("cuts")).first().cuts if marks else None
    # Two steps, so that a row is compared with about twice the square root of the number of cuts.
    cuts = sorted(set(cuts or []))
    wide = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    spot = F.lit(0)
    if blocks:
        # The id enters the lambdas as a captured column; nulls come first.
        heads = F.array(*[F.lit(b[0]) for b in blocks])
        inner = F.array(*[F.array(*map(F.lit, b)) for b in blocks])
        block = F.size(F.filter(heads, lambda x: x <= F.col("doc_id")))
        within = F.size(F.filter(F.element_at(inner, F.greatest(block, F.lit(1))), lambda x: x <= F.col("doc_id")))
        spot = F.coalesce(F.when(block == 0, 0).otherwise((block - 1) * wide + within), F.lit(0)).cast("int")
    placed = slim.withColumn("part", spot)
    firsts = placed.groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    around = firsts.select("part").withColumn("after", F.coalesce(F.lead("part").over(order), F.first("part").over(order)))
    donors = around.join(firsts.withColumnRenamed("part", "after"), "after").select("first.doc_id", "first.text", "part", F.lit(1).alias("donor"))
    rows = placed.withColumn("donor", F.lit(0)).unionByName(donors)
    dealt = rows.repartitionById(many, F.col("part")).sortWithinPartitions("donor", "doc_id", "text")
    return dealt.select("doc_id", "text").mapInArrow(_streamed(k), _SCHEMA)
