"""Nearest neighbours by randomly rotated one-bit codes with exact reranking.

Every vector is centred, scaled to length one, rotated at random and kept as the signs
of its coordinates (one bit each) with two correction scalars: its distance to the
centre and the inner product of the unit vector with its own code. From these the inner
product with a query is estimated without bias, with a known error bound. Vectors whose
lower distance bound does not exceed the query's k-th exact distance are reranked on
the original vectors.

Queries meet the index in a grid of cells: a cell holds one block of the index and one
block of queries, both of bounded size, and keeps the k best of each query; those are
merged for each query, ranked before they are shuffled. A cell walks through its pairs in
tiles, and a query's k-th distance so far bounds what later tiles rerank. Vectors travel
in their own precision, once for each ``CELL_QUERIES`` queries, and queries once for each
``CELL_ROWS`` rows, so that what a cell computes is thousands of times what it reads.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part; distances are between vectors of one length, and each length has its own index. A query's own rows (same id) are no candidates.
Of repeated query ids the smallest vector is searched; repeated candidates are ranked
as often as they occur. Ties go to the smaller id. An empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the centre is computed from, at most; chosen by hash of the id.
FIT_ROWS = 4096
#: Standard deviations of the estimate that the bounds allow for.
EPSILON = 2.5
#: Index rows and queries of a cell, about; rows of the smallest cells, where more cells keep more cores busy.
CELL_ROWS, CELL_QUERIES, LEAST_ROWS = 32_768, 8192, 2048
#: Index rows and queries of a tile.
TILE_ROWS, TILE_QUERIES = 4096, 256
#: Lengths of vectors that are told apart, at most; more are an error.
MOST_LENGTHS = 64


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for the same arguments."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, distances to the centre and inner products with the own code."""
    residual = x - centre
    norm = np.sqrt((residual * residual).sum(1))
    unit = residual / np.where(norm > 0, norm, 1)[:, None] @ turn
    own = np.abs(unit).sum(1) / np.sqrt(x.shape[1])
    return np.packbits(unit > 0, axis=1), norm, np.where(norm > 0, own, 1.0)


def estimate(codes, norm, own, q: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON):
    """Estimated squared distances (vectors x queries) and half widths of their bounds."""
    dim = q.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    residual = (q - centre) @ turn
    qnorm = np.sqrt((residual * residual).sum(1))
    unit = residual / np.where(qnorm > 0, qnorm, 1)[:, None]
    inner = (signs @ unit.T.astype(np.float32)) / np.sqrt(dim) / own[:, None]
    scale = 2 * norm[:, None] * qnorm[None]
    width = epsilon * np.sqrt(np.maximum(1 / (own * own) - 1, 0) / max(dim - 1, 1))
    return norm[:, None] ** 2 + qnorm[None] ** 2 - scale * inner, scale * width[:, None] + 1e-6


def usable(vector: str = "embedding") -> Column:
    """True for vectors that take part: not null, finite throughout, not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


class Index:
    """Codes of every vector, and for each length of vectors their number, centre and rotation."""

    def __init__(self, rows: DataFrame, fitted: dict[int, tuple[int, np.ndarray, np.ndarray]]):
        self.rows, self.fitted = rows, fitted


def clean(vectors: DataFrame) -> DataFrame:
    """Ids, usable vectors, and their length."""
    own = vectors.schema["embedding"].dataType
    kept = own if own.simpleString() == "array<float>" else "array<double>"
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept).alias("embedding"))
    slim = slim.where(F.col("vec_id").isNotNull()).where(F.coalesce(usable(), F.lit(False)))
    return slim.withColumn("dim", F.size("embedding"))


def _matrix(vectors) -> np.ndarray:
    return np.stack(list(vectors)).astype(np.float64)


def build_index(vectors: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 7) -> Index | None:
    """Index every usable row. Only the centres are fitted, on at most ``fit_rows`` rows each."""
    rows = clean(vectors)
    sizes = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_LENGTHS + 1).collect()
    if len(sizes) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    fitted = {}
    for dim, count in sizes:
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).collect()
        fitted[dim] = count, _matrix(r.embedding for r in sample).mean(0), rotation(dim, seed)
    if not fitted:
        return None

    def coded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, own in part.groupby("dim"):
                _, centre, turn = fitted[dim]
                codes, norm, inner = encode(_matrix(own.embedding), centre, turn)
                yield own.assign(code=[c.tobytes() for c in codes], norm=norm, own=inner)

    kind = rows.schema["embedding"].dataType.simpleString()
    return Index(rows.mapInPandas(coded, f"vec_id long, embedding {kind}, dim int, code binary, norm double, own double"), fitted)


def nearest(part: pd.DataFrame, queries: pd.DataFrame, k: int, centre, turn, epsilon: float = EPSILON) -> pd.DataFrame:
    """The k nearest rows of ``part`` to each query, by estimate, bound and rerank, tile by tile."""
    x, ids = _matrix(part.embedding), part.vec_id.to_numpy()
    asked, names = _matrix(queries.embedding), queries.vec_id.to_numpy()
    codes = np.frombuffer(b"".join(part.code), np.uint8).reshape(len(part), -1)
    norm, own = part.norm.to_numpy(), part.own.to_numpy()
    out = []
    for first in range(0, len(asked), TILE_QUERIES):
        q, name = asked[first : first + TILE_QUERIES], names[first : first + TILE_QUERIES]
        best = [(np.empty(0), np.empty(0, np.int64))] * len(q)
        for at in range(0, len(x), TILE_ROWS):
            rows = slice(at, at + TILE_ROWS)
            tile, tile_ids = x[rows], ids[rows]
            guess, width = estimate(codes[rows], norm[rows], own[rows], q, centre, turn, epsilon)
            low = guess - width
            for j in range(len(q)):
                other = tile_ids != name[j]
                near = lambda some, j=j, tile=tile: ((tile[some] - q[j]) ** 2).sum(1)
                bound = best[j][0][k - 1] if len(best[j][0]) == k else np.inf
                if other.sum() > 2 * k and bound == np.inf:
                    sure = np.argpartition(np.where(other, guess[:, j], np.inf), 2 * k)[: 2 * k]
                    bound = np.partition(near(sure), k - 1)[k - 1]
                some = np.flatnonzero(other & (low[:, j] <= bound))
                if len(some):
                    distance, those = np.append(best[j][0], near(some)), np.append(best[j][1], tile_ids[some])
                    order = np.lexsort((those, distance))[:k]
                    best[j] = distance[order], those[order]
        many = [len(b[0]) for b in best]
        found = {"query_id": np.repeat(name, many), "vec_id": np.concatenate([b[1] for b in best]), "score": np.sqrt(np.concatenate([b[0] for b in best]))}
        out.append(pd.DataFrame(found))
    return pd.concat(out)


def search(index: Index | None, queries: DataFrame, k: int = 10, epsilon: float = EPSILON) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of each query, nearest first."""
    spark = queries.sparkSession
    schema = "query_id long, vec_id long, score double"
    if index is None:
        found = spark.createDataFrame([], schema)
    else:
        fitted, cores = index.fitted, spark.sparkContext.defaultParallelism
        asked = clean(queries).where(F.col("dim").isin(list(fitted)))
        # A query id has one vector: its smallest, shorter ones first.
        asked = asked.groupBy("vec_id").agg(F.min(F.struct("dim", "embedding")).alias("x")).select("vec_id", "x.*")
        many = dict(asked.groupBy("dim").count().collect())

        def grid(dim: int, count: int) -> tuple[int, int]:
            across = max(1, -(-many.get(dim, 0) // CELL_QUERIES))
            return max(-(-count // CELL_ROWS), min(-(-count // LEAST_ROWS), -(-2 * cores // across))), across

        cells = {dim: grid(dim, count) for dim, (count, *_) in fitted.items() if many.get(dim)}
        size = F.create_map(*[F.lit(x) for dim, cell in cells.items() for x in (dim, list(cell))]) if cells else F.create_map(F.lit(0), F.array(F.lit(0)))
        down, across = F.element_at(F.element_at(size, F.col("dim")), 1), F.element_at(F.element_at(size, F.col("dim")), 2)
        rows = index.rows.where(F.col("dim").isin(list(cells))).withColumn("r", F.pmod(F.xxhash64("vec_id", "embedding"), down).cast("int"))
        rows = rows.withColumn("c", F.explode(F.sequence(F.lit(0), across - 1)))
        asked = asked.withColumn("c", F.pmod(F.xxhash64("vec_id"), across).cast("int"))
        asked = asked.withColumn("r", F.explode(F.sequence(F.lit(0), down - 1)))

        def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            return nearest(left, right, k, *fitted[int(left.dim.iloc[0])][1:], epsilon)

        found = rows.groupBy("dim", "r", "c").cogroup(asked.groupBy("dim", "r", "c")).applyInPandas(cell, schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
