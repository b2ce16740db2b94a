"""Near duplicates by a chosen-path set similarity join of word shingle sets.

Documents of one word sequence are one vertex. A vertex has the minima of many hash
functions over its shingles (five words). A tree starts with all vertices in one node;
a node picks, by its own hash, a few of the functions, and sends each vertex to one
child for each picked function, named by the vertex's minimum. Similar sets share most
minima, so they stay together on some path, while others part. A node of at most
``LEAF`` vertices is compared exhaustively; larger ones branch again, down to ``DEPTH``.
Trees are independent; their number sets the recall.

Branching can't part a large group of near copies. So in a large node every vertex is
also compared with one pivot, and those very close to it stop there. The distance of sets
is a metric: what may be linked to a vertex that close isn't far from the pivot either.
Once the links with pivots are known, what is near a pivot is gathered, once for all trees,
and whatever isn't in the component that most of it forms is compared with all of it, on
full sets, block by block. So all links count, and the members of a component, however
many, are not compared with each other.

Comparison is by size and by one bit of each minimum, with a bound that a true link
misses about once in 10^6. Pairs that pass are confirmed on the full shingle sets: first
the closest earlier partner of each vertex, then those pairs whose ends are not connected
yet (the others cannot change a component).

Components come from contracting links to smaller neighbours, round by round, as tables.

Defined cases: a null or empty text has no shingles and links to nothing; with fewer
than five words the whole sequence is one shingle; rows of one id belong together; rows
with a null id are their own, with a null component, and are kept. Extra columns are
ignored. An empty table yields no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm._shared import Scratch
from eventlens.llm._shingles import mix, shingles

#: Link if PERCENT of the union is common. Independent trees, largest leaf, deepest level (branching ends once all nodes are small).
PERCENT, TREES, LEAF, DEPTH = 85, 10, 48, 32
#: Minima of a signature, of which the first are branched on and all give a bit.
MINIMA, BRANCHED = 128, 64
#: A node picks 1/PICK of a function for each vertex on average, and one at least.
PICK = 0.8
#: Different bits from the pivot up to which a vertex stops, and up to which, at least, it may be linked to one that did.
STOP, REACH = 20, 56
#: Vertices of a block that is compared with another: outside of a component, and near a pivot.
BLOCK_OUT, BLOCK_NEAR = 512, 1024
#: Bytes of text of one side of such a block, about.
BLOCK_BYTES = 16 << 20

_random = np.random.default_rng(20240229)
_FACTOR = _random.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The 32-bit minima of all hash functions over a set of 64-bit hashes."""
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * _FACTOR + _ADD
        least = np.minimum(least, (part >> np.uint64(32)).min(0))
    return least.astype(np.uint32)


def bits(least: np.ndarray) -> np.ndarray:
    """One bit of each minimum, as two 64-bit words."""
    return np.packbits((mix(least.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def most_different(percent: int = PERCENT) -> int:
    """Different bits that a linked pair has at most, but for once in about 10^6."""
    p = (1 - percent / 100) / 2
    return math.ceil(MINIMA * p + 5 * math.sqrt(MINIMA * p * (1 - p)))


def most_from_pivot(percent: int = PERCENT) -> int:
    """Different bits from the pivot up to which a vertex may be linked to one that stopped."""
    p = STOP / MINIMA + (1 - percent / 100) / 2
    return max(REACH, math.ceil(MINIMA * p + 5 * math.sqrt(MINIMA * p * (1 - p))))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = [hashlib.blake2b(b" ".join(t.encode("utf-8", "surrogatepass").lower().split()), digest_size=16).digest() for t in texts]
            sets = shingles(texts)
            least = [minima(s) for s in sets]
            both = np.stack([bits(m) for m in least]) if least else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "key": keys, "n": pa.array(map(len, sets), pa.int64()),
                    "least": [m[:BRANCHED].tobytes() for m in least], "b0": both[:, 0].copy(), "b1": both[:, 1].copy(),
                }
            )


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n, least, b0, b1``: word sequence, set size and minima of each row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_signed, "doc_id long, key binary, n long, least binary, b0 long, b1 long")


def children(node: np.ndarray, used: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, nodes and used functions of the children of rows at ``node``.

    Functions that are used on the way to a node aren't picked again.
    """
    each = mix(np.arange(1, BRANCHED + 1, dtype=np.uint64))
    draw = mix(node[:, None] ^ each)
    free = (used[:, None] >> np.arange(BRANCHED, dtype=np.uint64) & np.uint64(1)) == 0
    draw = np.where(free, draw, np.uint64(0xFFFFFFFFFFFFFFFF))
    picked = draw < np.uint64(2.0**64 / (PICK * BRANCHED))
    picked[np.arange(len(node)), draw.argmin(1)] = True
    row, function = np.nonzero(picked)
    value = least[row, function].astype(np.uint64) | (function.astype(np.uint64) << np.uint64(32))
    return row, mix(node[row] ^ mix(value + np.uint64(1))), used[row] | (np.uint64(1) << function.astype(np.uint64))


_ROW = "node long, used long, v long, n long, b0 long, b1 long"


def _branch(trees: int):
    """Rows of the next level, for vertices with the nodes ``at`` which they are; of the first, for those without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                if not batch.num_rows:
                    continue
                least = np.frombuffer(b"".join(batch.column("least").to_pylist()), np.uint32).reshape(-1, BRANCHED)
                if "at" in batch.schema.names:
                    each = np.repeat(np.arange(len(least)), batch.column("at").value_lengths().to_numpy())
                    nodes, ways = (x.to_numpy().view(np.uint64) for x in batch.column("at").flatten().flatten())
                    starts = ((each[k : k + 2048], nodes[k : k + 2048], ways[k : k + 2048]) for k in range(0, len(each), 2048))
                else:
                    each, none = np.arange(len(least)), np.zeros(len(least), np.uint64)
                    starts = ((each, none + mix(np.array([t + 1], np.uint64)), none) for t in range(trees))
                for own, node, used in starts:
                    row, child, done = children(node, used, least[own])
                    taken = pa.array(own[row])
                    names = ("v", "n", "b0", "b1")
                    yield pa.RecordBatch.from_pydict(
                        {"node": child.view(np.int64), "used": done.view(np.int64)} | {x: batch.column(x).take(taken) for x in names}
                    )

    return run


def _far(x: Column, y: Column) -> Column:
    """Different bits of two vertices."""
    differ = F.bit_count(x["b0"].bitwiseXOR(y["b0"])) + F.bit_count(x["b1"].bitwiseXOR(y["b1"]))
    return differ.cast("int")


def _alike(a: str, b: str, percent: int) -> Column:
    """True if two vertices may be linked, by size and by bits."""
    x, y = F.col(a), F.col(b)
    sizes = 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
    return sizes & (_far(x, y) <= most_different(percent))


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x["v"], y["v"]).alias("a"), F.greatest(x["v"], y["v"]).alias("b"), _far(x, y).alias("far")]


_VERTEX = ("v", "n", "b0", "b1")


def candidates(
    vertices: DataFrame, scratch: Scratch, percent: int = PERCENT, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH
) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b, far`` to confirm, and what stopped in large nodes.

    The latter has ``pivot, v``: what is near a pivot, of those pivots where any vertex
    stopped. At the last level, if it is reached, all vertices of large nodes stop.
    """
    rows = vertices.mapInArrow(_branch(trees), _ROW)
    own, pairs, dense, written = F.struct(*_VERTEX), [], [], []
    for level in range(depth):
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min(own).alias("pivot")).where("size > 1")
        # Vertices that are alone in their node leave here. Written before it is grouped, this join may split.
        met = scratch.cut(rows.join(sizes, "node").withColumn("pivot", F.when(F.col("size") > leaf, F.col("pivot"))))
        written.append(met)
        if level:
            scratch.drop(rows)
        small = met.where(F.col("size") <= leaf).groupBy("node").agg(F.collect_list(own).alias("all"))
        one = small.select("all", F.explode("all").alias("x"))
        both = one.select("x", F.explode(F.filter("all", lambda y: y["v"] > F.col("x.v"))).alias("y"))
        pairs.append(both.where(_alike("x", "y", percent)).select(_pair(F.col("x"), F.col("y"))))
        large = met.where(F.col("size") > leaf).select("node", "used", own.alias("x"), F.col("pivot").alias("y"))
        large = large.withColumn("far", _far(F.col("x"), F.col("y")))
        pairs.append(large.where("x.v <> y.v").where(_alike("x", "y", percent)).select(_pair(F.col("x"), F.col("y"))))
        last = level == depth - 1
        near = large.where(F.lit(last) | (F.col("far") <= most_from_pivot(percent)))
        stopped = F.lit(last) | (F.col("far") <= STOP) & (F.col("x.v") != F.col("y.v"))  # the pivot has met all
        dense.append(near.select(F.col("y.v").alias("pivot"), "x.v", stopped.alias("stopped")))
        on = large.where(F.col("far") > STOP)
        if last or on.isEmpty():
            break
        # A vertex meets its minima once, however many nodes it is in; bits tell the texts of one id apart.
        on = on.groupBy("x.v", "x.b0", "x.b1").agg(F.collect_set(F.struct("node", "used")).alias("at"))
        rows = scratch.cut(on.join(vertices, ["v", "b0", "b1"]).mapInArrow(_branch(trees), _ROW))
    found, stops = pairs[0], dense[0]
    for x in pairs[1:]:
        found = found.unionByName(x)
    for x in dense[1:]:
        stops = stops.unionByName(x)
    found = scratch.cut(found.distinct())
    stops = scratch.cut(stops.groupBy("pivot", "v").agg(F.bool_or("stopped").alias("stopped")))
    scratch.drop(*written)
    used = stops.where("stopped").select("pivot").distinct()  # where nothing stopped, nobody need be remembered
    return found, scratch.cut(stops.select("pivot", "v").join(used, "pivot", "left_semi"))


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                left, right = shingles(batch.column("text_a").to_pylist()), shingles(batch.column("text_b").to_pylist())
                linked = []
                for x, y in zip(left, right, strict=True):
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    linked.append(bool(common) and 100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_pydict({n: batch.column(n).filter(pa.array(linked, pa.bool_())) for n in ("a", "b")})

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough; ``texts`` has ``v, text``."""
    left = texts.select(F.col("v").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("v").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_confirmed(percent), "a long, b long")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``v, c``: for every linked vertex the smallest vertex that it reaches.

    Every vertex is hung below its smallest neighbour, chains are shortened, links are
    renamed to roots, and so on until no link is left. Written once a round.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    edges = scratch.cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    names = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        direct = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up"))
        direct = scratch.cut(direct.select(F.col("a").alias("v"), "up"))
        above = direct
        for _ in range(2):
            step = above.select(F.col("v").alias("up"), F.col("up").alias("further"))
            above = above.join(step, "up").select("v", F.col("further").alias("up"))
        above = scratch.cut(above)
        root = above.select(F.col("v").alias("b"), F.col("up").alias("root_b"))
        moved = edges.join(above.select(F.col("v").alias("a"), F.col("up").alias("root_a")), "a").join(root, "b")
        moved = moved.where("root_a <> root_b").select(F.greatest("root_a", "root_b").alias("a"), F.least("root_a", "root_b").alias("b"))
        moved = scratch.cut(moved.distinct())
        scratch.drop(edges, direct)
        if names is None:
            names = above.select("v", F.col("up").alias("c"))
        else:
            up = above.select(F.col("v").alias("c"), "up")
            names = scratch.cut(names.join(up, "c", "left").select("v", F.coalesce("up", "c").alias("c")))
        edges = moved
    return names if names is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("c"))


def with_links(names: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``names`` after further links: only the components that these connect are looked at."""
    if links.isEmpty():
        return names
    of = lambda end: names.select(F.col("v").alias(end), F.col("c").alias(f"of_{end}"))
    roots = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    up = components(roots.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")), scratch)
    moved = names.join(up.select(F.col("v").alias("c"), F.col("c").alias("root")), "c", "left")
    new = up.join(names.select("v"), "v", "left_anti")
    return scratch.cut(moved.select("v", F.coalesce("root", "c").alias("c")).unionByName(new.select("v", "c")))


def _apart(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs whose ends aren't in one component."""
    of = lambda end: names.select(F.col("v").alias(end), F.col("c").alias(f"of_{end}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def link_documents(docs: DataFrame, percent: int = PERCENT, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    cut = scratch.cut
    signed = cut(signatures(docs))
    own = F.struct(F.col("doc_id").alias("v"), "n", "b0", "b1", "least")
    vertices = signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("key").agg(F.min(own).alias("x"))
    vertices = cut(vertices.select("key", "x.*"))
    pairs, stops = candidates(vertices.drop("key"), scratch, percent, trees, leaf, depth)
    near = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).unionByName(stops.select("v"))
    texts = docs.select(F.col("doc_id").cast("long").alias("v"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows of one id and different texts are compared with each of them.
    texts = texts.join(cut(near.distinct()), "v", "left_semi").groupBy("v", F.xxhash64("text").alias("mark")).agg(F.min("text").alias("text"))
    texts = cut(texts.select("v", "text", F.octet_length("text").cast("long").alias("bytes")))
    closest = pairs.groupBy("b").agg(F.min(F.struct("far", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    names = components(confirm(closest, texts, percent), scratch)
    names = with_links(names, cut(confirm(cut(_apart(pairs, names)), texts, percent)), scratch)
    names = with_links(names, cut(_residual(stops, names, texts, percent, scratch)), scratch)
    of_key = vertices.select("key", "v").join(names, "v", "left").select("key", F.coalesce("c", "v").alias("c"))
    rows = signed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("key")).alias("key"))
    joined = rows.join(cut(of_key), "key", "left").withColumn("c", F.coalesce("c", "doc_id"))
    scratch.drop(texts)
    kept = F.coalesce(F.col("c") == F.col("doc_id"), F.lit(True))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), kept.alias("kept"))


def cross_links(left: list[np.ndarray], right: list[np.ndarray], percent: int, columns: int = 2048) -> np.ndarray:
    """Which sets of ``left`` (rows) are linked to which of ``right``, by exact counts.

    Only hashes that two sets have at least matter; they are counted so many at a time.
    """
    sizes = np.array([len(x) for x in [*left, *right]], np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    _, at, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    of, at = of[shared], (np.cumsum(times > 1) - 1)[at[shared]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int((times > 1).sum()), columns):
        a, b = np.searchsorted(at, [first, first + columns])
        some = np.zeros((len(sizes), columns), np.float32)
        some[of[a:b], at[a:b] - first] = 1
        common += some[: len(left)] @ some[len(left) :].T
    whole = sizes[: len(left), None] + sizes[None, len(left) :] - common
    return (common > 0) & (100 * common >= percent * whole)


def _residual(stops: DataFrame, names: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links ``a, b`` between vertices near one pivot that aren't connected yet.

    What is outside the largest component near the pivot meets all that is near it, in a
    grid of blocks of bounded size. Of the links between two components one is enough.
    """
    # A vertex meets its name, size and text once, however many pivots it is near.
    weight = texts.groupBy("v").agg(F.sum("bytes").alias("bytes"))
    every = stops.groupBy("v").agg(F.collect_set("pivot").alias("pivots")).join(names, "v", "left").join(weight, "v")
    named = scratch.cut(every.select(F.explode("pivots").alias("pivot"), "v", F.coalesce("c", "v").alias("c"), "bytes"))
    main = named.groupBy("pivot", "c").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes")).groupBy("pivot")
    main = main.agg(F.max(F.struct("count", "c", "bytes")).alias("m"), F.sum("count").alias("near"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, rows, size: F.ceil(F.greatest(n / rows, size / BLOCK_BYTES)).cast("int")
    main = main.select(
        "pivot", F.col("m.c").alias("main"), blocks(F.col("near"), BLOCK_NEAR, F.col("bytes")).alias("across"),
        blocks(F.col("near") - F.col("m.count"), BLOCK_OUT, F.col("bytes") - F.col("m.bytes")).alias("down"),
    )
    told = named.join(scratch.cut(main.where("down > 0")), "pivot").groupBy("v", "c")
    told = told.agg(F.collect_list(F.struct("pivot", "main", "across", "down")).alias("told"))
    named = told.join(texts.drop("bytes"), "v").select("v", "c", "text", F.inline("told"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    out = named.where("c <> main").select("pivot", own("down").alias("i"), each("across").alias("j"), "v", "c", "text")
    # Other names, as both sides of a cogroup may not share columns.
    again = {"pivot": "group", "v": "w", "c": "d", "text": "body"}
    near = named.select(*[F.col(x).alias(y) for x, y in again.items()], each("down").alias("row"), own("across").alias("col"))

    def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        linked = cross_links(shingles(x.text.tolist()), shingles(y.body.tolist()), percent)
        c, d = x.c.to_numpy(), y.d.to_numpy()
        i, j = np.nonzero(linked & (c[:, None] != d[None]))
        _, one = np.unique(np.stack([c[i], d[j]]), axis=1, return_index=True)
        return pd.DataFrame({"a": x.v.to_numpy()[i[one]], "b": y.w.to_numpy()[j[one]]})

    return out.groupBy("pivot", "i", "j").cogroup(near.groupBy("group", "row", "col")).applyInPandas(cell, "a long, b long")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, but for documents linked to an earlier one."""
    found = link_documents(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    gone = Scratch(docs.sparkSession, "near-gone").cut(found)
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
