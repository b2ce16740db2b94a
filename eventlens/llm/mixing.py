"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target number of words. A source that needs r words for each of its
words takes every document floor(r) times and some documents once more; these are drawn
with equal inclusion probabilities that add up to the target. The draw follows the cube
method: probabilities of a few documents move along the null space of the constraints
(their number and their words), in random directions, until each is 0 or 1, so that both
totals stay exact while more than two documents of a group are undecided.

A source is dealt into groups of bounded size by hash of the id, so a hot source is many
groups. At most two undecided documents of a group go on to the next level, where groups
are merged by the hundreds, until each source has at most two left: the landing problem.
There the outcome whose word total is closest to the target is taken, and what a long
last document leaves open is closed by a few changed decisions.

All randomness is a hash of document ids, and groups do not depend on how the input is
partitioned: the same rows give the same mix.

Defined cases: null and empty texts have size 0; null sources are one source, ordered
last; repeated rows are drawn one by one; extra columns are kept by ``apply_mix``;
sources whose sizes are all 0 have target 0 and take nothing; an empty table yields no
rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm._shared import WORD_PATTERN, Scratch

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix for each word there is, and most words taken for each word of a source.
SHARE, LIMIT = 1.5, 2.0
#: Documents of a group at the first level, and groups merged to one at the next levels.
GROUP_ROWS, FAN_IN = 1024, 256
#: Source tables of up to so many rows are broadcast; larger ones are joined.
BROADCAST_SOURCES = 10_000


def words(text: str = "text") -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``source, source_size, n_docs, target`` of a table ``source, size`` of documents.

    A target is the smaller of ``limit`` times the source's size and a common level times
    its weight; the level makes the targets add up. That is where sharing the excess of
    full sources by weight ends. One row a source; the running sums see only those rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("place", place).withColumn("weight", weight)
    per = per.withColumn("most", limit * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(everything))
    rising = everything.orderBy(F.col("most") / F.col("weight"), "place")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level)
    room = F.col("most") / F.col("weight")
    first_open = F.min(F.when(F.col("level") <= room, F.struct(room.alias("room"), "place", "level"))).over(everything)
    target = F.least(F.col("most"), F.coalesce(F.col("weight") * first_open["level"], F.col("most")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _unit(seed: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on the seeds alone."""
    x = seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).astype(np.float64) / 2.0**64


def flight(chance: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Inclusion probabilities moved until at most two of them are strictly between 0 and 1.

    The sum of the probabilities and of probability times size stay as they are, while
    three documents at a time move along the direction that changes neither.
    """
    p = chance.astype(float).copy()
    draw = _unit(seed)
    active: list[int] = []
    for k in np.flatnonzero((p > 0) & (p < 1)):
        active.append(int(k))
        if len(active) < 3:
            continue
        a, b, c = active
        u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        now = p[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - now) / u, np.where(u < 0, -now / u, np.inf)))
            down = np.min(np.where(u > 0, now / u, np.where(u < 0, (now - 1) / u, np.inf)))
        step = up if draw[k] * (up + down) < down else -down
        moved = now + step * u
        moved[moved < 1e-9], moved[moved > 1 - 1e-9] = 0.0, 1.0
        p[active] = moved
        active = [i for i in active if 0 < p[i] < 1]
    return p


def landing(chance: np.ndarray, size: np.ndarray, goal: float, loose: np.ndarray, flips: int = 16) -> np.ndarray:
    """The last few documents decided: the outcome whose words come closest to ``goal``.

    A long document can be among them. What then is missing or too much is made up by
    at most ``flips`` other decisions, each the one that closes most of the gap; only
    documents marked ``loose``, whose chance was open before the flight, may change.
    """
    p = chance.astype(float).copy()
    rest = np.flatnonzero((p > 0) & (p < 1))
    if len(rest):
        least = goal - p[(p <= 0) | (p >= 1)] @ size[(p <= 0) | (p >= 1)]
        outcomes = itertools.product((0.0, 1.0), repeat=len(rest))
        p[rest] = min(outcomes, key=lambda x: (abs(np.dot(x, size[rest]) - least), x))
    for _ in range(flips):
        gap = goal - p @ size
        after = np.where(loose, np.abs(gap - np.where(p > 0, -size, size)), np.inf)
        if not len(after) or after.min() >= abs(gap):
            break
        k = int(np.argmin(after))
        p[k] = 1 - p[k]
    return p


def sizes_of(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, mark`` of each row; the mark tells rows of one id apart."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        words().alias("size"), F.xxhash64("doc_id", "text").alias("mark"),
    )


def balanced_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for each row of ``docs``."""
    cut = Scratch(docs.sparkSession, "mix").cut
    sized = cut(sizes_of(docs))
    per = cut(targets(sized, weights, share, limit))
    many, largest = per.agg(F.count("*"), F.coalesce(F.max("n_docs"), F.lit(0))).first()
    side = F.broadcast(per) if many <= BROADCAST_SOURCES else per
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(side.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    joined = joined.withColumn("rate", rate).withColumn("sure", F.floor("rate"))
    joined = joined.withColumn("chance", F.col("rate") - F.col("sure"))
    joined = joined.withColumn("part", F.pmod(F.col("mark"), F.ceil(F.col("n_docs") / GROUP_ROWS)))
    schema = joined.schema
    levels = 1
    while GROUP_ROWS * FAN_IN ** (levels - 1) < largest:
        levels += 1

    def move(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["mark", "doc_id", "size"], kind="stable", na_position="first")
        return group.assign(chance=flight(group.chance.to_numpy(), group["size"].to_numpy(), group.mark.to_numpy()))

    def land(group: pd.DataFrame) -> pd.DataFrame:
        goal = float((group.chance * group["size"]).sum())
        moved = move(group)
        loose = ((group.chance > 0) & (group.chance < 1)).loc[moved.index].to_numpy()
        return moved.assign(chance=landing(moved.chance.to_numpy(), moved["size"].to_numpy().astype(float), goal, loose))

    undecided, decided = joined, []
    for level in range(levels):
        last = level == levels - 1
        moved = undecided.groupBy("source", "part").applyInPandas(land if last else move, schema)
        if last:
            decided.append(moved)
        else:
            moved = cut(moved)
            open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
            decided.append(moved.where(~open_))
            undecided = moved.where(open_).withColumn("part", F.floor(F.col("part") / FAN_IN))
    mixed = decided[0]
    for x in decided[1:]:
        mixed = mixed.unionByName(x)
    copies = (F.col("sure") + F.col("chance")).cast("int")
    return mixed.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "mark")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns.

    Documents without words take no part in the balance and are kept once.
    """
    mix = balanced_mix(docs, **options)
    # Rows of one id and one text are alike, so their numbers may be pooled and dealt back.
    pooled = mix.groupBy("mark").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"), F.max("size").alias("size"))
    # Rows travel as one struct, so that their columns can't clash with those of the operator.
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("mark"))
    joined = tagged.join(pooled, "mark")
    turn = F.row_number().over(Window.partitionBy("mark").orderBy(F.lit(1)))
    several = joined.where(F.col("rows") > 1).withColumn("turn", turn)
    single = joined.where(F.col("rows") == 1).withColumn("turn", F.lit(1))
    dealt = F.floor(F.col("copies") / F.col("rows")) + (F.col("turn") <= F.col("copies") % F.col("rows")).cast("int")
    times = F.when(F.col("size") == 0, 1).otherwise(dealt).cast("int")
    taken = single.unionByName(several).withColumn("times", times).where(F.col("times") > 0)
    repeated = taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
