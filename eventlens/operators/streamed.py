"""Funnels, pattern counts and next nodes of groups of any size, in little memory a group.

Aggregates hold a group's matching events in one array. Where a group may be too large
for that, rows are dealt by key, sorted by time, and run through in Arrow batches: what
is held is the state of the current group alone: a few numbers, and for funnels with
``allow_reentry`` the entries of the current window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens import args
from eventlens.args import Base, Direction, Mode
from eventlens.functions.events import mask
from eventlens.functions.funnel import ModalFunnel
from eventlens.plans import pattern as P


class FunnelState:
    """Steps reached so far; for each step the latest entry that got there."""

    def __init__(self, steps: int, window: int, once: bool = False):
        self.best: list[int | None] = [None] * steps
        self.window, self.once = window, once

    def add(self, ts: int, own: int) -> None:
        best, steps = self.best, range(1, len(self.best))
        for k in reversed(steps) if self.once else steps:
            entry = best[k - 1]
            if own >> k & 1 and entry is not None and ts - entry <= self.window:
                best[k] = entry if best[k] is None else max(best[k], entry)
        if own & 1:
            best[0] = ts

    def result(self) -> int:
        return sum(b is not None for b in self.best)


class ChainState:
    """Matches so far of conditions in order with any events between."""

    def __init__(self, conditions: list[int]):
        self.conditions, self.step, self.total = conditions, 0, 0

    def add(self, ts: int, own: int) -> None:
        if own >> self.conditions[self.step] & 1:
            self.step += 1
            if self.step == len(self.conditions):
                self.step, self.total = 0, self.total + 1

    def result(self) -> int:
        return self.total


class NextNodeState:
    """The value next to a chain of events, in the order of the search (backwards: from the last event).

    Chains that wait for the same step take the same event, so of those only the first and
    the last start are kept.
    """

    def __init__(self, steps: int, which: Base, forward: bool):
        self.steps = steps
        one = which in (Base.HEAD, Base.TAIL)
        #: Whether only the first start in this order counts, only the last, or the first or last that succeeds.
        self.only = one and ("first" if (which is Base.HEAD) == forward else "last")
        self.early = which is Base.FIRST_MATCH
        self.begun = 0
        self.waiting: list[tuple[int, int] | None] = [None] * steps  # for step k, starts that wait for it; at the end for a value
        self.best: tuple[int, str] | None = None

    def add(self, own: int, base: bool, value: str | None) -> None:
        waiting = self.waiting
        if (ended := waiting[-1]) is not None:
            waiting[-1] = None
            if value is not None:
                start = ended[0] if self.early else ended[1]
                if self.best is None or (start < self.best[0] if self.early else start > self.best[0]):
                    self.best = start, value
        for k in range(self.steps - 1, 0, -1):
            if own >> k & 1 and (moved := waiting[k - 1]) is not None:
                there = waiting[k]
                waiting[k] = moved if there is None else (min(moved[0], there[0]), max(moved[1], there[1]))
                waiting[k - 1] = None
        if base:
            self.begun += 1
            if self.only == "last":
                self.waiting, self.best = [None] * self.steps, None
            if own & 1 and not (self.only == "first" and self.begun > 1):
                there = self.waiting[0]
                self.waiting[0] = (self.begun, self.begun) if there is None else (there[0], self.begun)

    def result(self) -> str | None:
        return self.best[1] if self.best else None


def _streamed(df: DataFrame, key: list[str], ts: str, conditions, name: str, kind: T.DataType, new, order_by: str | None) -> DataFrame:
    packed = mask(args.conditions(tuple(conditions)))
    extra = [F.col(order_by).alias("__order")] if order_by else []
    rows = df.select(*key, F.col(ts).alias("__ts"), packed.alias("__mask"), *extra)
    # A row of no condition still makes a group; one of them is enough.
    used = (F.col("__mask") != 0) & F.col("__ts").isNotNull()
    empty = rows.where(~used).select(*key).distinct().select("*", F.lit(None).cast(df.schema[ts].dataType).alias("__ts"), F.lit(0).cast("long").alias("__mask"))
    if order_by:
        empty = empty.withColumn("__order", F.lit(None).cast(df.schema[order_by].dataType))
    order = [*key, "__ts", *(["__order"] if order_by else []), "__mask"]
    dealt = rows.where(used).unionByName(empty).repartition(*key).sortWithinPartitions(*order)
    return _run(dealt, df, key, name, kind, new, ("__mask",))


def _run(dealt: DataFrame, df: DataFrame, key: list[str], name: str, kind: T.DataType, new, fields: tuple[str, ...]) -> DataFrame:
    """One row a group of ``dealt``, whose groups are together: the result of a ``new()`` state that saw its rows.

    States see time and mask, or the ``fields`` that are asked for if these are several.
    """
    schema = T.StructType([*[df.schema[k] for k in key], T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        names = [*key, name]
        for batch in batches:
            done: list[tuple] = []
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(len(key))], strict=True)) if key else [()] * batch.num_rows
            times = batch.column("__ts").cast(pa.int64()).to_pylist()
            seen = zip(*[batch.column(f).to_pylist() for f in fields], strict=True)
            for own, at, what in zip(keys, times, seen, strict=True):
                if state is None or own != current:
                    if state is not None:
                        done.append((*current, state.result()))
                    current, state = own, new()
                if at is not None:
                    state.add(at, *what) if len(fields) == 1 else state.add(*what)
            if done:
                yield _batch(done, names, batch, key, kind)
            last = batch
        if state is not None:
            yield _batch([(*current, state.result())], names, last, key, kind)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], like: pa.RecordBatch, key: list[str], kind: T.DataType) -> pa.RecordBatch:
    own = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string()}[kind]
    types = [*[like.schema.field(k).type for k in range(len(key))], own]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def large_funnel(
    df: DataFrame, key: list[str], window, ts: str, *conditions,
    strict_once: bool = False, mode: str | Mode | None = None, order_by: str | None = None, name: str = "step",
) -> DataFrame:
    """``window_funnel`` by ``key``, in any mode, for groups of any size."""
    n, most = len(conditions), args.micros(args.interval(window))
    modes = args.mode(mode, "raise") | (Mode.STRICT_ONCE if strict_once else Mode.DEFAULT)
    plain = not modes & ~Mode.STRICT_ONCE
    new = (lambda: FunnelState(n, most, bool(modes))) if plain else (lambda: ModalFunnel(n, most, modes))
    return _streamed(df, key, ts, conditions, name, T.IntegerType(), new, order_by)


def large_next_node(
    df: DataFrame, key: list[str], direction: str | Direction, base: str | Base, ts: str, value: str, base_condition, *events,
    order_by: str | None = None, name: str = "node",
) -> DataFrame:
    """``sequence_next_node`` by ``key`` for groups of any size.

    A single event is followed by a window over its group, all in the JVM. Chains are run
    through in Arrow batches, backward searches from the last event.
    """
    way, which = args.option(Direction, direction, "raise"), args.option(Base, base, "raise")
    steps, forward = args.conditions(events, 1), way is Direction.FORWARD
    fields = [mask(steps).alias("__mask"), args.truth(args.column(base_condition)).alias("__base"), args.column(value).cast("string").alias("__value")]
    extra = [F.col(order_by).alias("__order")] if order_by else []
    rows = df.select(*key, F.col(ts).alias("__ts"), *extra, *fields)
    order = [F.col(c) for c in ("__ts", *(["__order"] if order_by else []), "__mask", "__value", "__base")]
    if len(steps) == 1:
        return _one_step(rows, key, order, which, forward).withColumnRenamed("__node", name)
    dealt = rows.repartition(*key).sortWithinPartitions(*key, *[c.asc() if forward else c.desc() for c in order])
    n = len(steps)
    return _run(dealt, df, key, name, T.StringType(), lambda: NextNodeState(n, which, forward), ("__mask", "__base", "__value"))


def _one_step(rows: DataFrame, key: list[str], order: list[Column], which: Base, forward: bool) -> DataFrame:
    """The value next to the first or last start of each group, or to the first or last one that has a value next to it."""
    line = Window.partitionBy(*key).orderBy(*order)
    near = (F.lead if forward else F.lag)(F.struct("__ts", "__value")).over(line)
    # Rows without a time come before all others, so they have numbers but are nobody's neighbours.
    near = F.when(near["__ts"].isNotNull() & (F.col("__mask") != 0), near["__value"])
    rows = rows.select(*key, "__ts", "__base", near.alias("__near"), F.row_number().over(line).alias("__at"))
    starts = F.col("__ts").isNotNull() & F.col("__base")
    if which in (Base.HEAD, Base.TAIL):
        first = which is Base.HEAD
    else:
        starts, first = starts & F.col("__near").isNotNull(), forward == (which is Base.FIRST_MATCH)
    pick = F.min_by if first else F.max_by
    found = pick(F.struct("__near"), F.when(starts, F.col("__at")))["__near"]
    return rows.groupBy(*key).agg(found.alias("__node"))


def large_chain_count(df: DataFrame, key: list[str], pattern: str, ts: str, *conditions, order_by: str | None = None, name: str = "matches") -> DataFrame:
    """``sequence_count`` by ``key`` of a pattern of conditions with ``.*`` between any two, for groups of any size."""
    steps = P.parse(pattern)
    if any(len(b) != 1 or b[0].condition is None or b[0].condition >= len(conditions) for b in P.blocks(steps) or [[]]):
        raise ValueError("only conditions with .* between any two can be counted in one pass")
    wanted = [b[0].condition for b in P.blocks(steps)]
    return _streamed(df, key, ts, conditions, name, T.LongType(), lambda: ChainState(wanted), order_by)
