"""Flow analysis: the value of the event next to a chain of matched events."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens import args
from eventlens.args import Base, Direction
from eventlens.functions.arrays import Group, over_groups
from eventlens.functions.events import collected, mask


def neighbour(masks, base, known, steps: int, direction: Direction, which: Base) -> int | None:
    """Index of the event whose value is asked for, or None.

    ``known`` tells whether an event's value is not null. Starts are events of the base
    condition; the first step must hold at the start, the others are taken greedily.
    """
    forward = direction is Direction.FORWARD
    starts = np.flatnonzero(base).tolist()
    if not starts:
        return None
    if which in (Base.HEAD, Base.TAIL):
        starts = [starts[0 if which is Base.HEAD else -1]]
    elif forward != (which is Base.FIRST_MATCH):
        starts.reverse()  # the last result in one order is the first in the other
    where = [np.flatnonzero(masks >> k & 1).tolist() for k in range(1, steps)]
    for start in starts:
        if not masks[start] & 1:
            continue
        at: int | None = start
        for places in where:
            k = bisect_right(places, at) if forward else bisect_left(places, at) - 1
            if not 0 <= k < len(places):
                at = None
                break
            at = places[k]
        if at is not None:
            at += 1 if forward else -1
            if 0 <= at < len(masks) and known[at]:
                return at
    return None


def sequence_next_node(
    direction: str | Direction, base: str | Base, ts: args.ColumnLike, value: args.ColumnLike, base_condition: args.ColumnLike,
    *events: args.ColumnLike, order_by: args.ColumnLike | None = None, on_error: str = "raise",
) -> Column:
    """Value of the event after (forward) or before (backward) a chain of events, as a string.

    ``head`` and ``tail`` try the first and the last event of the base condition only;
    ``first_match`` and ``last_match`` try all of them, in the direction of the search and
    against it, until one yields a value. Null without a match, a neighbour or a value.
    All rows with a timestamp take part, whether they satisfy a condition or not. The chain
    is followed in an Arrow function that sees conditions only; values stay in the JVM.
    """
    way, which = args.option(Direction, direction, on_error), args.option(Base, base, on_error)
    steps = args.conditions(events, 1)
    fields = [mask(steps).alias("mask"), args.column(value).cast("string").alias("value"), args.truth(base_condition).alias("base")]
    rows = F.array_sort(collected(ts, fields, F.lit(True), order_by))
    n = len(steps)
    slim = F.transform(rows, lambda e: F.struct(e["mask"].alias("mask"), e["base"].alias("base"), e["value"].isNotNull().alias("known")))

    def run(g: Group):
        return neighbour(g["mask"], g["base"], g["known"], n, way, which)

    return F.get(rows, over_groups(run, "int", slim))["value"]
