"""Sessions and funnels over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventlens import args
from eventlens.functions.events import mask
from eventlens.operators.streamed import FunnelState


def session_totals(stream: DataFrame, key: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """``key, started_at, closes_at, events`` of each session, when no event can join it any more.

    ``closes_at`` is the last event's time and the gap. ``late`` is how far an event may
    lie behind the latest one seen; what is later still is dropped.
    """
    seconds = args.micros(args.interval(gap)) / 1e6
    window = F.session_window(F.col(ts), f"{seconds:.6f} seconds")
    totals = stream.withWatermark(ts, late).groupBy(*key, window.alias("session")).agg(F.count("*").alias("events"))
    return totals.select(*key, F.col("session.start").alias("started_at"), F.col("session.end").alias("closes_at"), "events")


def funnel_progress(stream: DataFrame, key: str, ts: str, window: str, *conditions: args.ColumnLike, late: str = "1 hour", forget: str = "1 day") -> DataFrame:
    """``key, step`` of each user whose furthest step changes in a batch.

    The state of a user is a number a step. Events of a batch are put in order; an event
    that comes after later ones of an earlier batch counts as one at the time of the last
    of them. A user without events for ``forget`` is forgotten.
    """
    steps = args.conditions(conditions)
    n, most, keep = len(steps), args.micros(args.interval(window)), args.micros(args.interval(forget)) // 1000
    kind = dict(stream.dtypes)[key]
    rows = stream.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), mask(steps).alias("mask"))
    rows = rows.withWatermark("ts", late).where("mask <> 0")

    def update(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        reached = FunnelState(n, most)
        last = before = 0
        if state.exists:
            best, last = state.get
            reached.best = [None if b < 0 else b for b in best]
            before = reached.result()
        events = pd.concat(list(parts)).sort_values(["ts", "mask"])
        for at, bits in zip(events.ts.astype("datetime64[us]").astype("int64"), events["mask"], strict=True):
            last = max(last, int(at))
            reached.add(last, int(bits))
        state.update(([-1 if b is None else b for b in reached.best], last))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + keep)
        if reached.result() != before:
            yield pd.DataFrame({"key": [own[0]], "step": [reached.result()]})

    out = rows.groupBy("key").applyInPandasWithState(update, f"key {kind}, step int", "best array<bigint>, last bigint", "update", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("key", key)
