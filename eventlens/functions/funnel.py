"""Conversion funnels: how many steps in order a group reached within a window."""

from __future__ import annotations

import datetime as dt
from heapq import heappop, heappush

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens import args
from eventlens.args import Mode
from eventlens.functions.arrays import Group, over_groups
from eventlens.functions.events import matching


def _fold(found: Column, events: Column, steps: int, window: dt.timedelta, once: bool) -> Column:
    """Steps reached, as one fold over the sorted events.

    The state holds, for each step, the latest entry time of any chain that reached it:
    a later entry leaves at least as much of the window, so no other need be kept. An
    event passes the entry of step k-1 on to step k, upwards so that it may climb several
    steps, or downwards if it may climb one only; it becomes an entry itself at last.
    """
    none = F.get(found, F.lit(-1))["ts"]
    upward = F.array(*[F.lit(k) for k in (range(steps - 1, 0, -1) if once else range(1, steps))])
    fires = lambda event, k: F.call_function("bit_get", event["mask"], k) == 1

    def pass_on(event: Column):
        def step(best: Column, k: Column) -> Column:
            entry = F.get(best, k - 1)
            kept = entry.isNotNull() & (event["ts"] - entry <= F.lit(window))
            return F.when(kept, F.transform(best, lambda v, i: F.when(i == k, F.greatest(v, entry)).otherwise(v))).otherwise(best)

        return step

    def one(best: Column, event: Column) -> Column:
        moved = F.aggregate(F.filter(upward, lambda k: fires(event, k)), best, pass_on(event))
        entered = lambda v, i: F.when(i == 0, event["ts"]).otherwise(v)
        return F.when(fires(event, F.lit(0)), F.transform(moved, entered)).otherwise(moved)

    best = F.aggregate(events, F.array_repeat(none, steps), one)
    return F.size(F.filter(best, lambda v: v.isNotNull()))


class ModalFunnel:
    """Steps reached by the best chain, event by event, under any modes.

    What a chain does next depends on its step and on whether it moved at this very time,
    not on where it began. So chains that agree on both are one, of which the latest entry
    lasts longest. With ``allow_reentry`` a chain that ends early may end higher than one
    that lasts; there the entries of a chain are kept in a heap until they leave the
    window. Events come sorted.
    """

    def __init__(self, steps: int, window: int, mode: Mode = Mode.DEFAULT):
        self.steps, self.window, self.best = steps, window, 0
        self.strict, self.order = bool(mode & Mode.STRICT), bool(mode & Mode.STRICT_ORDER)
        self.rising = bool(mode & (Mode.TIMESTAMP_DEDUP | Mode.STRICT_INCREASE))
        self.once, self.again = bool(mode & Mode.STRICT_ONCE), bool(mode & Mode.ALLOW_REENTRY)
        # (step, time of the last move if that matters now) to the latest entry, or to the heap of all
        self.chains: dict[tuple[int, int | None], int | list[int]] = {}

    def _put(self, chains: dict, key: tuple[int, int | None], held: int | list[int]) -> None:
        known = chains.get(key)
        if known is None:
            chains[key] = held
        elif self.again:
            large, small = (known, held) if len(known) >= len(held) else (held, known)
            for entry in small:
                heappush(large, entry)
            chains[key] = large
        else:
            chains[key] = max(known, held)

    def add(self, now: int, own: int) -> None:
        if self.best == self.steps:
            return
        chains: dict[tuple[int, int | None], int | list[int]] = {}
        for (step, moved), held in self.chains.items():
            if self.again:
                if now - held[0] > self.window:
                    self.best = max(self.best, step)
                    while held and now - held[0] > self.window:
                        heappop(held)
                if not held:
                    continue
            elif now - held > self.window:
                continue
            advances = own >> step & 1
            if self.again and step > 1 and own & 1:
                step, moved = 1, now
            elif self.strict and own >> (step - 1) & 1 and not advances or self.order and own & ((1 << step) - 1):
                self.best = max(self.best, step)
                continue
            elif advances and not (self.rising and moved == now):
                step, moved = step + 1, now
                while not self.once and step < self.steps and own >> step & 1:
                    step += 1
                if step == self.steps or not self.again:
                    self.best = max(self.best, step)
                if step == self.steps:
                    return
            self._put(chains, (step, moved if self.rising and moved == now else None), held)
        if own & 1:
            if not self.again:
                self.best = max(self.best, 1)
            self._put(chains, (1, now if self.rising else None), [now] if self.again else now)
        self.chains = chains

    def result(self) -> int:
        return max([self.best, *(step for step, _ in self.chains)])


def reached(times, masks, steps: int, window: int, mode: Mode) -> int:
    """Steps reached by the best entry among sorted events under ``mode``."""
    state = ModalFunnel(steps, window, mode)
    for now, own in zip(times.tolist(), masks.tolist(), strict=True):
        state.add(now, own)
    return state.result()


def window_funnel(
    window: dt.timedelta | str | int, ts: args.ColumnLike, *conditions: args.ColumnLike,
    mode: str | Mode | None = None, order_by: args.ColumnLike | None = None, on_error: str = "raise",
) -> Column:
    """Steps (0 to the number of conditions) that the group reached, as an integer aggregate.

    A chain starts at an event of the first condition and takes later events, each no
    more than ``window`` after the start. A later event that satisfies several of the next
    conditions climbs as many steps. Rows without a timestamp are passed over, null
    conditions are false, events of no condition are dropped before the shuffle; groups
    without an entry have 0. Without a mode, or with ``strict_once`` alone, all is built-in
    expressions; other modes run through the events once in an Arrow function.
    """
    steps = args.conditions(conditions)
    length, modes = args.interval(window, on_error), args.mode(mode, on_error)
    found, events = matching(ts, steps, order_by)
    if not modes & ~Mode.STRICT_ONCE:
        return _fold(found, events, len(steps), length, bool(modes)).cast("int")
    n, most = len(steps), args.micros(length)
    return over_groups(lambda g: reached(g["ts"], g["mask"], n, most, modes), "int", events)
