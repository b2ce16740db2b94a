"""The sequence pattern language: parsed on the driver, turned into a matching strategy.

``(?N)`` takes an event of condition N, ``.`` any event, ``.*`` as few events as needed,
and ``(?t>=n)`` (also ``<= > < == !=``) tests the whole seconds from the last event taken
to the next one. Blanks may stand between steps.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

#: Conditions that one character of an encoded sequence may tell apart.
MOST_CODED = 8


class PatternError(ValueError):
    """A pattern that can't be read, with the position of what is wrong."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at {position}")
        self.message, self.position = message, position


@dataclass(frozen=True)
class Take:
    """An event of a condition (from 0), or any event if it is None."""

    condition: int | None


@dataclass(frozen=True)
class Skip:
    """As few events as needed, maybe none."""


@dataclass(frozen=True)
class Wait:
    """A test of the whole seconds from the last taken event to the next one."""

    test: str
    seconds: int


Step = Take | Skip | Wait
_TOKEN = re.compile(r"(?P<blank>\s+)|(?P<skip>\.\*)|(?P<any>\.)|\(\?(?P<take>\d+)\)|\(\?t(?P<test>>=|<=|==|!=|>|<)(?P<n>\d+)\)")


def parse(pattern: str) -> list[Step]:
    """The steps of a pattern."""
    steps: list[Step] = []
    at = 0
    while at < len(pattern):
        found = _TOKEN.match(pattern, at)
        if not found:
            raise PatternError(_trouble(pattern, at), at)
        if found["skip"]:
            steps.append(Skip())
        elif found["any"]:
            steps.append(Take(None))
        elif found["take"]:
            if not int(found["take"]):
                raise PatternError("conditions count from 1", at)
            steps.append(Take(int(found["take"]) - 1))
        elif found["test"]:
            if int(found["n"]) >= 1 << 63:
                raise PatternError("too many seconds", at)
            steps.append(Wait(found["test"], int(found["n"])))
        at = found.end()
    if not steps:
        raise PatternError("empty pattern", 0)
    return steps


def _trouble(pattern: str, at: int) -> str:
    rest = pattern[at:]
    if not rest.startswith("(?"):
        return f"unexpected {rest[0]!r}"
    if ")" not in rest:
        return "unclosed step"
    if rest.startswith("(?t"):
        return "a test needs >=, <=, ==, !=, > or < and a number"
    return "a step needs a number or a test"


def blocks(steps: list[Step]) -> list[list[Take]] | None:
    """Runs of neighbouring events between skips, or None if time is tested."""
    if any(isinstance(s, Wait) for s in steps):
        return None
    found: list[list[Take]] = [[]]
    for s in steps:
        if isinstance(s, Skip):
            found.append([])
        else:
            found[-1].append(s)
    return [b for b in found if b]


def as_wildcards(steps: list[Step]) -> list[Step]:
    """Conditions with a skip between any two, if there is any skip among conditions only."""
    if any(isinstance(s, Skip) for s in steps) and all(isinstance(s, Skip) or isinstance(s, Take) and s.condition is not None for s in steps):
        taken = [s for s in steps if isinstance(s, Take)]
        return [x for s in taken for x in (s, Skip())][:-1] or steps
    return steps


def referenced(steps: list[Step]) -> list[int]:
    """The conditions that the pattern mentions, in order."""
    return sorted({s.condition for s in steps if isinstance(s, Take) and s.condition is not None})


def code(key: int) -> str:
    """The character of an event that satisfies the referenced conditions in ``key``."""
    return chr(0x30 + key)


def regex(parts: list[list[Take]], known: list[int], arity: int) -> str:
    """A regular expression that finds the blocks in order, from where the last match ended.

    Skips take no more than they must, so once the first place of a block is found, going
    back to try another can't help: atomic groups say so, and the search stays linear.
    """

    def one(step: Take) -> str:
        if step.condition is None:
            return r"[\s\S]"
        if step.condition >= arity:
            return "(?!)"
        bit = known.index(step.condition)
        return "[" + "".join(f"\\x{{{ord(code(k)):x}}}" for k in range(1 << len(known)) if k >> bit & 1) + "]"

    return r"\G" + "".join(rf"(?>[\s\S]*?{''.join(map(one, block))})" for block in parts)


@dataclass(frozen=True)
class Gap:
    """What stands between two takes, before the first or after the last one."""

    now: tuple[Wait, ...]  # tests of the very next event
    far: tuple[tuple[Wait, ...], ...]  # tests of an event after a skip, for each skip


def gaps(steps: list[Step]) -> tuple[list[Take], list[Gap]]:
    """The takes of a pattern, and the gaps around them, one more than takes."""
    takes: list[Take] = []
    open_: list[list[list[Wait]]] = [[[]]]
    for s in steps:
        if isinstance(s, Take):
            takes.append(s)
            open_.append([[]])
        elif isinstance(s, Skip):
            open_[-1].append([])
        else:
            open_[-1][-1].append(s)
    return takes, [Gap(tuple(g[0]), tuple(map(tuple, g[1:]))) for g in open_]


def spans(waits: tuple[Wait, ...]) -> list[tuple[int, int]]:
    """The microseconds, as rising half-open ranges, that pass all of the tests."""
    end, second = 1 << 62, 1_000_000
    found = [(0, end)]
    for w in waits:
        n, m = min(w.seconds * second, end), min((w.seconds + 1) * second, end)
        own = {">=": [(n, end)], ">": [(m, end)], "<=": [(0, m)], "<": [(0, n)], "==": [(n, m)], "!=": [(0, n), (m, end)]}[w.test]
        found = [(max(a, c), min(b, d)) for a, b in found for c, d in own if max(a, c) < min(b, d)]
    return found


class Matcher:
    """The leftmost matches of a pattern, each skipping as little as possible.

    From the last take to the first it is computed for all events at once whether the
    rest of the pattern can follow, and with which next event. Times rise, so a test of
    elapsed time allows ranges of events, whose ends are found by binary search. Both
    time and memory are proportional to events times takes.
    """

    def __init__(self, steps: list[Step]):
        self.takes, self.gaps = gaps(steps)
        self.spans = [(spans(g.now), [spans(w) for w in g.far]) for g in self.gaps]

    def _follow(self, k: int, times: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """For each event, taken as the one before gap ``k``, the next event, or n.

        ``fits`` is, for each event, whether it may be the next one; it has one more than
        there are events, so that an end after the last event can be told from none.
        """
        n, gap = len(times), self.gaps[k]
        now, far = self.spans[k]
        place = np.arange(n + 2)
        following = np.minimum.accumulate(np.where(np.append(fits, False), place, n + 1)[::-1])[::-1]
        at = np.arange(1, n + 1)
        good = np.ones(n, bool)
        if gap.now:
            good = at < n
            took = np.append(times, 0)[at] - times
            good &= np.logical_or.reduce([(took >= a) & (took < b) for a, b in now]) if now else False
        if not gap.far:
            return np.where(good & np.append(fits, False)[at], at, n + 1)
        for j, ranges in enumerate(far):
            last, tested = j == len(far) - 1, bool(gap.far[j])
            found = np.full(n, n + 1)
            for a, b in ranges[::-1]:  # the first range that works wins
                low = np.maximum(at, np.searchsorted(times, times + a, "left") if tested else 0)
                high = np.searchsorted(times, times + b, "left") if tested else n + 1
                event = following[np.minimum(low, n + 1)] if last else low
                found = np.where(event < high, event, found)
            good &= found <= n
            at = np.where(good, found, n + 1)
        return np.where(good, at, n + 1)

    def _tables(self, times: np.ndarray, masks: np.ndarray) -> tuple[list[int], list[list[int]]]:
        """The first event to take from each start, and from each event of a take the one of the next."""
        n = len(times)
        jumps: list[list[int]] = []
        fits = np.ones(n + 1, bool)  # after the last take any place will do
        for k in range(len(self.takes), 0, -1):
            step = self.takes[k - 1].condition
            able = np.ones(n, bool) if step is None else (masks >> step & 1).astype(bool) if step < 63 else np.zeros(n, bool)
            jump = self._follow(k, times, fits)
            fits = np.append(able & (jump <= n), False)
            jumps.append(jump.tolist())
        starts = np.minimum.accumulate(np.where(fits, np.arange(n + 1), n)[::-1])[::-1]
        return starts.tolist(), jumps[::-1][:-1]

    def first(self, times: np.ndarray, masks: np.ndarray) -> list[int] | None:
        """The events that conditions took in the leftmost match."""
        if not len(times):
            return None
        if not self.takes:
            return []
        starts, jumps = self._tables(times, masks)
        at = starts[0]
        if at == len(times):
            return None
        taken = [at]
        for jump in jumps:
            taken.append(jump[taken[-1]])
        return [e for e, step in zip(taken, self.takes, strict=True) if step.condition is not None]

    def count(self, times: np.ndarray, masks: np.ndarray) -> int:
        """Leftmost matches that don't overlap; one that takes no event moves on by one."""
        n = len(times)
        if not n or not self.takes:
            return n
        starts, jumps = self._tables(times, masks)
        total = start = 0
        while start < n and (at := starts[start]) < n:
            for jump in jumps:
                at = jump[at]
            total, start = total + 1, at + 1
        return total


def first_match(steps: list[Step], times, masks) -> list[int] | None:
    """The events that conditions took in the leftmost match."""
    return Matcher(steps).first(np.asarray(times, np.int64), np.asarray(masks, np.int64))


def count_matches(steps: list[Step], times, masks) -> int:
    """Leftmost matches that don't overlap."""
    return Matcher(steps).count(np.asarray(times, np.int64), np.asarray(masks, np.int64))
