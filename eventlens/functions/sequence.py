"""Event sequences: does a pattern occur, how often, and when were its events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens import args
from eventlens.functions.arrays import Group, over_groups
from eventlens.functions.events import collected, mask, matching, no_rows
from eventlens.plans import pattern as P


def _steps(pattern: str, on_error: str, compat: str | None) -> list[P.Step] | None:
    if compat not in (None, "reference"):
        raise ValueError(f"unknown compat {compat!r}")
    try:
        steps = P.parse(pattern)
    except P.PatternError:
        if on_error == "null":
            return None
        raise
    return P.as_wildcards(steps) if compat else steps


def _coded(ts, conditions: list[Column], known: list[int], order_by) -> Column:
    """The group's events as a string, a character each, in order; empty without events."""
    key = mask([conditions[k] for k in known if k < len(conditions)])
    characters = F.array(*[F.lit(P.code(k)) for k in range(1 << len(known))])
    packed = mask(conditions)
    fields = [packed.alias("mask"), F.get(characters, key.cast("int")).alias("code")]
    events = F.array_sort(collected(ts, fields, packed != 0, order_by))
    return F.array_join(F.transform(events, lambda e: e["code"]), "")


def _sequence(pattern, ts, conditions, order_by, on_error, compat, counts: bool) -> Column:
    given, kind = args.conditions(conditions), "bigint" if counts else "boolean"
    steps = _steps(pattern, on_error, compat)
    if steps is None:
        return F.max(F.lit(None)).cast(kind)
    parts, known = P.blocks(steps), [k for k in P.referenced(steps) if k < len(given)]
    if parts is None or len(known) > P.MOST_CODED:
        _, events = matching(ts, given, order_by)

        match = P.Matcher(steps)

        def run(g: Group):
            return match.count(g["ts"], g["mask"]) if counts else match.first(g["ts"], g["mask"]) is not None

        found = over_groups(run, kind, events)
    elif not parts:  # nothing but skips: every event is a match of its own
        _, events = matching(ts, given, order_by)
        found = F.size(events).cast("bigint") if counts else F.size(events) > 0
    else:
        text, expression = _coded(ts, given, known, order_by), P.regex(parts, known, len(given))
        found = F.regexp_count(text, F.lit(expression)).cast("bigint") if counts else text.rlike(expression)
    return F.when(~no_rows(), found)


def sequence_match(pattern: str, ts: args.ColumnLike, *conditions: args.ColumnLike, order_by=None, on_error="raise", compat=None) -> Column:
    """True if the pattern occurs among the group's events that satisfy any condition.

    Null without rows; an invalid pattern raises, or gives null with ``on_error='null'``.
    Patterns without time tests are one linear regular expression over the encoded events;
    others are matched in an Arrow function, in time proportional to events times steps.
    """
    return _sequence(pattern, ts, conditions, order_by, on_error, compat, counts=False)


def sequence_count(pattern: str, ts: args.ColumnLike, *conditions: args.ColumnLike, order_by=None, on_error="raise", compat=None) -> Column:
    """How often the pattern occurs, leftmost first and without overlap."""
    return _sequence(pattern, ts, conditions, order_by, on_error, compat, counts=True)


def sequence_match_events(pattern: str, ts: args.ColumnLike, *conditions: args.ColumnLike, order_by=None, on_error="raise") -> Column:
    """Timestamps of the events that the conditions of the first match took; empty without one."""
    given = args.conditions(conditions)
    steps = _steps(pattern, on_error, None)
    _, events = matching(ts, given, order_by)
    if steps is None:
        return F.transform(F.slice(events, 1, 0), lambda e: e["ts"])
    match = P.Matcher(steps)
    taken = over_groups(lambda g: match.first(g["ts"], g["mask"]) or [], "array<int>", events)
    return F.transform(taken, lambda k: F.get(events, k)["ts"])
