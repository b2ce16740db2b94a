"""Arguments of the event functions, checked on the driver."""

from __future__ import annotations

import datetime as dt
import re
from enum import Enum, IntFlag

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str
#: Names and microseconds of the units an interval text may use. Months have no fixed length.
UNITS = {
    "microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
    "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000,
}


def column(c: ColumnLike) -> Column:
    """A column as it is, or from its name or a SQL expression."""
    return F.expr(c) if isinstance(c, str) else c


def truth(c: ColumnLike) -> Column:
    """A condition with null as false."""
    return F.coalesce(column(c), F.lit(False))


def conditions(given: tuple[ColumnLike, ...], least: int = 2, most: int = 32) -> list[Column]:
    """The conditions as columns; their number is checked."""
    if not least <= len(given) <= most:
        raise ValueError(f"{least} to {most} conditions are needed, not {len(given)}")
    return [column(c) for c in given]


def interval(given: dt.timedelta | str | int, on_error: str = "raise") -> dt.timedelta:
    """An interval from a timedelta, a text like ``'1 day 30 minutes'`` or ``'01:30:00'``, or microseconds.

    Months and years have no fixed length: they are an error, or with ``on_error='null'``
    an interval of zero.
    """
    if isinstance(given, dt.timedelta):
        return given
    if isinstance(given, int):
        return dt.timedelta(microseconds=given)
    text = re.sub(r"(?i)^\s*interval\b|['\"]", " ", given).strip().lower()
    total, rest = 0, text
    if clock := re.fullmatch(r"(\d+):(\d\d):(\d\d)(?:\.(\d{1,6}))?", text):
        h, m, s, part = clock.groups()
        return dt.timedelta(hours=int(h), minutes=int(m), seconds=int(s), microseconds=int((part or "").ljust(6, "0")))
    for number, unit in re.findall(r"(-?\d+)\s*([a-z]+?)s?\b", text):
        if unit not in UNITS:
            if on_error == "null" and unit in ("month", "year", "quarter"):
                return dt.timedelta(0)
            raise ValueError(f"no fixed length: {given!r}")
        total += int(number) * UNITS[unit]
    rest = re.sub(r"-?\d+\s*[a-z]+", "", rest).strip()
    if rest or not text:
        raise ValueError(f"not an interval: {given!r}")
    return dt.timedelta(microseconds=total)


def micros(given: dt.timedelta) -> int:
    """An interval in microseconds."""
    return given // dt.timedelta(microseconds=1)


class Mode(IntFlag):
    """Strictness of a funnel; modes combine."""

    DEFAULT = 0
    STRICT = 1
    STRICT_DEDUPLICATION = 1
    STRICT_ORDER = 2
    TIMESTAMP_DEDUP = 4
    STRICT_INCREASE = 8
    STRICT_ONCE = 16
    ALLOW_REENTRY = 32


_MODES = {name.lower(): mode for name, mode in Mode.__members__.items() if mode}


def mode(given: str | Mode | None, on_error: str = "raise") -> Mode:
    """Modes from a comma-separated list of lower-case names; empty names are passed over.

    An unknown name is an error; with ``on_error='null'`` the whole list counts as empty.
    """
    if isinstance(given, Mode):
        return given
    found = Mode.DEFAULT
    for name in filter(None, (x.strip() for x in (given or "").split(","))):
        if name not in _MODES:
            if on_error == "null":
                return Mode.DEFAULT
            raise ValueError(f"unknown mode {name!r}; known are {', '.join(sorted(_MODES))}")
        found |= _MODES[name]
    return found


class Direction(Enum):
    FORWARD = "forward"
    BACKWARD = "backward"


class Base(Enum):
    HEAD = "head"
    TAIL = "tail"
    FIRST_MATCH = "first_match"
    LAST_MATCH = "last_match"


def option(kind: type[Enum], given, on_error: str = "raise"):
    """A direction or base from its name, in any case; unknown ones raise or become the default."""
    if isinstance(given, kind):
        return given
    try:
        return kind((given or "").strip().lower())
    except ValueError:
        if on_error == "null":
            return {Direction: Direction.FORWARD, Base: Base.FIRST_MATCH}[kind]
        raise
