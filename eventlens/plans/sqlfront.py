"""SQL with the event functions: calls are rewritten to built-in SQL before Spark reads the text.

``window_funnel``, ``retention``, ``sequence_match``, ``sequence_count``,
``sequence_match_events`` and ``sequence_next_node`` may stand wherever an aggregate may,
also with ``FILTER (WHERE ...)``; ``sessionize(ts, gap) OVER (...)`` may stand in the list
of a SELECT whose FROM is a table or a subquery. Strings, quoted names and comments are
left alone. Patterns, modes, directions, bases and intervals must be literals.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens import args
from eventlens.args import Base, Direction, Mode
from eventlens.functions.arrays import groups
from eventlens.functions.funnel import reached
from eventlens.functions.next_node import neighbour
from eventlens.plans import pattern as P

FUNCTIONS = ("window_funnel", "retention", "sequence_match_events", "sequence_match", "sequence_count", "sequence_next_node", "sessionize")
_OPAQUE = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_CALL = re.compile(rf"(?<![\w.])({'|'.join(FUNCTIONS)})\s*\(", re.I)
_TAIL = re.compile(r"\b(where|group\s+by|having|window|qualify|order\s+by|limit|offset|union|intersect|except)\b", re.I)


class SqlError(ValueError):
    """A call that can't be rewritten."""


def _mask(text: str) -> str:
    """The text with everything that isn't code blanked out, character for character."""
    return _OPAQUE.sub(lambda m: " " * len(m[0]), text)


def _close(code: str, at: int) -> int:
    """Index of the parenthesis that closes the one at ``at``."""
    depth = 0
    for k in range(at, len(code)):
        depth += {"(": 1, ")": -1}.get(code[k], 0)
        if not depth:
            return k
    raise SqlError(f"unclosed parenthesis at {at}")


def _split(text: str) -> list[str]:
    """The arguments of a call."""
    code, depth, parts, start = _mask(text), 0, [], 0
    for k, c in enumerate(code):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            parts.append(text[start:k].strip())
            start = k + 1
    return [*parts, text[start:].strip()] if text.strip() else []


def _literal(text: str) -> str:
    if not re.fullmatch(r"'(?:[^']|'')*'", text):
        raise SqlError(f"a string literal is needed, not {text}")
    return text[1:-1].replace("''", "'")


def _gap(length: dt.timedelta) -> str:
    return f"INTERVAL '{args.micros(length) / 1e6:.6f}' SECOND"


def _bits(conditions: list[str]) -> str:
    return " + ".join(f"CASE WHEN ({c}) THEN {1 << k}L ELSE 0L END" for k, c in enumerate(conditions))


def _collect(ts: str, fields: dict[str, str], where: str, only: str) -> str:
    inner = ", ".join(f"'{name}', {value}" for name, value in {"ts": ts, **fields}.items())
    return f"collect_list(CASE WHEN ({ts}) IS NOT NULL AND ({where}) THEN named_struct({inner}) END){only}"


def _register(spark: SparkSession, what: tuple, run: Callable, returns: str, kind: pa.DataType) -> str:
    """An Arrow function over event arrays, under a name that follows from ``what`` it does.

    The same call again has the same name, so a session has one function for each
    different pattern, mode or direction, however often it is used.
    """
    name = f"eventlens_{hashlib.blake2b(repr((*what, returns)).encode(), digest_size=12).hexdigest()}"

    def each(batch: pa.Array) -> pa.Array:
        return pa.array([run(g) for g in groups(batch)], kind)

    each.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    spark.udf.register(name, F.arrow_udf(each, returns))
    return name


def _count_checked(conditions: list[str], least: int = 2) -> list[str]:
    if not least <= len(conditions) <= 32:
        raise SqlError(f"{least} to 32 conditions are needed, not {len(conditions)}")
    return conditions


def _funnel(spark: SparkSession, given: list[str], only: str) -> str:
    length, rest, mode = args.interval(given[0]), given[1:], Mode.DEFAULT
    if rest and re.fullmatch(r"'[^']*'", rest[0]):
        mode, rest = args.mode(_literal(rest[0])), rest[1:]
    ts, steps = rest[0], _count_checked(rest[1:])
    bits, n = _bits(steps), len(steps)
    raw = _collect(ts, {"mask": bits}, f"({bits}) <> 0", only)
    if mode & ~Mode.STRICT_ONCE:
        most = args.micros(length)
        name = _register(spark, ("funnel", n, most, mode.value), lambda g: reached(g["ts"], g["mask"], n, most, mode), "int", pa.int32())
        return f"{name}(array_sort({raw}))"
    upward = "array(" + ", ".join(map(str, range(n - 1, 0, -1) if mode else range(1, n))) + ")"
    passed = f"transform(b, (v, i) -> CASE WHEN i = k THEN greatest(v, get(b, k - 1)) ELSE v END)"  # noqa: F541
    step = f"CASE WHEN get(b, k - 1) IS NOT NULL AND e.ts - get(b, k - 1) <= {_gap(length)} THEN {passed} ELSE b END"
    moved = f"aggregate(filter({upward}, k -> bit_get(e.mask, k) = 1), best, (b, k) -> {step})"
    entered = f"transform({moved}, (v, i) -> CASE WHEN i = 0 AND bit_get(e.mask, 0) = 1 THEN e.ts ELSE v END)"
    return f"CAST(size(filter(aggregate(array_sort({raw}), array_repeat(get({raw}, -1).ts, {n}), (best, e) -> {entered}), x -> x IS NOT NULL)) AS INT)"


def _retention(spark: SparkSession, given: list[str], only: str) -> str:
    ever = [f"bool_or(coalesce(({c}), false)){only}" for c in _count_checked(given)]
    return f"CASE WHEN count(1){only} = 0 THEN CAST(array() AS ARRAY<BOOLEAN>) ELSE array({ever[0]}, {', '.join(f'{ever[0]} AND {e}' for e in ever[1:])}) END"


def _sequence(kind: str):
    def rewrite(spark: SparkSession, given: list[str], only: str) -> str:
        steps = P.parse(_literal(given[0]))
        ts, conditions = given[1], _count_checked(given[2:])
        bits = _bits(conditions)
        parts, known = P.blocks(steps), [k for k in P.referenced(steps) if k < len(conditions)]
        if kind != "sequence_match_events" and parts and len(known) <= P.MOST_CODED:
            codes = "array(" + ", ".join(f"chr({ord(P.code(k))})" for k in range(1 << len(known))) + ")"
            key = _bits([conditions[k] for k in known]) or "0"
            raw = _collect(ts, {"mask": bits, "code": f"get({codes}, CAST({key} AS INT))"}, f"({bits}) <> 0", only)
            text, expression = f"array_join(transform(array_sort({raw}), e -> e.code), '')", f"R'{P.regex(parts, known, len(conditions))}'"
            found = f"{text} RLIKE {expression}" if kind == "sequence_match" else f"CAST(regexp_count({text}, {expression}) AS BIGINT)"
            return f"CASE WHEN count(1){only} > 0 THEN {found} END"
        raw = f"array_sort({_collect(ts, {'mask': bits}, f'({bits}) <> 0', only)})"
        match, what = P.Matcher(steps), (kind, steps)
        if kind == "sequence_match_events":
            name = _register(spark, what, lambda g: match.first(g["ts"], g["mask"]) or [], "array<int>", pa.list_(pa.int32()))
            return f"transform({name}({raw}), k -> get({raw}, k).ts)"
        if kind == "sequence_match":
            name = _register(spark, what, lambda g: match.first(g["ts"], g["mask"]) is not None, "boolean", pa.bool_())
        else:
            name = _register(spark, what, lambda g: match.count(g["ts"], g["mask"]), "bigint", pa.int64())
        return f"CASE WHEN count(1){only} > 0 THEN {name}({raw}) END"

    return rewrite


def _next_node(spark: SparkSession, given: list[str], only: str) -> str:
    way, base = args.option(Direction, _literal(given[0])), args.option(Base, _literal(given[1]))
    ts, value, start, steps = given[2], given[3], given[4], _count_checked(given[5:], 1)
    fields = {"mask": _bits(steps), "value": f"CAST({value} AS STRING)", "base": f"coalesce(({start}), false)"}
    rows, n = f"array_sort({_collect(ts, fields, 'true', only)})", len(steps)
    slim = f"transform({rows}, e -> named_struct('mask', e.mask, 'base', e.base, 'known', e.value IS NOT NULL))"
    name = _register(spark, ("next_node", way.value, base.value, n), lambda g: neighbour(g["mask"], g["base"], g["known"], n, way, base), "int", pa.int32())
    return f"get({rows}, {name}({slim})).value"


_REWRITES = {
    "window_funnel": _funnel, "retention": _retention, "sequence_next_node": _next_node,
    **{k: _sequence(k) for k in ("sequence_match", "sequence_count", "sequence_match_events")},
}


def _sessions(text: str, start: int, name_end: int, close: int, serial: int) -> str:
    """The SELECT around a ``sessionize`` call with its FROM wrapped to mark session breaks."""
    code = _mask(text)
    given = _split(text[name_end:close])
    over = re.match(r"\s*OVER\s*\(", code[close + 1 :], re.I)
    if len(given) != 2 or not over:
        raise SqlError("sessionize needs a timestamp, a gap, and OVER (...)")
    opening = close + over.end()
    ending = _close(code, opening)
    window = text[opening + 1 : ending].strip()
    if not re.search(r"\border\s+by\b", _mask(window), re.I):
        if re.search(r"\bfrom\b", code, re.I):
            raise SqlError("sessionize needs an ORDER BY in its window")
        return f"{text[:start]}CASE WHEN ({given[0]}) IS NOT NULL THEN 1L END{text[ending + 1 :]}"  # a single row
    depth = 0
    for k in range(ending + 1, len(code)):
        depth += (code[k] == "(") - (code[k] == ")")
        if depth < 0:
            raise SqlError("sessionize needs a FROM")
        if not depth and re.match(r"\bfrom\b", code[k:], re.I) and not code[k - 1].isalnum():
            break
    else:
        raise SqlError("sessionize needs a FROM")
    begin = k + 4
    depth, stop, filtered = 0, len(code), None
    for k in range(begin, len(code)):
        depth += (code[k] == "(") - (code[k] == ")")
        if depth < 0 or code[k] == ";":
            stop = k
            break
        if not depth and (m := _TAIL.match(code, k)) and not code[k - 1].isalnum():
            if m[1].lower() == "where" and filtered is None:
                filtered = k
            else:
                stop = k
                break
    flag = f"__session_break_{serial}"
    mark = f"CASE WHEN ({given[0]}) - lag({given[0]}) OVER ({window}) > {_gap(args.interval(given[1]))} THEN 1L ELSE 0L END AS {flag}"
    source = f"\n(SELECT *, {mark} FROM {text[begin:stop]})\n"
    call = f"CASE WHEN ({given[0]}) IS NOT NULL THEN 1L + sum({flag}) OVER ({window} ROWS UNBOUNDED PRECEDING) END"
    return text[:start] + call + text[ending + 1 : begin] + source + text[stop:]


def rewrite(spark: SparkSession, text: str) -> str:
    """The text with all calls replaced."""
    serial = 0
    while True:
        code = _mask(text)
        calls = list(_CALL.finditer(code))
        if not calls:
            return text
        call = calls[-1]  # the last one holds no other
        name, opening = call[1].lower(), call.end() - 1
        close = _close(code, opening)
        if name == "sessionize":
            serial += 1
            text = _sessions(text, call.start(), opening + 1, close, serial)
            continue
        end, only = close + 1, ""
        if m := re.match(r"\s*FILTER\s*\(", code[end:], re.I):
            end = _close(code, end + m.end() - 1) + 1
            only = " " + text[close + 1 : end].strip()
        given = _split(text[opening + 1 : close])
        text = text[: call.start()] + "(" + _REWRITES[name](spark, given, only) + ")" + text[end:]


def sql(spark: SparkSession, text: str) -> DataFrame:
    """The result of a query that may call the event functions."""
    return spark.sql(rewrite(spark, text))
