"""Plain Python models of the event functions, written from their description alone."""

import itertools
import re


def funnel(events, steps, window, modes=frozenset()):
    """events: (time, set of conditions from 0), sorted; only those of any condition count."""
    events = [e for e in events if e[1]]
    best = 0
    for i, (start, own) in enumerate(events):
        if 0 not in own:
            continue
        done, prev = 1, start
        for t, cs in events[i + 1 :]:
            if t - start > window:
                break
            nxt = done in cs
            if "allow_reentry" in modes and done > 1 and 0 in cs:
                done, prev = 1, t
                continue
            if "strict" in modes and (done - 1) in cs and not nxt:
                break
            if "strict_order" in modes and any(c < done for c in cs):
                break
            if "timestamp_dedup" in modes and t == prev and nxt:
                continue
            if "strict_increase" in modes and t <= prev and nxt:
                continue
            while done < steps and done in cs:
                done += 1
                prev = t
                if "strict_once" in modes:
                    break
            if done == steps:
                return steps
        best = max(best, done)
    return best


def tokens(pattern):
    return re.findall(r"\.\*|\.|\(\?\d+\)|\(\?t(?:>=|<=|==|!=|>|<)\d+\)", pattern)


def matches(pattern, events, at, last=None):
    """All ways to match from event ``at``, laziest first: lists of (event, by condition)."""
    if not pattern:
        yield []
        return
    head, rest = pattern[0], pattern[1:]
    if head == ".*":
        for k in range(at, len(events) + 1):
            yield from matches(rest, events, k, last)
    elif head.startswith("(?t"):
        op, n = re.fullmatch(r"\(\?t(>=|<=|==|!=|>|<)(\d+)\)", head).groups()
        if at < len(events):
            d = None if last is None else (events[at][0] - events[last][0]) // 1_000_000
            n = int(n)
            ok = last is None or {">=": d >= n, "<=": d <= n, "==": d == n, "!=": d != n, ">": d > n, "<": d < n}[op]
            if ok:
                yield from matches(rest, events, at, last)
    elif at < len(events) and (head == "." or int(head[2:-1]) - 1 in events[at][1]):
        for more in matches(rest, events, at + 1, at):
            yield [(at, head != "."), *more]


def first_match(pattern, events):
    events = [e for e in events if e[1]]
    for s in range(len(events)):
        for m in matches(tokens(pattern), events, s):
            return [events[k][0] for k, taken in m if taken]
    return None


def count(pattern, events):
    events = [e for e in events if e[1]]
    s = n = 0
    while s < len(events):
        m = next(matches(tokens(pattern), events, s), None)
        if m is None:
            s += 1
        else:
            n += 1
            s = m[-1][0] + 1 if m else s + 1
    return n


def next_node(direction, base, events, steps):
    """events: (time, conditions, value, base), sorted."""
    starts = [k for k, e in enumerate(events) if e[3]]
    if not starts:
        return None
    sign = 1 if direction == "forward" else -1

    def result(k):
        if 0 not in events[k][1]:
            return None
        for c in range(1, steps):
            k = next((j for j in (range(k + 1, len(events)) if sign > 0 else range(k - 1, -1, -1)) if c in events[j][1]), None)
            if k is None:
                return None
        k += sign
        return events[k][2] if 0 <= k < len(events) else None

    if base == "head":
        return result(starts[0])
    if base == "tail":
        return result(starts[-1])
    order = starts if sign > 0 else starts[::-1]
    found = [r for r in map(result, order) if r is not None]
    return (found[0] if base == "first_match" else found[-1]) if found else None


def sessions(times, gap):
    """Session numbers of sorted times, None for None."""
    out, n, prev = [], 1, None
    for t in times:
        if t is None:
            out.append(None)
            continue
        if prev is not None and t - prev > gap:
            n += 1
        prev = t
        out.append(n)
    return out


MODES = ["strict", "strict_order", "timestamp_dedup", "strict_increase", "strict_once", "allow_reentry"]
MODE_SETS = [frozenset(s) for n in range(7) for s in itertools.combinations(MODES, n)]
