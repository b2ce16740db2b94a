"""Properties of the matchers and scans, without a session."""

import time

import models
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from eventlens.args import Base, Direction, Mode
from eventlens.functions.funnel import reached
from eventlens.functions.next_node import neighbour
from eventlens.operators.streamed import ChainState, FunnelState, NextNodeState
from eventlens.plans import pattern as P

SECOND = 1_000_000
event = st.tuples(st.integers(0, 8 * SECOND // 2), st.sets(st.integers(0, 3), min_size=1))
step = st.sampled_from(["(?1)", "(?2)", "(?3)", "(?4)", ".", ".*", "(?t>=1)", "(?t<=2)", "(?t>0)", "(?t<3)", "(?t==1)", "(?t!=0)"])


def mask(conditions):
    return sum(1 << k for k in conditions)


def ordered(events):
    return sorted(events, key=lambda e: (e[0], mask(e[1])))


def arrays(events):
    return np.array([t for t, *_ in events], np.int64), np.array([mask(e[1]) for e in events], np.int64)


@settings(max_examples=400, deadline=None)
@given(st.lists(event, max_size=9), st.lists(step, min_size=1, max_size=5))
def test_patterns(events, steps):
    events, pattern = ordered(events), "".join(steps)
    times, masks = (a.tolist() for a in arrays(events))
    parsed = P.parse(pattern)
    n = P.count_matches(parsed, times, masks)
    assert n == models.count(pattern, events)
    first = P.first_match(parsed, times, masks)
    assert (first is not None) == (n >= 1)
    assert (None if first is None else [times[k] for k in first]) == models.first_match(pattern, events)


@settings(max_examples=300, deadline=None)
@given(st.lists(event, max_size=10), st.integers(0, 4 * SECOND), st.sets(st.sampled_from(models.MODES)))
def test_funnels(events, window, modes):
    events = ordered(events)
    mode = Mode(sum(Mode[m.upper()] for m in modes))
    found = reached(*arrays(events), 4, window, mode)
    assert found == models.funnel(events, 4, window, modes) and 0 <= found <= 4
    if not modes:
        assert found <= reached(*arrays(events), 4, window + SECOND, mode)
        more = ordered([*events, (SECOND, {0, 1})])
        assert found <= reached(*arrays(more), 4, window, mode)
    if modes <= {"strict_once"}:
        state = FunnelState(4, window, bool(modes))
        for t, m in zip(*(a.tolist() for a in arrays(events)), strict=True):
            state.add(t, m)
        assert state.result() == found


@settings(max_examples=200, deadline=None)
@given(st.lists(event, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=3))
def test_chains(events, wanted):
    events = ordered(events)
    state = ChainState(wanted)
    for t, m in zip(*(a.tolist() for a in arrays(events)), strict=True):
        state.add(t, m)
    assert state.result() == models.count(".*".join(f"(?{k + 1})" for k in wanted), events)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.sets(st.integers(0, 2)), st.sampled_from(["a", "b", None]), st.booleans()), max_size=10), st.integers(1, 3))
def test_neighbours(events, steps):
    events = [(t, {c for c in cs if c < steps}, v, b) for t, cs, v, b in events]
    masks = np.array([mask(e[1]) for e in events], np.int64)
    base, known = (np.array(x, bool) for x in ([e[3] for e in events], [e[2] is not None for e in events]))
    for way in Direction:
        for which in Base:
            k = neighbour(masks, base, known, steps, way, which)
            assert (None if k is None else events[k][2]) == models.next_node(way.value, which.value, events, steps)


@settings(max_examples=200, deadline=None)
@given(st.text("(?t.*)<>=!0123 x", max_size=12))
def test_parser_reads_or_tells_where(text):
    try:
        steps = P.parse(text)
    except P.PatternError as e:
        assert 0 <= e.position <= len(text)
    else:
        assert steps


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.sets(st.integers(0, 2)), st.sampled_from(["a", "b", None]), st.booleans()), max_size=10), st.integers(1, 3))
def test_streamed_neighbours(events, steps):
    events = [(t, {c for c in cs if c < steps}, v, b) for t, cs, v, b in events]
    for way in Direction:
        for which in Base:
            state = NextNodeState(steps, which, way is Direction.FORWARD)
            for _, cs, value, base in events if way is Direction.FORWARD else events[::-1]:
                state.add(mask(cs), base, value)
            assert state.result() == models.next_node(way.value, which.value, events, steps), (way, which)


def test_many_events_of_one_group():
    """Ten thousand matching events are a matter of seconds for timed patterns and for every set of modes."""
    n, began = 10_000, time.process_time()
    times = np.arange(n, dtype=np.int64) * SECOND
    ones = np.ones(n, np.int64)
    for text, want in (("(?1).*(?t>=1)(?1).*(?2)", 0), ("(?1).*(?t<=600)(?2)", 0), ("(?1).*(?t==7)(?1)", n // 8), ("(?1).*(?t!=1)(?1)(?t>=1).*(?t<5).", n // 4)):
        assert P.Matcher(P.parse(text)).count(times, ones) == want, text
    masks = np.random.default_rng(1).choice([1, 1, 2, 3, 4], n)
    for modes in models.MODE_SETS:
        assert 1 <= reached(times, masks, 5, 10**15, Mode(sum(Mode[m.upper()] for m in modes))) <= 3
    assert time.process_time() - began < 60
