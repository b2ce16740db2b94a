import datetime as dt
import random

import pytest
from models import MODE_SETS, count, first_match, funnel, next_node, sessions
from pyspark.sql import functions as F

import eventlens as E
from eventlens import args

T0 = dt.datetime(2024, 1, 1)
CONDITIONS = ["c1", "c2", "c3", "c4"]
PATTERNS = [
    "(?1)(?2)", "(?1).*(?2)", "(?1).*(?2).*(?3)", "(?1)(?2).*(?3)", "(?1).(?3)", ".*(?2).*", "(?1).*(?1)", ".*", "(?3)",
    "(?1)(?t<=3)(?2)", "(?1).*(?t>=2)(?3)", "(?1)(?t==0)(?2)", "(?1)(?t!=1)(?2)", "(?1)(?t<2).(?t>1)(?2)", "(?t>=5)(?1)", "(?1)(?9)", "(?1) (?2)",
]


def groups(seed, many=60):
    """Groups of (time in us, conditions, value, base): ties, gaps, overlaps; sorted as the library sorts."""
    rnd = random.Random(seed)
    out = {}
    for g in range(many):
        rows = []
        for _ in range(rnd.randint(0, 12)):
            t = rnd.choice([0, 500_000, 1_000_000]) + rnd.randint(0, 6) * 1_000_000
            cs = {k for k in range(4) if rnd.random() < 0.35}
            rows.append((t, cs, rnd.choice([None, "a", "b", "c"]), rnd.random() < 0.5))
        out[g] = rows
    return out


@pytest.fixture(scope="module")
def data(spark):
    made = groups(1)
    rows = []
    for g, own in made.items():
        for t, cs, value, base in own:
            flags = [True if k in cs else random.choice([False, None]) for k in range(4)]
            rows.append((g, T0 + dt.timedelta(microseconds=t), *flags, value, base))
        rows.append((g, None, True, True, True, True, "z", True))  # rows without a timestamp are passed over
    random.Random(2).shuffle(rows)
    schema = "g int, ts timestamp_ntz, c1 boolean, c2 boolean, c3 boolean, c4 boolean, value string, base boolean"
    return made, spark.createDataFrame(rows, schema).repartition(5).cache()


def mask(cs):
    return sum(1 << k for k in cs)


def by_mask(own):
    return sorted(((t, cs) for t, cs, *_ in own if cs), key=lambda e: (e[0], mask(e[1])))


def result(df, column):
    return {r.g: r.x for r in df.groupBy("g").agg(column.alias("x")).collect()}


@pytest.mark.parametrize("seconds", [0, 2, 100])
def test_funnel_all_modes(data, seconds):
    made, df = data
    columns = [E.window_funnel(f"{seconds} seconds", "ts", *CONDITIONS, mode=",".join(sorted(m))).alias(f"m{k}") for k, m in enumerate(MODE_SETS)]
    for r in df.groupBy("g").agg(*columns).collect():
        own = by_mask(made[r.g])
        for k, m in enumerate(MODE_SETS):
            assert r[f"m{k}"] == funnel(own, 4, seconds * 1_000_000, m), (r.g, m)


def test_patterns(data):
    made, df = data
    columns = []
    for k, p in enumerate(PATTERNS):
        columns += [E.sequence_match(p, "ts", *CONDITIONS).alias(f"m{k}"), E.sequence_count(p, "ts", *CONDITIONS).alias(f"n{k}")]
        columns.append(E.sequence_match_events(p, "ts", *CONDITIONS).alias(f"e{k}"))
    for r in df.groupBy("g").agg(*columns).collect():
        own = by_mask(made[r.g])
        for k, p in enumerate(PATTERNS):
            assert r[f"n{k}"] == count(p, own), p
            assert r[f"m{k}"] == (count(p, own) > 0), p
            found = first_match(p, own) or []
            assert [(t - T0) // dt.timedelta(microseconds=1) for t in r[f"e{k}"]] == found, p


@pytest.mark.parametrize("direction", ["forward", "Backward "])
@pytest.mark.parametrize("base", ["head", "tail", "first_match", "LAST_MATCH"])
def test_next_node(data, direction, base):
    made, df = data
    for steps in (1, 2, 3):
        got = result(df, E.sequence_next_node(direction, base, "ts", "value", "base", *CONDITIONS[:steps]))
        for g, own in made.items():
            cut = [(t, {c for c in cs if c < steps}, v, b) for t, cs, v, b in own]
            cut.sort(key=lambda e: (e[0], mask(e[1]), e[2] is not None, e[2] or "", e[3]))
            assert got[g] == next_node(direction.strip().lower(), base.lower(), cut, steps), (g, steps)


def test_retention(data):
    made, df = data
    got = result(df, E.retention(*CONDITIONS))
    for g, own in made.items():
        # rows without a timestamp count here, as there is no time in this function
        assert got[g] == [True] * 4, own
    some = result(df.where("ts is not null"), E.retention(*CONDITIONS))
    for g, own in made.items():
        if own:
            met = [any(k in cs for _, cs, *_ in own) for k in range(4)]
            assert some[g] == [met[0], *(met[0] and m for m in met[1:])]


def test_sessions(spark):
    rnd = random.Random(3)
    rows, expected = [], {}
    for g in range(20):
        times = sorted(rnd.randint(0, 200) for _ in range(rnd.randint(1, 30)))
        expected[g] = sessions(times, 10)
        rows += [(g, T0 + dt.timedelta(seconds=t)) for t in times] + [(g, None)] * rnd.randint(0, 2)
    df = spark.createDataFrame(rows, "g int, ts timestamp_ntz")
    got = E.sessionize(df, "ts", "10 seconds", ["g"]).orderBy("g", "ts").collect()
    for g in range(20):
        assert [r.session_id for r in got if r.g == g and r.ts is not None] == expected[g]
    assert all(r.session_id is None for r in got if r.ts is None)
    counts = {r.g: r.sessions for r in E.session_count(df, "ts", "10 seconds", ["g"]).collect()}
    assert counts == {g: max(x) for g, x in expected.items()}


def test_session_boundary_and_frames(spark):
    rows = [(0, T0 + dt.timedelta(seconds=s)) for s in (0, 10, 21, 21)]
    df = spark.createDataFrame(rows, "g int, ts timestamp_ntz")
    assert [r.session_id for r in E.sessionize(df, "ts", "10 seconds").orderBy("ts").collect()] == [1, 1, 2, 2]
    assert [r.s for r in E.sessionize(df, "ts", 0, ["g"], "s").orderBy("ts").collect()] == [1, 2, 3, 3]
    framed = E.sessionize(df, "ts", "10 seconds", ["g"], frame=(-1, 0)).orderBy("ts", "session_id").collect()
    assert sorted(r.session_id for r in framed) == [1, 1, 1, 2]
    zoned = df.select("g", F.col("ts").cast("timestamp").alias("ts"))
    assert [r.session_id for r in E.sessionize(zoned, "ts", "10 seconds", ["g"]).orderBy("ts").collect()] == [1, 1, 2, 2]


def test_empty_input(spark):
    df = spark.createDataFrame([], "ts timestamp_ntz, a boolean, b boolean, v string")
    row = df.agg(
        E.retention("a", "b").alias("r"), E.window_funnel("1 hour", "ts", "a", "b").alias("f"),
        E.window_funnel("1 hour", "ts", "a", "b", mode="strict").alias("fs"), E.sequence_match("(?1)(?2)", "ts", "a", "b").alias("m"),
        E.sequence_count("(?1)(?t<1)(?2)", "ts", "a", "b").alias("n"), E.sequence_match_events("(?1)(?2)", "ts", "a", "b").alias("e"),
        E.sequence_next_node("forward", "head", "ts", "v", "a", "b").alias("x"),
    ).collect()
    assert [tuple(r) for r in row] == [([], 0, 0, None, None, [], None)]
    assert df.groupBy("v").agg(E.retention("a", "b")).collect() == []
    assert E.session_count(df, "ts", "1 hour").collect()[0].sessions is None


def test_nothing_satisfied_and_types(spark):
    df = spark.createDataFrame([(T0, False, None)], "ts timestamp_ntz, a boolean, b boolean")
    out = df.agg(
        E.window_funnel("1 hour", "ts", "a", "b").alias("f"), E.sequence_match("(?1).*(?2)", "ts", "a", "b").alias("m"),
        E.sequence_count(".*", "ts", "a", "b").alias("n"), E.sequence_match_events("(?1)", "ts", "a", "b").alias("e"),
    )
    assert tuple(out.first()) == (0, False, 0, [])
    assert dict(out.dtypes) == {"f": "int", "m": "boolean", "n": "bigint", "e": "array<timestamp_ntz>"}


def test_thirty_two_conditions(spark):
    names = [f"c{k}" for k in range(32)]
    rows = [(T0 + dt.timedelta(seconds=k), *[j == k for j in range(32)]) for k in range(32)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, " + ", ".join(f"{n} boolean" for n in names))
    pattern = "".join(f"(?{k + 1})" for k in range(32))
    row = df.agg(
        E.window_funnel("1 hour", "ts", *names), E.window_funnel("1 hour", "ts", *names, mode="strict_increase"),
        E.sequence_match(pattern, "ts", *names), E.sequence_match("(?32)", "ts", *names), E.retention(*names),
    ).first()
    assert row[0] == row[1] == 32 and row[2] and row[3] and all(row[4])


def test_long_gap_between_matches(spark):
    df = spark.range(12_000).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) ts", "id = 0 a", "id = 11999 b", "true c")
    row = df.agg(
        E.sequence_match("(?1).*(?2)", "ts", "a", "b", "c").alias("m"), E.sequence_count("(?3)(?3).*(?2)", "ts", "a", "b", "c").alias("n"),
        E.sequence_match_events("(?1).*(?2)", "ts", "a", "b", "c").alias("e"), E.window_funnel("4 hours", "ts", "a", "b").alias("f"),
    ).first()
    assert row.m and row.n == 1 and len(row.e) == 2 and row.f == 2


def test_compat_ignores_adjacency(spark):
    rows = [(T0 + dt.timedelta(seconds=k), k == 0, k == 2, k == 3, True) for k in range(4)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, a boolean, b boolean, c boolean, d boolean")
    row = df.agg(
        E.sequence_match("(?1)(?2).*(?3)", "ts", "a", "b", "c", "d").alias("own"),
        E.sequence_match("(?1)(?2).*(?3)", "ts", "a", "b", "c", "d", compat="reference").alias("old"),
    ).first()
    assert (row.own, row.old) == (False, True)


def test_arguments(spark):
    with pytest.raises(ValueError):
        E.retention("a")
    with pytest.raises(ValueError):
        E.window_funnel("1 hour", "ts", *["a"] * 33)
    with pytest.raises(ValueError):
        E.window_funnel("1 month", "ts", "a", "b")
    with pytest.raises(ValueError):
        E.window_funnel("1 hour", "ts", "a", "b", mode="Strict")
    with pytest.raises(ValueError):
        E.sequence_next_node("sideways", "head", "ts", "v", "a", "b")
    assert args.mode(" strict_order, ,strict ,strict") == args.Mode.STRICT | args.Mode.STRICT_ORDER
    assert args.mode("nonsense,strict", "null") == args.Mode.DEFAULT
    assert args.interval("1 month", "null") == dt.timedelta(0)
    assert args.interval("INTERVAL '1 day 2 hours'") == dt.timedelta(days=1, hours=2)
    assert args.interval("01:30:00") == dt.timedelta(minutes=90)


@pytest.mark.parametrize(
    "pattern, position", [("", 0), ("x", 0), ("(?1)(?0)", 4), ("(?1", 0), ("(?t>)", 0), ("(?1)(?t>5", 4), ("(?)", 0), ("(?1)+", 4)]
)
def test_pattern_errors(spark, pattern, position):
    from eventlens.plans.pattern import PatternError

    with pytest.raises(PatternError) as e:
        E.sequence_match(pattern, "ts", "a", "b")
    assert e.value.position == position
    df = spark.createDataFrame([(T0, True, True)], "ts timestamp_ntz, a boolean, b boolean")
    row = df.agg(E.sequence_count(pattern, "ts", "a", "b", on_error="null"), E.sequence_match_events(pattern, "ts", "a", "b", on_error="null")).first()
    assert tuple(row) == (None, [])


def test_partitioning_does_not_matter(data):
    _, df = data
    columns = [
        E.window_funnel("3 seconds", "ts", *CONDITIONS).alias("a"), E.sequence_count("(?1).*(?2)", "ts", *CONDITIONS).alias("b"),
        E.sequence_next_node("forward", "tail", "ts", "value", "base", "c1", "c2").alias("c"),
    ]
    runs = [{tuple(r) for r in df.repartition(n).groupBy("g").agg(*columns).collect()} for n in (1, 3, 8)]
    assert runs[0] == runs[1] == runs[2]
