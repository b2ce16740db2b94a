"""Reports composed of the event functions: each takes an event table and returns a DataFrame.

``steps`` and other conditions are boolean columns or column names; ``key`` names the
columns that identify a user.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens import args
from eventlens.functions import retention, sequence_count, sequence_match, sequence_match_events, window_funnel
from eventlens.operators.sessionize import sessionize
from eventlens.operators.streamed import large_next_node

Conditions = Sequence[args.ColumnLike]


def _share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Per cent, in double precision; null for a whole of nothing."""
    return F.round(F.lit(100.0).cast("double") * part / F.nullif(whole, F.lit(0)), digits)


def _many(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, as double."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def funnel_by_user(events: DataFrame, key: Sequence[str], ts: str, window, steps: Conditions, mode=None) -> DataFrame:
    """Steps reached by each user."""
    return events.groupBy(*key).agg(window_funnel(window, ts, *steps, mode=mode).alias("step"))


def funnel_report(events: DataFrame, key: Sequence[str], ts: str, window, steps: Conditions, mode=None) -> DataFrame:
    """``step, users, pct``: how many users stopped at each step."""
    reached = funnel_by_user(events, key, ts, window, steps, mode).groupBy("step").agg(F.count("*").alias("users"))
    everyone = F.sum("users").over(Window.partitionBy(F.lit(0)))  # one row a step
    return reached.select("step", "users", _share(F.col("users"), everyone).alias("pct"))


def _by_step(steps: int) -> list[Column]:
    return [_many(F.col("step") >= k).alias(f"step_{k}") for k in range(1, steps + 1)]


def funnel_by_day(events: DataFrame, key: Sequence[str], ts: str, window, steps: Conditions) -> DataFrame:
    """Users by the day of their first event, how many reached each step, and the conversion in per cent."""
    users = events.groupBy(*key).agg(F.min(ts).alias("first"), window_funnel(window, ts, *steps).alias("step"))
    n = len(steps)
    return users.groupBy(F.to_date("first").alias("day")).agg(
        F.count("*").alias("users"), *_by_step(n), _share(_many(F.col("step") >= n), _many(F.col("step") >= 1)).alias("conversion_pct")
    )


def funnel_by_segment(events: DataFrame, key: Sequence[str], segment: str, ts: str, window, steps: Conditions) -> DataFrame:
    """Users, mean step, and how many completed the funnel, by segment."""
    n = len(steps)
    return funnel_by_user(events, [*key, segment], ts, window, steps).groupBy(segment).agg(
        F.count("*").alias("users"), F.round(F.avg("step"), 2).alias("avg_step"),
        _many(F.col("step") == n).alias("completed"), _share(_many(F.col("step") == n), F.count("*")).alias("pct"),
    )


def session_metrics(events: DataFrame, key: Sequence[str], ts: str, gap) -> DataFrame:
    """Events, start, end, duration and bounce of each session."""
    numbered = sessionize(events, ts, gap, list(key))
    metrics = numbered.groupBy(*key, "session_id").agg(F.count("*").alias("events"), F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"))
    return metrics.withColumn("duration_sec", _seconds(F.col("started_at"), F.col("ended_at"))).withColumn("is_bounce", F.col("events") == 1)


def sessions_per_day(events: DataFrame, key: Sequence[str], ts: str, gap) -> DataFrame:
    """Distinct sessions of each user and day."""
    numbered = sessionize(events, ts, gap, list(key)).withColumn("day", F.to_date(ts))
    return numbered.groupBy(*key, "day").agg(F.count_distinct("session_id").alias("sessions"))


def session_duration_by_day(events: DataFrame, key: Sequence[str], ts: str, gap) -> DataFrame:
    """Sessions and their mean duration by the day they began."""
    by_day = session_metrics(events, key, ts, gap).groupBy(F.to_date("started_at").alias("day"))
    mean = F.avg("duration_sec")
    return by_day.agg(F.count("*").alias("sessions"), F.round(mean, 0).alias("avg_duration_sec"), F.round(mean / 60.0, 1).alias("avg_duration_min"))


def entry_values(events: DataFrame, key: Sequence[str], ts: str, value: str, gap) -> DataFrame:
    """Values (pages, say) that sessions begin with, how often, and in per cent."""
    entries = sessionize(events, ts, gap, list(key)).groupBy(*key, "session_id").agg(F.min_by(value, ts).alias("entry"))
    counted = entries.groupBy("entry").agg(F.count("*").alias("sessions"))
    everything = F.sum("sessions").over(Window.partitionBy(F.lit(0)))  # one row a value
    return counted.select("entry", "sessions", _share(F.col("sessions"), everything).alias("pct"))


def cohort_retention(events: DataFrame, key: Sequence[str], cohort: Sequence[str], day: args.ColumnLike, start: args.ColumnLike, periods: Sequence[tuple[int, int]]) -> DataFrame:
    """For each cohort its size, who came back in each period, and per cent of the first period.

    A period is a pair of days from the cohort's start: first, and one past the last.
    """
    since = F.datediff(args.column(day), args.column(start))
    met = retention(*[(since >= a) & (since < b) for a, b in periods])
    users = events.groupBy(*key, *cohort).agg(met.alias("r"))
    came = lambda k: _many(F.get("r", F.lit(k)))
    counts = [came(k).alias(f"period_{k}") for k in range(len(periods))]
    rates = [_share(came(k), came(0)).alias(f"pct_{k}") for k in range(1, len(periods))]
    return users.groupBy(*cohort).agg(F.count("*").alias("cohort_size"), *counts, *rates)


def pattern_by_user(events: DataFrame, key: Sequence[str], pattern: str, ts: str, conditions: Conditions) -> DataFrame:
    """Whether each user matches a pattern, and how often."""
    return events.groupBy(*key).agg(
        sequence_match(pattern, ts, *conditions).alias("matched"), sequence_count(pattern, ts, *conditions).alias("matches")
    )


def step_times(events: DataFrame, key: Sequence[str], pattern: str, ts: str, conditions: Conditions, steps: int) -> DataFrame:
    """Times of the steps of users whose first match has ``steps`` of them, and hours between."""
    found = events.groupBy(*key).agg(sequence_match_events(pattern, ts, *conditions).alias("at")).where(F.size("at") == steps)
    times = [F.get("at", F.lit(k)).alias(f"time_{k + 1}") for k in range(steps)]
    hours = [(_seconds(F.get("at", F.lit(k - 1)), F.get("at", F.lit(k))) / 3600.0).alias(f"hours_to_{k + 1}") for k in range(1, steps)]
    return found.select(*key, *times, *hours)


def flow(events: DataFrame, key: Sequence[str], direction, base, ts: str, value: str, base_condition: args.ColumnLike, steps: Conditions, end: str = "(end)") -> DataFrame:
    """Values next to a chain of events, how many users, and in per cent. No group is held in an array."""
    found = large_next_node(events, list(key), direction, base, ts, value, base_condition, *steps)
    counted = found.groupBy(F.coalesce("node", F.lit(end)).alias("node")).agg(F.count("*").alias("users"))
    everyone = F.sum("users").over(Window.partitionBy(F.lit(0)))  # one row a value
    return counted.select("node", "users", _share(F.col("users"), everyone).alias("pct"))


def ab_comparison(events: DataFrame, key: Sequence[str], group: str, ts: str, window, steps: Conditions, pattern: str) -> DataFrame:
    """Funnel depth, completion and fast completion (by a timed pattern) of test groups.

    Both functions are aggregated at once, where the SQL recipe joins two aggregates.
    """
    n = len(steps)
    users = events.groupBy(*key, group).agg(window_funnel(window, ts, *steps).alias("step"), sequence_match(pattern, ts, *steps).alias("fast"))
    return users.groupBy(group).agg(
        F.count("*").alias("users"), F.round(F.avg("step"), 2).alias("avg_depth"), _many(F.col("step") == n).alias("completed"),
        _share(_many(F.col("step") == n), F.count("*")).alias("complete_pct"), _many(F.col("fast")).alias("fast_completers"),
    )


def session_funnel(events: DataFrame, key: Sequence[str], ts: str, gap, window, steps: Conditions) -> DataFrame:
    """Steps reached in each session; the exchange for sessions serves the funnel too."""
    numbered = sessionize(events, ts, gap, list(key))
    return numbered.groupBy(*key, "session_id").agg(window_funnel(window, ts, *steps).alias("step"))


def power_users(events: DataFrame, key: Sequence[str], ts: str, cycles: dict[str, tuple[str, Conditions]], window, steps: Conditions, top: int = 20) -> DataFrame:
    """The users with most repeats of patterns (``name: (pattern, conditions)``), by the last one; a top-k report."""
    counts = [sequence_count(p, ts, *c).alias(name) for name, (p, c) in cycles.items()]
    users = events.groupBy(*key).agg(*counts, window_funnel(window, ts, *steps).alias("funnel_depth"))
    return users.orderBy(F.desc(list(cycles)[-1]), *key).limit(top)


def scorecard(events: DataFrame, key: Sequence[str], ts: str, window, steps: Conditions, pattern: str) -> DataFrame:
    """Several functions beside built-in aggregates in one pass over each user's events."""
    return events.groupBy(*key).agg(
        F.count("*").alias("events"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        window_funnel(window, ts, *steps).alias("step"), sequence_match(pattern, ts, *steps).alias("matched"),
        sequence_count(pattern, ts, *steps).alias("matches"), retention(*steps).alias("met"),
    )
