"""Queries over the table ``events``, one for each operator, variant and recipe, with SQL to hold them against.

The SQL is written for another engine and in another way: conditions become codes or
numbered rows, modes a recursive walk, patterns regular expressions or self-joins.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import eventlens as E
from eventlens.args import Mode
from eventlens.operators.streamed import large_chain_count, large_funnel, large_next_node
from eventlens.plans import recipes as R
from eventlens.sources import read_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Columns of the table, so that no job is run to infer them.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_events(spark, f"{sf_dir}/events.parquet", schema=EVENTS)


def add(name: str, sql: str, query: Callable[[DataFrame], DataFrame]) -> None:
    """Register a query over the table events."""
    QUERIES[name] = lambda spark, sf_dir: query(events(spark, sf_dir))
    ORACLES[name] = sql


#: Conditions on one event type each, as SQL.
VIEW, CLICK, BUY, SIGNUP, ERROR = (f"event_type = '{kind}'" for kind in ("view", "click", "purchase", "signup", "error"))
#: Conditions that overlap, so that one event can satisfy several.
WIDE = ("event_type IN ('view','click')", "event_type IN ('click','purchase')", "value > 40")

# --- sessions -------------------------------------------------------------------------
SESSIONS = """
WITH s AS (SELECT *, CAST(1 + SUM(CASE WHEN ts - p > INTERVAL 6 HOUR THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id
           FROM (SELECT *, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
"""
GAP = "6 hours"
add("sessionize", SESSIONS + "SELECT event_id, user_id, session_id FROM s", lambda e: E.sessionize(e, "ts", GAP, ["user_id"]).select("event_id", "user_id", "session_id"))
add(
    "sessionize_frame",
    """SELECT event_id, CAST(1 + CASE WHEN p1 IS NULL OR ts - p1 <= INTERVAL 6 HOUR THEN 0 ELSE 1 END
         + CASE WHEN p2 IS NULL OR p1 - p2 <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS BIGINT) AS session_id
       FROM (SELECT event_id, ts, LAG(ts) OVER w AS p1, LAG(ts, 2) OVER w AS p2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))""",
    lambda e: E.sessionize(e, "ts", GAP, ["user_id"], frame=(-2, 0)).select("event_id", "session_id"),
)
add("session_count", SESSIONS + "SELECT user_id, MAX(session_id) AS sessions FROM s GROUP BY user_id", lambda e: E.session_count(e, "ts", GAP, ["user_id"]))
add(
    "session_metrics",
    SESSIONS + """SELECT user_id, session_id, COUNT(*) AS events, MIN(ts) AS started_at, MAX(ts) AS ended_at,
        (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1e6 AS duration_sec, COUNT(*) = 1 AS is_bounce FROM s GROUP BY ALL""",
    lambda e: R.session_metrics(e, ["user_id"], "ts", GAP),
)
add("sessions_per_day", SESSIONS + "SELECT user_id, CAST(ts AS DATE) AS day, COUNT(DISTINCT session_id) AS sessions FROM s GROUP BY ALL", lambda e: R.sessions_per_day(e, ["user_id"], "ts", GAP))
add(
    "session_duration_by_day",
    SESSIONS + """, m AS (SELECT user_id, session_id, CAST(MIN(ts) AS DATE) AS day, (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1e6 AS d FROM s GROUP BY 1, 2)
        SELECT day, COUNT(*) AS sessions, ROUND(AVG(d), 0) AS avg_duration_sec, ROUND(AVG(d) / 60.0, 1) AS avg_duration_min FROM m GROUP BY day""",
    lambda e: R.session_duration_by_day(e, ["user_id"], "ts", GAP),
)
add(
    "entry_values",
    SESSIONS + """, f AS (SELECT DISTINCT ON (user_id, session_id) event_type AS entry FROM s ORDER BY user_id, session_id, ts)
        SELECT entry, COUNT(*) AS sessions, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 1) AS pct FROM f GROUP BY entry""",
    lambda e: R.entry_values(e, ["user_id"], "ts", "event_type", GAP),
)

# --- retention ------------------------------------------------------------------------
add(
    "retention",
    """SELECT user_id, [a, a AND bool_or(value > 200), a AND bool_or(event_type = 'none'), a AND bool_or(event_type = 'signup' AND value < 5)] AS r
       FROM (SELECT *, bool_or(event_type = 'purchase' AND value > 50) OVER (PARTITION BY user_id) AS a FROM events) GROUP BY user_id, a""",
    lambda e: e.groupBy("user_id").agg(E.retention(f"{BUY} AND value > 50", "value > 200", "event_type = 'none'", f"{SIGNUP} AND value < 5").alias("r")),
)
add("retention_empty", "SELECT CAST([] AS BOOLEAN[]) AS r", lambda e: e.where("false").agg(E.retention(VIEW, BUY).alias("r")))
COHORT = "WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, MIN(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS cohort, user_id % 3 AS segment FROM events)"


def _cohort(e: DataFrame) -> DataFrame:
    first = e.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("cohort"))
    return e.join(first, "user_id").select("user_id", F.to_date("ts").alias("day"), "cohort", (F.col("user_id") % 3).alias("segment"))


def _cohort_sql(by: str, periods) -> str:
    met = ", ".join(f"bool_or(day - cohort BETWEEN {a} AND {b - 1}) AS p{k}" for k, (a, b) in enumerate(periods))
    sums = ", ".join(f"COUNT(*) FILTER (p0 AND p{k}) AS period_{k}" for k in range(len(periods)))
    rates = ", ".join(f"ROUND(100.0 * COUNT(*) FILTER (p0 AND p{k}) / NULLIF(COUNT(*) FILTER (p0), 0), 1) AS pct_{k}" for k in range(1, len(periods)))
    return f"{COHORT}, u AS (SELECT user_id, {by}, {met} FROM a GROUP BY 1, 2) SELECT {by}, COUNT(*) AS cohort_size, {sums}, {rates} FROM u GROUP BY {by}"


for _name, _by, _periods in (
    ("retention_weekly", "cohort", [(0, 7), (7, 14), (14, 21), (21, 28)]),
    ("retention_days", "cohort", [(0, 1), (1, 2), (7, 8), (29, 30)]),
    ("retention_by_segment", "segment", [(0, 1), (7, 8), (14, 15)]),
):
    add(_name, _cohort_sql(_by, _periods), lambda e, by=_by, p=_periods: R.cohort_retention(_cohort(e), ["user_id"], [by], "day", "cohort", p))

# --- funnels --------------------------------------------------------------------------
#: Entries and the earliest later steps: enough where no event satisfies two conditions.
CHAIN = """
WITH s AS (SELECT user_id, ts, event_type FROM events),
c AS (SELECT v.user_id, v.ts AS t1,
        (SELECT MIN(b.ts) FROM s b WHERE b.user_id = v.user_id AND b.event_type = 'click' AND b.ts > v.ts AND b.ts <= v.ts + INTERVAL 1 DAY) AS t2
      FROM s v WHERE v.event_type = 'view'),
d AS (SELECT c.*, (SELECT MIN(p.ts) FROM s p WHERE p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts > c.t2 AND p.ts <= c.t1 + INTERVAL 1 DAY) AS t3 FROM c),
f AS (SELECT u.user_id, CAST(COALESCE(MAX(CASE WHEN t3 IS NOT NULL THEN 3 WHEN t2 IS NOT NULL THEN 2 WHEN t1 IS NOT NULL THEN 1 END), 0) AS INTEGER) AS step
      FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN d USING (user_id) GROUP BY u.user_id)
"""
STEPS, DAY = (VIEW, CLICK, BUY), "1 day"
add("window_funnel", CHAIN + "SELECT user_id, step FROM f", lambda e: R.funnel_by_user(e, ["user_id"], "ts", DAY, STEPS))
add("funnel_report", CHAIN + "SELECT step, COUNT(*) AS users, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 1) AS pct FROM f GROUP BY step", lambda e: R.funnel_report(e, ["user_id"], "ts", DAY, STEPS))
_REACHED = ", ".join(f"COUNT(*) FILTER (step >= {k}) AS step_{k}" for k in (1, 2, 3))
add(
    "funnel_by_day",
    CHAIN + f""", g AS (SELECT user_id, CAST(MIN(ts) AS DATE) AS day FROM s GROUP BY 1)
        SELECT day, COUNT(*) AS users, {_REACHED}, ROUND(100.0 * COUNT(*) FILTER (step >= 3) / NULLIF(COUNT(*) FILTER (step >= 1), 0), 1) AS conversion_pct
        FROM f JOIN g USING (user_id) GROUP BY day""",
    lambda e: R.funnel_by_day(e, ["user_id"], "ts", DAY, STEPS),
)
add(
    "funnel_by_segment",
    CHAIN + """SELECT user_id % 4 AS segment, COUNT(*) AS users, ROUND(AVG(step), 2) AS avg_step, COUNT(*) FILTER (step = 3) AS completed,
        ROUND(100.0 * COUNT(*) FILTER (step = 3) / COUNT(*), 1) AS pct FROM f GROUP BY 1""",
    lambda e: R.funnel_by_segment(e.withColumn("segment", F.col("user_id") % 4), ["user_id"], "segment", "ts", DAY, STEPS),
)


def walk_sql(modes: Mode) -> str:
    """A walk from each entry, event by event, for three overlapping conditions and two days."""
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, c in enumerate(WIDE))
    nxt = "((m >> step) & 1) = 1"
    climbed = f"CASE WHEN NOT {nxt} THEN step WHEN step = 1 AND (m & 4) > 0 THEN 3 ELSE step + 1 END"
    if modes & Mode.STRICT_ONCE:
        climbed = f"CASE WHEN {nxt} THEN step + 1 ELSE step END"
    stops, skips = ["step = 3", "ts - entry > INTERVAL 2 DAY"], ["FALSE"]
    reenter = "step > 1 AND (m & 1) = 1" if modes & Mode.ALLOW_REENTRY else "FALSE"
    if modes & Mode.STRICT:
        stops.append(f"NOT ({reenter}) AND ((m >> (step - 1)) & 1) = 1 AND NOT {nxt}")
    if modes & Mode.STRICT_ORDER:
        stops.append(f"NOT ({reenter}) AND (m & ((1 << step) - 1)) > 0")
    if modes & Mode.TIMESTAMP_DEDUP:
        skips.append(f"ts = prev AND {nxt}")
    if modes & Mode.STRICT_INCREASE:
        skips.append(f"ts <= prev AND {nxt}")
    stop, skip = " OR ".join(f"({x})" for x in stops), " OR ".join(f"({x})" for x in skips)
    return f"""
WITH RECURSIVE e AS (SELECT user_id, ts, m, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts) AS n
                     FROM (SELECT user_id, ts, {bits} AS m FROM events) WHERE m > 0),
w(user_id, start, n, entry, prev, step, live) AS (
  SELECT user_id, n, n, ts, ts, 1, TRUE FROM e WHERE (m & 1) = 1
  UNION ALL
  SELECT user_id, start, n, entry, CASE WHEN go AND (again OR up > step) THEN ts ELSE prev END,
         CASE WHEN NOT go THEN step WHEN again THEN 1 ELSE up END, go
  FROM (SELECT w.user_id, w.start, e.n, w.entry, w.prev, w.step, e.ts, NOT ({stop}) AS go, ({reenter}) AS again,
               CASE WHEN {skip} THEN w.step ELSE {climbed} END AS up
        FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1 WHERE w.live))
SELECT u.user_id, CAST(COALESCE(MAX(last), 0) AS INTEGER) AS step
FROM (SELECT DISTINCT user_id FROM events) u
LEFT JOIN (SELECT user_id, start, arg_max(step, n) AS last FROM w GROUP BY 1, 2) USING (user_id) GROUP BY u.user_id"""


_MODES = [m for m in Mode] + [Mode.STRICT | Mode.STRICT_ONCE, Mode.STRICT_ORDER | Mode.ALLOW_REENTRY, Mode.STRICT_INCREASE | Mode.STRICT_ONCE]  # noqa: C416
for _m in [Mode.DEFAULT, *_MODES]:
    _names = "_".join(x.name.lower() for x in Mode if x & _m) or "wide"
    add(f"funnel_{_names}", walk_sql(_m), lambda e, m=_m: R.funnel_by_user(e, ["user_id"], "ts", "2 days", WIDE, m))
add("funnel_mode_list", walk_sql(Mode.STRICT | Mode.STRICT_INCREASE), lambda e: R.funnel_by_user(e, ["user_id"], "ts", "2 days", WIDE, "strict_deduplication, ,strict_increase"))

# --- patterns -------------------------------------------------------------------------
#: Codes of the events of view, click and purchase, in order.
CODED = """
WITH t AS (SELECT user_id, COALESCE(string_agg(CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'p' END, '' ORDER BY ts), '') AS code
           FROM events GROUP BY user_id)
"""
for _name, _pattern, _regex in (
    ("adjacent", "(?1)(?2)", "vc"),
    ("wildcard", "(?1).*(?2).*(?3)", "v.*?c.*?p"),
    ("mixed", "(?1)(?2).*(?3)", "vc.*?p"),
    ("any_event", "(?1).(?3)", "v.p"),
    ("repeated", "(?1)(?1).*(?3)(?3)", "vv.*?pp"),
    ("leading_skip", ".*(?2)(?3)", ".*?cp"),
):
    add(
        f"sequence_{_name}",
        CODED + f"SELECT user_id, regexp_matches(code, '{_regex}') AS matched, CAST(len(regexp_extract_all(code, '{_regex}')) AS BIGINT) AS matches FROM t",
        lambda e, p=_pattern: R.pattern_by_user(e, ["user_id"], p, "ts", STEPS),
    )
for _name, _test, _sql in (
    ("ge", ">=86400", ">= 86400"), ("le", "<=3600", "<= 3600"), ("gt", ">100000", "> 100000"),
    ("lt", "<7200", "< 7200"), ("eq", "==1234", "= 1234"), ("ne", "!=1234", "<> 1234"),
):
    add(
        f"sequence_time_{_name}",
        f"""WITH n AS (SELECT *, LEAD(ts) OVER w AS t2, LEAD(event_type) OVER w AS e2 FROM events WHERE event_type IN ('view', 'purchase')
                       WINDOW w AS (PARTITION BY user_id ORDER BY ts))
            SELECT user_id, COALESCE(bool_or(ok), FALSE) AS matched, COUNT(*) FILTER (ok) AS matches
            FROM (SELECT user_id, FALSE AS ok FROM events UNION ALL
                  SELECT user_id, event_type = 'view' AND e2 = 'purchase' AND (epoch_us(t2) - epoch_us(ts)) // 1000000 {_sql} FROM n) GROUP BY user_id""",
        lambda e, t=_test: R.pattern_by_user(e, ["user_id"], f"(?1)(?t{t})(?2)", "ts", (VIEW, BUY)),
    )
TIMES = """
WITH s AS (SELECT user_id, ts, event_type FROM events),
a AS (SELECT user_id, MIN(ts) AS t1 FROM s WHERE event_type = 'signup' GROUP BY 1),
b AS (SELECT a.*, (SELECT MIN(ts) FROM s WHERE s.user_id = a.user_id AND event_type = 'click' AND ts > t1) AS t2 FROM a),
c AS (SELECT b.*, (SELECT MIN(ts) FROM s WHERE s.user_id = b.user_id AND event_type = 'error' AND ts > t2) AS t3 FROM b)
"""


def _micros(found: DataFrame, name: str = "at") -> DataFrame:
    """Lists of timestamps as lists of microseconds, which every engine writes alike."""
    return found.withColumn(name, F.transform(name, lambda t: F.unix_micros(t.cast("timestamp"))))


NO_TIMES = "CAST([] AS BIGINT[])"
add(
    "sequence_match_events",
    TIMES + f"""SELECT u.user_id, CASE WHEN t3 IS NULL THEN {NO_TIMES} ELSE [epoch_us(t1), epoch_us(t2), epoch_us(t3)] END AS at
        FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN c USING (user_id)""",
    lambda e: _micros(e.groupBy("user_id").agg(E.sequence_match_events("(?1).*(?2).*(?3)", "ts", SIGNUP, CLICK, ERROR).alias("at"))),
)
#: Per user the earliest signup with an error in a range of seconds after it, and the first such error.
TIMED = """
WITH a AS (SELECT user_id, ts AS t1 FROM events WHERE event_type = 'signup'),
m AS (SELECT a.user_id, t1, MIN(b.ts) AS t2 FROM a JOIN events b ON b.user_id = a.user_id AND b.event_type = 'error' AND b.ts > t1
          AND (epoch_us(b.ts) - epoch_us(t1)) // 1000000 {test} GROUP BY 1, 2),
f AS (SELECT user_id, arg_min([epoch_us(t1), epoch_us(t2)], t1) AS at FROM m GROUP BY 1)
"""
for _name, _test, _sql in (("le", "<=36000", "<= 36000"), ("ge", ">=86400", ">= 86400"), ("between", ">=7200)(?t<90000", "BETWEEN 7200 AND 89999")):
    add(
        f"sequence_match_events_{_name}",
        TIMED.format(test=_sql) + f"SELECT u.user_id, COALESCE(f.at, {NO_TIMES}) AS at FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN f USING (user_id)",
        lambda e, t=_test: _micros(e.groupBy("user_id").agg(E.sequence_match_events(f"(?1).*(?t{t})(?2)", "ts", SIGNUP, ERROR).alias("at"))),
    )
    add(
        f"sequence_wildcard_time_{_name}",
        TIMED.format(test=_sql) + "SELECT DISTINCT user_id, user_id IN (SELECT user_id FROM f) AS matched FROM events",
        lambda e, t=_test: e.groupBy("user_id").agg(E.sequence_match(f"(?1).*(?t{t})(?2)", "ts", SIGNUP, ERROR).alias("matched")),
    )
add(
    "sequence_match_events_adjacent",
    """WITH n AS (SELECT user_id, ts, event_type, LEAD(ts) OVER w AS t2, LEAD(event_type) OVER w AS e2 FROM events WHERE event_type IN ('view', 'click')
                  WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       f AS (SELECT user_id, arg_min([epoch_us(ts), epoch_us(t2)], ts) AS at FROM n WHERE event_type = 'view' AND e2 = 'click' GROUP BY 1)
       SELECT u.user_id, COALESCE(f.at, CAST([] AS BIGINT[])) AS at FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN f USING (user_id)""",
    lambda e: _micros(e.groupBy("user_id").agg(E.sequence_match_events("(?1)(?2)", "ts", VIEW, CLICK).alias("at"))),
)
add(
    "step_times",
    TIMES + """SELECT user_id, t1 AS time_1, t2 AS time_2, t3 AS time_3, (epoch_us(t2) - epoch_us(t1)) / 1e6 / 3600.0 AS hours_to_2,
        (epoch_us(t3) - epoch_us(t2)) / 1e6 / 3600.0 AS hours_to_3 FROM c WHERE t3 IS NOT NULL""",
    lambda e: R.step_times(e, ["user_id"], "(?1).*(?2).*(?3)", "ts", (SIGNUP, CLICK, ERROR), 3),
)

# --- next node ------------------------------------------------------------------------
NEIGHBOURS = """
WITH o AS (SELECT *, LEAD(props) OVER w AS nxt, LAG(props) OVER w AS prv FROM (SELECT user_id, ts, event_type, NULLIF(props, '{"k": 7}') AS props FROM events)
           WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT * FROM o WHERE event_type IN ('purchase', 'signup'))
"""
_PROPS, _BASE = """nullif(props, '{"k": 7}')""", f"{BUY} OR {SIGNUP}"
for _way, _col in (("forward", "nxt"), ("backward", "prv")):
    for _base in ("head", "tail", "first_match", "last_match"):
        _first = _base == "head" or _base != "tail" and (_way == "forward") == (_base == "first_match")
        _pick = "ASC" if _first else "DESC"
        _where = f"WHERE event_type = 'purchase' AND {_col} IS NOT NULL" if "match" in _base else ""
        add(
            f"next_node_{_way}_{_base}",
            NEIGHBOURS + f"""SELECT u.user_id, CASE WHEN f.event_type = 'purchase' THEN f.{_col} END AS node FROM (SELECT DISTINCT user_id FROM events) u
                LEFT JOIN (SELECT * FROM b {_where} QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts {_pick}) = 1) f USING (user_id)""",
            lambda e, w=_way, b=_base: e.groupBy("user_id").agg(E.sequence_next_node(w, b, "ts", _PROPS, _BASE, BUY).alias("node")),
        )
        _cmp, _agg, _side = (">", "MIN", "nxt") if _way == "forward" else ("<", "MAX", "prv")
        _keep = "WHERE node IS NOT NULL" if "match" in _base else ""
        add(
            f"next_node_{_way}_{_base}_chain",
            NEIGHBOURS + f""", c1 AS (SELECT b.*, CASE WHEN event_type = 'purchase' THEN
                    (SELECT {_agg}(ts) FROM o WHERE o.user_id = b.user_id AND o.event_type = 'view' AND o.ts {_cmp} b.ts) END AS t2 FROM b),
                c2 AS (SELECT c1.*, (SELECT {_agg}(ts) FROM o WHERE o.user_id = c1.user_id AND o.event_type = 'error' AND o.ts {_cmp} c1.t2) AS t3 FROM c1),
                c3 AS (SELECT c2.user_id, c2.ts, o.{_side} AS node FROM c2 LEFT JOIN o ON o.user_id = c2.user_id AND o.ts = c2.t3)
                SELECT u.user_id, f.node FROM (SELECT DISTINCT user_id FROM events) u
                LEFT JOIN (SELECT * FROM c3 {_keep} QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts {_pick}) = 1) f USING (user_id)""",
            lambda e, w=_way, b=_base: e.groupBy("user_id").agg(E.sequence_next_node(w, b, "ts", _PROPS, _BASE, BUY, VIEW, ERROR).alias("node")),
        )
add(
    "flow",
    """WITH o AS (SELECT *, LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events),
       f AS (SELECT user_id, arg_min(nxt, ts) AS node FROM o WHERE event_type = 'error' AND nxt IS NOT NULL GROUP BY 1)
       SELECT COALESCE(node, '(end)') AS node, COUNT(*) AS users, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 1) AS pct
       FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN f USING (user_id) GROUP BY 1""",
    lambda e: R.flow(e, ["user_id"], "forward", "first_match", "ts", "event_type", ERROR, [ERROR]),
)

# --- combined -------------------------------------------------------------------------
add(
    "ab_comparison",
    CHAIN + """, n AS (SELECT user_id, ts, event_type, LEAD(ts) OVER w AS t2, LEAD(event_type) OVER w AS e2 FROM events WHERE event_type IN ('view', 'click', 'purchase')
                   WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        q AS (SELECT DISTINCT user_id FROM n WHERE event_type = 'view' AND e2 = 'click' AND (epoch_us(t2) - epoch_us(ts)) // 1000000 <= 7200)
        SELECT user_id % 2 AS test_group, COUNT(*) AS users, ROUND(AVG(step), 2) AS avg_depth, COUNT(*) FILTER (step = 3) AS completed,
               ROUND(100.0 * COUNT(*) FILTER (step = 3) / COUNT(*), 1) AS complete_pct, COUNT(q.user_id) AS fast_completers
        FROM f LEFT JOIN q USING (user_id) GROUP BY 1""",
    lambda e: R.ab_comparison(e.withColumn("test_group", F.col("user_id") % 2), ["user_id"], "test_group", "ts", DAY, STEPS, "(?1)(?t<=7200)(?2)"),
)
add(
    "session_funnel",
    SESSIONS.replace("6 HOUR", "24 HOUR") + """, x AS (SELECT user_id, session_id, ts, event_type FROM s),
        a AS (SELECT user_id, session_id, ts AS t1 FROM x WHERE event_type = 'view'),
        b AS (SELECT a.*, (SELECT MIN(ts) FROM x WHERE x.user_id = a.user_id AND x.session_id = a.session_id AND event_type = 'click' AND ts > t1 AND ts <= t1 + INTERVAL 1 DAY) AS t2 FROM a)
        SELECT u.user_id, u.session_id, CAST(COALESCE(MAX(CASE WHEN t2 IS NOT NULL THEN 2 WHEN t1 IS NOT NULL THEN 1 END), 0) AS INTEGER) AS step
        FROM (SELECT DISTINCT user_id, session_id FROM x) u LEFT JOIN b USING (user_id, session_id) GROUP BY 1, 2""",
    lambda e: R.session_funnel(e, ["user_id"], "ts", "24 hours", DAY, (VIEW, CLICK)),
)
add(
    "power_users",
    CHAIN + """, t AS (SELECT user_id, string_agg(left(event_type, 1), '' ORDER BY ts) AS code FROM events GROUP BY 1)
        SELECT user_id, CAST(len(regexp_extract_all(code, 'v.*?c')) AS BIGINT) AS view_click, CAST(len(regexp_extract_all(code, 'c.*?p')) AS BIGINT) AS click_buy,
               step AS funnel_depth FROM t JOIN f USING (user_id) ORDER BY click_buy DESC, user_id LIMIT 20""",
    lambda e: R.power_users(e, ["user_id"], "ts", {"view_click": ("(?1).*(?2)", (VIEW, CLICK)), "click_buy": ("(?1).*(?2)", (CLICK, BUY))}, DAY, STEPS),
)
add(
    "scorecard",
    CHAIN + CODED.replace("WITH t AS", ", t AS") + """, k AS (SELECT user_id, COUNT(*) AS events, MIN(ts) AS first_seen, MAX(ts) AS last_seen,
            bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p FROM events GROUP BY 1)
        SELECT user_id, events, first_seen, last_seen, step, regexp_matches(code, 'v.*?p') AS matched,
               CAST(len(regexp_extract_all(code, 'v.*?p')) AS BIGINT) AS matches, [v, v AND c, v AND p] AS met
        FROM k JOIN f USING (user_id) JOIN t USING (user_id)""",
    lambda e: R.scorecard(e, ["user_id"], "ts", DAY, STEPS, "(?1).*(?3)"),
)

# --- conditions that overlap, timestamps that are null ----------------------------------
#: Codes of the events of 0 or more of two overlapping conditions: a, b, or c for both.
OVERLAPPING = """
WITH t AS (SELECT user_id, COALESCE(string_agg(CASE WHEN event_type = 'click' THEN CASE WHEN value > 50 THEN 'c' ELSE 'a' END WHEN value > 50 THEN 'b' END, '' ORDER BY ts), '') AS code
           FROM events GROUP BY user_id)
"""
add(
    "sequence_overlapping",
    OVERLAPPING + "SELECT user_id, regexp_matches(code, '[ac].*?[bc]') AS matched, CAST(len(regexp_extract_all(code, '[ac].*?[bc]')) AS BIGINT) AS matches FROM t",
    lambda e: R.pattern_by_user(e, ["user_id"], "(?1).*(?2)", "ts", (CLICK, "value > 50")),
)
add(
    "null_timestamps",
    SESSIONS.replace("FROM events", "FROM (SELECT * FROM events WHERE event_type <> 'error')") + """,
        k AS (SELECT user_id, MAX(session_id) AS sessions FROM s GROUP BY 1),
        n AS (SELECT user_id, event_type, LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS e2 FROM events WHERE event_type IN ('view', 'click')),
        q AS (SELECT user_id, COUNT(*) AS matches FROM n WHERE event_type = 'view' AND e2 = 'click' GROUP BY 1)
        SELECT u.user_id, sessions, COALESCE(matches, 0) AS matches, CAST(COALESCE(step, 0) AS INTEGER) AS step
        FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN k USING (user_id) LEFT JOIN q USING (user_id)
        LEFT JOIN (SELECT user_id, MAX(CASE WHEN event_type = 'view' THEN 1 END) AS step FROM events GROUP BY 1) USING (user_id)""",
    lambda e: (lambda nulled: nulled.groupBy("user_id").agg(
        E.sequence_count("(?1)(?2)", "ts", VIEW, CLICK).alias("matches"), E.window_funnel("1 day", "ts", VIEW, ERROR).alias("step"),
    ).join(E.session_count(nulled, "ts", GAP, ["user_id"]), "user_id"))(e.withColumn("ts", F.when(F.col("event_type") != "error", F.col("ts")))),
)

# --- the SQL front end, and groups of any size ------------------------------------------
def add_sql(name: str, sql: str, text: str) -> None:
    """Register a query that calls the functions by name in SQL."""
    from eventlens.plans.sqlfront import sql as run

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        view = f"events_{zlib.crc32(sf_dir.encode()):x}"
        events(spark, sf_dir).createOrReplaceTempView(view)
        return run(spark, text.replace("{events}", view))

    QUERIES[name], ORACLES[name] = query, sql


add_sql(
    "sql_visits",
    SESSIONS.replace("INTERVAL 6 HOUR", "INTERVAL 90 MINUTE") + "SELECT user_id, session_id, COUNT(*) AS events, SUM(value) > 100 AS large FROM s WHERE user_id % 2 = 0 GROUP BY ALL",
    """SELECT user_id, session_id, COUNT(*) AS events, SUM(value) > 100 AS large FROM
        (SELECT *, sessionize(ts, INTERVAL '90 minutes') OVER (PARTITION BY user_id ORDER BY ts) AS session_id FROM {events} WHERE user_id % 2 = 0) GROUP BY user_id, session_id""",
)
add_sql(
    "sql_big_spenders_return",
    """WITH u AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 80) AS a, bool_or(event_type = 'error') AS b, bool_or(value < 1) AS c FROM events GROUP BY 1)
        SELECT a, COUNT(*) AS users, COUNT(*) FILTER (a AND b) AS failed, COUNT(*) FILTER (a AND c) AS small FROM u GROUP BY a""",
    f"""SELECT r[0] AS a, COUNT(*) AS users, COUNT_IF(r[1]) AS failed, COUNT_IF(r[2]) AS small FROM
        (SELECT user_id, retention({BUY} AND value > 80, {ERROR}, value < 1) AS r FROM {{events}} GROUP BY user_id) GROUP BY r[0]""",
)
add_sql(
    "sql_signup_funnel",
    CHAIN.replace("'view'", "'signup'").replace("'click'", "'view'").replace("INTERVAL 1 DAY", "INTERVAL 3 DAY") + "SELECT step, COUNT(*) AS users FROM f GROUP BY step",
    f"SELECT step, COUNT(*) AS users FROM (SELECT user_id, window_funnel(INTERVAL '3 days', ts, {SIGNUP}, {VIEW}, {BUY}) AS step FROM {{events}} GROUP BY user_id) GROUP BY step",
)
add_sql(
    "sql_error_then_purchase",
    """WITH n AS (SELECT user_id, ts, event_type, LEAD(ts) OVER w AS t2, LEAD(event_type) OVER w AS e2 FROM events WHERE event_type IN ('error', 'purchase')
                  WINDOW w AS (PARTITION BY user_id ORDER BY ts))
       SELECT user_id, COUNT(*) FILTER (event_type = 'error' AND e2 = 'purchase' AND (epoch_us(t2) - epoch_us(ts)) // 1000000 > 1800) > 0 AS slow FROM
       (SELECT * FROM n UNION ALL SELECT user_id, NULL, NULL, NULL, NULL FROM events) GROUP BY user_id""",
    f"SELECT user_id, sequence_match('(?1)(?t>1800)(?2)', ts, {ERROR}, {BUY}) AS slow FROM {{events}} GROUP BY user_id",
)
add_sql(
    "sql_click_runs",
    CODED + "SELECT user_id, CAST(len(regexp_extract_all(code, 'ccc')) AS BIGINT) AS triples FROM t",
    f"SELECT user_id, sequence_count('(?2)(?2)(?2)', ts, {VIEW}, {CLICK}, {BUY}) AS triples FROM {{events}} GROUP BY user_id",
)
add_sql(
    "sql_hours_to_error",
    TIMES + "SELECT user_id, CAST(floor((epoch_us(t3) - epoch_us(t1)) / 3.6e9) AS BIGINT) AS hours FROM c WHERE t3 IS NOT NULL",
    f"""SELECT user_id, CAST(floor((unix_micros(CAST(at[2] AS TIMESTAMP)) - unix_micros(CAST(at[0] AS TIMESTAMP))) / 3.6e9) AS BIGINT) AS hours FROM
        (SELECT user_id, sequence_match_events('(?1).*(?2).*(?3)', ts, {SIGNUP}, {CLICK}, {ERROR}) AS at FROM {{events}} GROUP BY user_id) WHERE size(at) = 3""",
)
add_sql(
    "sql_after_last_error",
    """WITH o AS (SELECT user_id, ts, event_type, LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events),
       l AS (SELECT user_id, arg_max(nxt, ts) FILTER (nxt IS NOT NULL) AS node FROM o WHERE event_type = 'error' GROUP BY 1)
       SELECT u.user_id, l.node FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN l USING (user_id)""",
    f"SELECT user_id, sequence_next_node('forward', 'last_match', ts, event_type, {ERROR}, {ERROR}) AS node FROM {{events}} GROUP BY user_id",
)
for _m in (Mode.STRICT_ORDER, Mode.STRICT_INCREASE, Mode.ALLOW_REENTRY):
    add(f"large_funnel_{_m.name.lower()}", walk_sql(_m), lambda e, m=_m: large_funnel(e, ["user_id"], "2 days", "ts", *WIDE, mode=m))
for _way in ("forward", "backward"):
    for _base in ("tail", "first_match"):
        _like = f"next_node_{_way}_{_base}_chain"
        add(f"large_next_node_{_way}_{_base}", ORACLES[f"next_node_{_way}_{_base}"], lambda e, w=_way, b=_base: large_next_node(e, ["user_id"], w, b, "ts", _PROPS, _BASE, BUY))
        add(f"large_{_like}", ORACLES[_like], lambda e, w=_way, b=_base: large_next_node(e, ["user_id"], w, b, "ts", _PROPS, _BASE, BUY, VIEW, ERROR))
add("large_chain_count", CODED + "SELECT user_id, CAST(len(regexp_extract_all(code, 'v.*?c.*?p')) AS BIGINT) AS matches FROM t", lambda e: large_chain_count(e, ["user_id"], "(?1).*(?2).*(?3)", "ts", *STEPS))
