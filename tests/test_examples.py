"""Whole SQL queries in the shapes people write them, on small tables with results worked out by hand."""

import datetime as dt

import pytest

from eventlens.plans.sqlfront import sql

DAY = dt.datetime(2024, 5, 6)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


@pytest.fixture(scope="module")
def run(spark):
    tables = {
        "readings": (  # meters that send a value now and then
            "meter string, sent timestamp_ntz, kw double",
            [("north", at(0), 1.5), ("north", at(0.4), 9.0), ("north", at(0.5), 0.1), ("north", at(7), 2.0), ("south", at(1), 4.0), ("south", at(2), 4.5), ("south", None, 1.0)],
        ),
        "plays": (  # songs by listener; skipped ones end early
            "listener int, began timestamp_ntz, song string, skipped boolean",
            [(1, at(1), "ode", False), (1, at(1.1), "hymn", True), (1, at(1.2), "hymn", True), (1, at(1.3), "march", False), (1, at(1.4), "hymn", True),
             (2, at(2), "march", False), (2, at(2.5), "ode", True), (2, at(3), "ode", False), (3, at(5), "waltz", True)],
        ),
        "parcels": (  # scans on the way of a parcel
            "parcel string, scanned timestamp_ntz, place string",
            [("p1", at(0), "depot"), ("p1", at(6), "hub"), ("p1", at(7), "hub"), ("p1", at(30), "van"), ("p1", at(33), "door"),
             ("p2", at(1), "depot"), ("p2", at(50), "van"), ("p2", at(51), "depot"), ("p2", at(52), "van"), ("p2", at(52.5), "door"),
             ("p3", at(2), "hub"), ("p3", at(3), "door")],
        ),
        "lessons": (  # pupils' lessons of a course of three units
            "pupil int, day int, unit int, passed boolean",
            [(1, 1, 1, True), (1, 2, 2, True), (1, 9, 3, None), (2, 1, 1, False), (2, 3, 1, True), (2, 4, 3, True), (3, 2, 2, True)],
        ),
        "pages": (
            "who int, at timestamp_ntz, page string, device string",
            [(1, at(1), "home", "web"), (1, at(1.2), "product", "web"), (1, at(1.3), "cart", "web"), (1, at(9), "home", "web"), (2, at(1), "product", "app"), (2, at(2), "home", "app"), (3, at(5), "home", "web")],
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).createOrReplaceTempView(f"ex_{name}")
    return lambda text: [tuple(r) for r in sql(spark, text).collect()]


def test_outages_of_meters(run):
    """Stretches of readings less than 25 minutes apart, and the power used in each."""
    text = """SELECT meter, stretch, COUNT(*) AS readings, MAX(kw) AS peak
        FROM (SELECT meter, kw, sessionize(sent, INTERVAL '25 minutes') OVER (PARTITION BY meter ORDER BY sent) AS stretch FROM ex_readings WHERE sent IS NOT NULL)
        GROUP BY meter, stretch ORDER BY meter, stretch"""
    assert run(text) == [("north", 1, 3, 9.0), ("north", 2, 1, 2.0), ("south", 1, 1, 4.0), ("south", 2, 1, 4.5)]


def test_units_passed(run):
    """Share of those who passed the first unit who passed each other one; null grades don't count."""
    text = """SELECT COUNT_IF(r[0]) AS began, COUNT_IF(r[1]) AS second, COUNT_IF(r[2]) AS third FROM
        (SELECT pupil, retention(unit = 1 AND passed, unit = 2 AND passed, unit = 3 AND passed) AS r FROM ex_lessons GROUP BY pupil)"""
    assert run(text) == [(2, 1, 1)]


def test_skipping_streaks(run):
    text = "SELECT listener, sequence_count('(?1)(?1)', began, skipped, NOT skipped) AS n, sequence_match('(?2)(?1).*(?2)', began, skipped, NOT skipped) AS m FROM ex_plays GROUP BY listener ORDER BY listener"
    assert run(text) == [(1, 1, True), (2, 0, True), (3, 0, False)]


def test_slow_legs_of_parcels(run):
    """A van that leaves 12 to 48 hours after a hub, whatever is scanned between; and the times of that leg."""
    text = """SELECT parcel, sequence_match('(?1).*(?t>=43200)(?t<172800)(?2)', scanned, place = 'hub', place = 'van') AS slow,
               transform(sequence_match_events('(?1).*(?t>=43200)(?t<172800)(?2)', scanned, place = 'hub', place = 'van'), t -> hour(t)) AS hours
        FROM ex_parcels GROUP BY parcel ORDER BY parcel"""
    assert run(text) == [("p1", True, [6, 6]), ("p2", False, []), ("p3", False, [])]


def test_delivery_depth_by_strictness(run):
    """Depot, van, door within two days: from any depot scan, and without going back to the depot."""
    steps = "place = 'depot', place = 'van', place = 'door'"
    text = f"""SELECT parcel, window_funnel(INTERVAL '2 days', scanned, {steps}) AS free, window_funnel(INTERVAL '1 hour', scanned, {steps}) AS quick,
               window_funnel(INTERVAL '3 days', 'strict_order', scanned, {steps}) AS ordered FROM ex_parcels GROUP BY parcel ORDER BY parcel"""
    assert run(text) == [("p1", 3, 1, 3), ("p2", 3, 2, 3), ("p3", 0, 0, 0)]


def test_what_is_played_around_a_song(run):
    text = "SELECT listener, sequence_next_node('backward', 'first_match', began, song, song = 'hymn' OR song = 'ode', skipped) AS n FROM ex_plays GROUP BY listener ORDER BY listener"
    assert run(text) == [(1, "march"), (2, "march"), (3, None)]
    text = "SELECT listener, sequence_next_node('forward', 'head', began, song, true, NOT skipped, skipped) AS n FROM ex_plays GROUP BY listener ORDER BY listener"
    assert run(text) == [(1, "hymn"), (2, "ode"), (3, None)]


def test_functions_are_registered_once(spark, run):
    """The same call twice leaves one function in the session."""
    count = lambda: spark.sql("SHOW USER FUNCTIONS LIKE 'eventlens_*'").count()
    text = "SELECT sequence_match('(?1)(?t<77)(?2)', began, skipped, NOT skipped) AS m FROM ex_plays"
    run(text)
    known = count()
    run(text)
    assert count() == known


def test_drop_off_report(run):
    text = """WITH f AS (SELECT who, window_funnel(INTERVAL '1 hour', at, page = 'home', page = 'product', page = 'cart') AS step FROM ex_pages GROUP BY who)
        SELECT step, COUNT(*) AS users, ROUND(100D * COUNT(*) / SUM(COUNT(*)) OVER (), 1) AS pct FROM f GROUP BY step ORDER BY step"""
    assert run(text) == [(1, 2, 66.7), (3, 1, 33.3)]


def test_session_metrics_and_segments(run):
    text = """WITH s AS (SELECT *, sessionize(at, INTERVAL '30 minutes') OVER (PARTITION BY who ORDER BY at) AS session_id FROM ex_pages)
        SELECT who, session_id, COUNT(*) AS views, COUNT(*) = 1 AS bounce, min_by(page, at) AS entry,
               window_funnel(INTERVAL '1 hour', at, page = 'home', page = 'product') AS step FROM s GROUP BY ALL ORDER BY 1, 2"""
    assert run(text) == [(1, 1, 3, False, "home", 2), (1, 2, 1, True, "home", 1), (2, 1, 1, True, "product", 0), (2, 2, 1, True, "home", 1), (3, 1, 1, True, "home", 1)]
    text = """SELECT device, COUNT(*) AS users, ROUND(AVG(step), 2) AS depth FROM
        (SELECT who, device, window_funnel(INTERVAL '1 hour', at, page = 'home', page = 'product') AS step FROM ex_pages GROUP BY who, device) GROUP BY device ORDER BY device"""
    assert run(text) == [("app", 1, 1.0), ("web", 2, 1.5)]


def test_join_of_two_functions(run):
    text = """WITH f AS (SELECT who, window_funnel(INTERVAL '2 hours', at, page = 'home', page = 'product') AS step FROM ex_pages GROUP BY who),
             q AS (SELECT who, sequence_match('(?1).*(?t<=1800)(?2)', at, page = 'home', page = 'product') AS fast FROM ex_pages GROUP BY who)
        SELECT step, COUNT(*) AS users, COUNT_IF(fast) AS quick FROM f JOIN q ON f.who = q.who GROUP BY step ORDER BY step"""
    assert run(text) == [(1, 2, 0), (2, 1, 1)]


def test_top_users(run):
    text = """SELECT who, sequence_count('(?1).*(?2)', at, page = 'home', page = 'cart') AS n, window_funnel(INTERVAL '1 day', at, page = 'home', page = 'cart') AS f
        FROM ex_pages GROUP BY who ORDER BY n DESC, who LIMIT 2"""
    assert run(text) == [(1, 1, 2), (2, 0, 1)]
