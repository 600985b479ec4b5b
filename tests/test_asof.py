import random
from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.operators import asof

VERSIONS = "key string, id string, valid_from date, valid_to date, attributes map<string,string>, _period string"
EVENTS = "event string, key string, on date, changes string, snapshot int"


def brute(versions, key, on):
    if key is None or on is None:
        return None
    open_ = [v for v in versions if v[0] == key and (v[2] is None or v[2] <= on) and (v[3] is None or v[3] >= on)]
    # the latest start, NULL the earliest; then the smaller id
    return min(open_, key=lambda v: (-(v[2] or date.min).toordinal(), v[1]))[1] if open_ else None


def run(spark, versions, events, years):
    v = spark.createDataFrame([(*x, {"n": x[1]}, "clash") for x in versions], VERSIONS)
    e = spark.createDataFrame([(*x, "kept", 7) for x in events], EVENTS)
    known = asof.build(v, "key", "id", "valid_from", "valid_to", ["attributes"], years)
    rows = asof.attach(e, known, F.col("key"), F.col("on")).collect()
    assert all(r.changes == "kept" and r.snapshot == 7 for r in rows)
    assert all(r.as_known is None or r.as_known.attributes["n"] == r.as_known.version for r in rows)
    return {r.event: r.as_known and r.as_known.version for r in rows}


def test_against_brute_force(spark):
    rng = random.Random(4)
    day = lambda: None if rng.random() < 0.15 else date(1980, 1, 1) + timedelta(days=rng.randrange(15000))
    versions = [(rng.choice(["a", "b", "c", None]), f"v{i}", day(), day()) for i in range(60)]
    events = [(f"e{i}", rng.choice(["a", "b", "c", "absent", None]), day()) for i in range(300)]
    for years in (1, 10, 40):
        assert run(spark, versions, events, years) == {e: brute(versions, k, on) for e, k, on in events}


dates = st.one_of(st.none(), st.dates(date(1999, 12, 1), date(2001, 2, 1)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["x", "y", "z"]), dates, dates), max_size=8), st.lists(dates, min_size=1, max_size=8))
def test_edges_of_windows(spark, versions, days):
    versions = [(k, f"{i}{n}", a, b) for n, (k, i, a, b) in enumerate(versions)]
    events = [(f"e{n}", "a", d) for n, d in enumerate(days)]
    assert run(spark, versions, events, 1) == {e: brute(versions, k, on) for e, k, on in events}


def test_empty_and_repeated(spark):
    assert run(spark, [], [("e", "a", date(2000, 1, 1))], 10) == {"e": None}
    twice = [("a", "v", date(2000, 1, 1), None)] * 2
    assert run(spark, twice, [("e", "a", date(2000, 1, 1)), ("f", "a", date(1999, 12, 31))], 10) == {"e": "v", "f": None}
    assert run(spark, twice, [], 10) == {}


def test_nothing_later_is_known(spark):
    """Adding versions that start after every event changes nothing."""
    versions = [("a", "v1", date(2000, 1, 1), None), ("a", "v2", None, date(2010, 1, 1))]
    events = [("e", "a", date(2005, 5, 5)), ("f", "a", date(1990, 5, 5))]
    assert run(spark, versions, events, 10) == run(spark, [*versions, ("a", "v0", date(2006, 1, 1), None)], events, 10)


def test_latest_delivery(spark):
    rows = spark.createDataFrame([("a", 1, {"x": "old"}), ("a", 2, {"x": "new"}), ("b", None, None), ("a", 2, {"x": "new"})], "k string, at int, m map<string,string>")
    got = {r.k: (r.at, r.m) for r in asof.latest_delivery(rows, "k", "at").collect()}
    assert got == {"a": (2, {"x": "new"}), "b": (None, None)}
