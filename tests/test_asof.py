import datetime as dt
import random

import pytest

from quarterloom.operators.asof import asof_known

D = dt.date(2020, 1, 1)


def brute(events, versions):
    out = []
    for e, day, key in events:
        known = [(y, r, v) for ve, known_on, y, r, v in versions if e is not None and ve == e and day is not None and known_on is not None and known_on <= day]
        best = max(known, key=lambda x: (x[0], x[1], (x[2] is not None, x[2] or 0))) if known else None
        out.append((e, day, key, None if best is None else best[2], best is not None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("span,hot", [(366, 500_000), (10, 5), (1, 3), (5000, 2)])
def test_against_brute_force(spark, span, hot):
    rng = random.Random(span)
    day = lambda: rng.choice([None, *[D + dt.timedelta(days=rng.randrange(400)) for _ in range(9)]])
    ent = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    events = [(ent(), day(), rng.randrange(50)) for _ in range(120)]
    events += events[:5]
    versions = [(ent(), day(), rng.randrange(4), rng.randrange(3), rng.choice([None, 1.0, 2.0])) for _ in range(40)]
    e = spark.createDataFrame(events, "ent string, day date, v int")
    v = spark.createDataFrame(versions, "ent string, known_on date, y int, r int, v double")
    got = asof_known(e, v, "ent", "day", "known_on", ["y", "r"], ["v"], span_days=span, hot_rows=hot)
    have = sorted(((r["ent"], r["day"], r["v"], r["known"]["v"] if r["known"] else None, r["known"] is not None) for r in got.collect()), key=repr)
    assert have == brute(events, versions)


def test_copies_clashing_names_and_empty(spark):
    e = spark.createDataFrame([("a", D, 1, "old")] * 3, "ent string, day date, revision int, known string")
    v = spark.createDataFrame([("a", D, 7), ("a", D + dt.timedelta(days=1), 9)], "ent string, known_on date, revision int")
    args = ("ent", "day", "known_on", ["revision"], ["revision"])
    r = asof_known(e, v, *args).collect()
    assert [(x["revision"], x["known"]["revision"]) for x in r] == [(1, 7)] * 3
    assert asof_known(e, v, *args, drop_copies=True).count() == 1
    assert [x["known"] for x in asof_known(e, v.limit(0), *args).collect()] == [None] * 3
    assert asof_known(e.limit(0), v, *args).count() == 0


@pytest.mark.parametrize("drop", [True, False])
def test_salt_does_not_depend_on_the_order_of_rows(spark, drop):
    """A task that is run again may get its rows in another order: no number of a row may be made in its plan."""
    events = [("a", D + dt.timedelta(days=i % 20), i) for i in range(60)] * 2
    versions = [("a", D + dt.timedelta(days=i), i, 0, float(i)) for i in range(20)]
    e = spark.createDataFrame(events, "ent string, day date, v int")
    v = spark.createDataFrame(versions, "ent string, known_on date, y int, r int, v double")
    got = asof_known(e, v, "ent", "day", "known_on", ["y", "r"], ["v"], span_days=366, hot_rows=10, drop_copies=drop)
    assert "monotonically_increasing_id" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted((r["ent"], r["day"], r["v"], r["known"]["v"], True) for r in got.collect())
    assert rows == sorted(brute(events[:60] if drop else events, versions))
