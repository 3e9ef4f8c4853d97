import random

import pytest

from quarterloom.operators.history import build_history, new_store

SATS = {"a": ["t"], "b": ["s", "e"]}


def brute(rows):
    by = {}
    for c, y, t, s, e in rows:
        if c is None or y is None:
            continue
        cur = by.setdefault(c, {}).setdefault(y, [None, None, None])
        for i, v in enumerate((t, s, e)):
            if v is not None:
                cur[i] = v if cur[i] is None else max(cur[i], v)
    out = []
    for c, years in by.items():
        last, run = None, None
        for y in sorted(years):
            t, s, e = years[y]
            t = last = t if t is not None else last
            if run and run[1] == y - 1 and run[2:] == (t, s, e):
                run = (run[0], y, *run[2:])
            else:
                if run:
                    out.append((c, *run))
                run = (y, y, t, s, e)
        out.append((c, *run))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", "z", None]), rng.choice([*range(2013, 2022), None]), rng.choice(["T", "U", None]), rng.choice([1, 2, None]), rng.choice([None, None, 5])) for _ in range(60)]
    rows += rows[:10]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "c string, y int, t string, s int, e int, hash_diff string")
    got = build_history(df, "c", "y", SATS, carried=["t"])
    assert sorted(((r["c"], r["from_at"], r["to_at"], r["t"], r["s"], r["e"]) for r in got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("cuts", [[2016], [2014, 2015, 2019], list(range(2013, 2022))])
def test_several_loads_give_the_same_history(spark, cuts):
    rng = random.Random(8)
    rows = [(rng.choice("xyz"), rng.choice([y for y in range(2013, 2022) if y != 2017]), rng.choice(["T", "U", None]), rng.choice([1, 2, None]), rng.choice([None, None, 5])) for _ in range(70)]
    df = spark.createDataFrame(rows, "c string, y int, t string, s int, e int").cache()
    store, low = new_store(spark, "c", "y", SATS, carried=["t"]), 0
    for high in [*cuts, 9999]:
        store.load(df.filter(f"y > {low} AND y <= {high}"))
        low = high
    got = store.versions()
    assert sorted(((r["c"], r["from_at"], r["to_at"], r["t"], r["s"], r["e"]) for r in got.collect()), key=repr) == brute(rows)
    with pytest.raises(ValueError):
        store.load(df)


def test_satellites_only_grow_on_change(spark):
    df = spark.createDataFrame([("x", y, "T" if y < 3 else "U", 1) for y in range(6)] + [("z", 1, None, None)], "c string, y int, t string, s int")
    store = new_store(spark, "c", "y", {"a": ["t"], "b": ["s"]})
    store.load(df.filter("y < 3"))
    rows = lambda n: sorted((r["c"], r["y"]) for r in store.table(n).collect())
    before = set(store.table("a").inputFiles())
    assert rows("a") == rows("b") == [("x", 0), ("z", 1)]
    store.load(df.filter("y >= 3"))
    assert rows("a") == [("x", 0), ("x", 3), ("z", 1)] and rows("b") == [("x", 0), ("z", 1)]
    assert before < set(store.table("a").inputFiles())  # nothing was rewritten
    assert sorted((r["c"], r["y"], r["here"]) for r in store.table("presence").collect()) == [("x", 0, True), ("z", 1, True), ("z", 2, False)]


def test_hash_keeps_different_rows_apart(spark):
    pairs = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("ab", None), ("-", None), (None, "-"), ("1:a", "b"), ("a1:", "b")]
    rows = [("x", i, *p) for i, p in enumerate(pairs)]
    got = build_history(spark.createDataFrame(rows, "c string, y int, t string, u string"), "c", "y", {"a": ["t", "u"]})
    assert got.count() == len(pairs)


def test_empty(spark):
    df = spark.createDataFrame([], "c string, y int, t string, s int, e int")
    assert build_history(df, "c", "y", SATS, carried=["t"]).count() == 0
