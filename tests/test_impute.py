import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterloom.operators.impute import als_impute, held_out_errors

R = {"a": (-1000.0, 1000.0), "b": (0.0, 1000.0)}


def low_rank(n, seed=0):
    rng = np.random.default_rng(seed)
    u, v = rng.normal(size=(n, 2)), rng.normal(size=(2, 4))
    return u @ v + 0.01 * rng.normal(size=(n, 4))


def test_held_out_cells_are_recovered(spark):
    x = low_rank(600)
    rng = random.Random(1)
    hidden = {(i, rng.randrange(2)) for i in range(0, 600, 5)}
    rows = [(f"e{i}", 1, *[None if (i, j) in hidden else float(x[i, j]) for j in range(4)]) for i in range(600)]
    df = spark.createDataFrame(rows, "e string, p int, a double, b double, c double, d double")
    wide = (-1e6, 1e6)
    got = {r["e"]: r for r in als_impute(df, "e", "p", {"a": wide, "b": wide}, {"c": wide, "d": wide}, rank=3, rounds=12, reg=0.05).collect()}
    err, base = [], []
    for i, j in hidden:
        r = got[f"e{i}"]
        assert r["ab"[j] + "_filled"]
        err.append(abs(r["ab"[j]] - x[i, j]))
        base.append(abs(np.mean(x[:, j]) - x[i, j]))
    assert np.median(err) < 0.35 * np.median(base)


def test_flags_origins_and_ranges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("x", 1, 5.0, 1.0), ("x", 2, nan, -9999.0), ("x", 3, inf, 2.0), ("x", 3, inf, 2.0), ("y", 1, None, 1e9), (None, 1, 1.0, 1.0), ("z", None, 1.0, 1.0)]
    df = spark.createDataFrame([(*r, True) for r in rows], "e string, p int, a double, b double, a_filled boolean")
    got = {(r["e"], r["p"]): r for r in als_impute(df, "e", "p", R, categorical=["p"]).collect()}
    assert set(got) == {("x", 1), ("x", 2), ("x", 3), ("y", 1)}
    flags = {k: (r["a_filled"], r["a_from"], r["b_filled"], r["b_from"]) for k, r in got.items()}
    assert flags == {("x", 1): (False, None, False, None), ("x", 2): (True, 1, True, 1), ("x", 3): (True, 1, False, 1), ("y", 1): (True, None, True, None)}
    assert got[("x", 1)]["a"] == 5.0 and got[("x", 3)]["a"] == pytest.approx(5.0)
    assert all(1.0 - 1e-9 <= r["b"] <= 2.0 + 1e-9 for r in got.values())


def test_categories_and_nothing_observed(spark):
    rows = [(f"e{i}", 1, float(i % 2) * 10, None, None if i == 7 else ("u" if i % 2 else "v"), "") for i in range(40)]
    df = spark.createDataFrame(rows, "e string, p int, a double, b double, c string, extra string")
    got = {r["e"]: r for r in als_impute(df, "e", "p", R, fill_categorical=["c"], rounds=8).collect()}
    assert got["e7"]["c"] == "u" and got["e7"]["c_filled"] and not got["e8"]["c_filled"]
    assert all(r["b"] is None and r["b_filled"] for r in got.values())
    assert als_impute(df.limit(0), "e", "p", R).count() == 0
    assert als_impute(df.filter(F.col("e") == "none"), "e", "p", R, categorical=["c"]).count() == 0


def test_better_than_the_last_value(spark):
    """a: a level and noise. b: a level and a shock in proportion to it that the context field c shows as well."""
    rng, rows = np.random.default_rng(3), []
    for e in range(150):
        la, lb = rng.normal(0, 20), 20 * np.exp(rng.normal())
        for p in range(12):
            shock = rng.normal()
            a = la + rng.normal()
            rows.append((f"e{e}", p, None if rng.random() < 0.1 else float(a), None if rng.random() < 0.1 else float(lb * np.exp(0.15 * shock + 0.01 * rng.normal())), float(10 * shock)))
    df = spark.createDataFrame(rows, "e string, p int, a double, b double, c double")
    wide = (-1e6, 1e6)
    got = {r["field_name"]: r for r in held_out_errors(df, "e", "p", {"a": wide, "b": wide}, {"c": wide}, reg=0.1, rounds=10).collect()}
    assert got["a"]["n"] > 40 and got["a"]["als"] < 0.9 * got["a"]["last"]
    assert got["b"]["belief"] > 0 and got["b"]["als"] < 0.8 * got["b"]["mid"] < got["b"]["last"]


def test_median_of_others_against_brute_force(spark):
    import statistics

    from quarterloom.operators.impute import _median_of_others

    rng = random.Random(4)
    rows = [([rng.choice([1.0, 2.0, 2.0, 5.0, -3.0, rng.random()]) for _ in range(rng.randrange(1, 7))], i) for i in range(60)]
    df = spark.createDataFrame([(v, None if i % 4 == 0 else v[i % len(v)], i) for v, i in rows], "v array<double>, own double, i int")
    for r in df.select("v", "own", "i", _median_of_others(F.sort_array("v"), F.col("own")).alias("m")).collect():
        rest = sorted(r["v"])
        if r["own"] is not None:
            rest.remove(r["own"])
        assert r["m"] == (statistics.median(rest) if rest else None)


def test_many_levels_stay_codes(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("e"), F.lit(1).alias("p"), (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 11 > 0, F.col("id") % 4000).cast("string").alias("c"))
    got = als_impute(df, "e", "p", {"a": (0.0, 10.0)}, fill_categorical=["c"], rounds=2)
    assert got.filter("c IS NULL").count() == 0 and got.filter("c_filled").count() == 1819
