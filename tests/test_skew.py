import math
import random
from collections import Counter, defaultdict

from quarterloom.operators.skew import heavy_keys, key_percentiles, key_profile


def test_profile_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2, 2, 3, None, -5]), "x") for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v long, freq string")
    want = {}
    by = defaultdict(list)
    for k, v, _ in rows:
        by[k].append(v)
    for k, vs in by.items():
        c = Counter(v for v in vs if v is not None)
        top = max(c.values())
        want[k] = (len(vs), sum(c.values()), len(c), sum(v * n for v, n in c.items()), min(v for v, n in c.items() if n == top), top)
    assert {r[0]: tuple(r)[1:] for r in key_profile(df, ["k"], "v").collect()} == want
    got = {r[0]: r[1] for r in key_percentiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    for k, vs in by.items():
        s = sorted(v for v in vs if v is not None)
        assert got[k] == [s[max(math.ceil(round(p * len(s), 9)), 1) - 1] for p in (0.0, 0.1, 0.5, 0.9, 1.0)]


def test_only_missing_values(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan"))], "k string, v double")
    r = key_profile(df, ["k"], "v").collect()
    assert [tuple(x) for x in r] == [("a", 2, 0, 0, None, None, None)]
    assert key_percentiles(df, ["k"], "v", [0.5]).collect() == []


def test_text_values_and_empty(spark):
    df = spark.createDataFrame([("a", "x" * 100_000), ("a", ""), ("a", "")], "k string, v string")
    r = key_profile(df, ["k"], "v").first()
    assert (r["n_distinct"], r["total"], r["mode"], r["mode_freq"]) == (2, None, "", 2)
    empty = df.limit(0)
    assert key_profile(empty, ["k"], "v").count() == 0
    assert key_percentiles(empty, ["k"], "v", [0.5]).count() == 0
    assert heavy_keys(empty, "k", "v", "v", 0.1).count() == 0


def test_heavy_keys_count_copies_and_nulls(spark):
    rows = [("t", "a", 1)] * 5 + [("t", None, 1)] * 4 + [("t", "b", 2), ("u", "b", 1)]
    df = spark.createDataFrame(rows, "s string, k string, v int")
    got = {(r["s"], r["k"]): (r["n_rows"], r["share"]) for r in heavy_keys(df, "s", "k", "v", 0.5).collect()}
    assert got == {("t", "a"): (5, 0.5), ("u", "b"): (1, 1.0)}
