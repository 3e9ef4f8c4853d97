"""Small cases of the semantics that are easy to get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quarterloom.functions.keys import accession_key, cik_key, cusip_key, ticker_key
from quarterloom.operators import backtest as B
from quarterloom.operators import fundamentals as N
from quarterloom.operators import graph as G
from quarterloom.operators import holdings as H
from quarterloom.operators import linkpred as L
from quarterloom.operators import metrics as M
from quarterloom.operators import profile as P
from quarterloom.operators import reports as R
from quarterloom.operators import universe as U


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn("x")).first()[0]


@pytest.mark.parametrize("fn,given,want", [
    (cik_key, " CIK0007283007", "0007283007"), (cik_key, "7234736.0", "0007234736"), (cik_key, "", None), (cik_key, None, None), (cik_key, "000", "0000000000"),
    (cusip_key, " 1234a ", "00001234A"), (cusip_key, "", None), (cusip_key, None, None),
    (ticker_key, " abc.US", "ABC"), (ticker_key, " ", None), (accession_key, "000762520019000000 ", "0007625200-19-000000"), (accession_key, "12", None),
])
def test_keys(spark, fn, given, want):
    assert one(spark, given, fn) == want


def test_weights_leave_out_worthless_rows_first(spark):
    v = spark.createDataFrame([("f", "a", 1, 30.0), ("f", "b", 1, 70.0), ("f", "c", 1, 5e-7)], "cik string, cusip string, p int, pv double")
    assert {r["cusip"]: r["weight"] for r in H.weights(v).collect()} == {"a": 0.3, "b": 0.7}


def test_interval_is_closed_and_fans_out(spark):
    left = spark.createDataFrame([("x", p) for p in (1, 2, 3, 4)], "k string, p int")
    right = spark.createDataFrame([("x", 2, 3, "T"), ("x", 3, None, "U")], "k string, s int, e int, t string")
    got = H.interval_join(left, right, "k", "p", "s", "e").collect()
    assert sorted((r["p"], r["t"]) for r in got) == [(2, "T"), (3, "T"), (3, "U"), (4, "U")]
    assert sorted(r["p"] for r in H.interval_join(left, right, "k", "p", "s", "e", "left_semi").collect()) == [2, 3, 4]


def test_returns_bridge_gaps_and_guard_logs(spark):
    px = spark.createDataFrame([("a", 1, 2.0), ("a", 3, 4.0), ("a", 4, 0.0)], "cusip string, p int, price double")
    got = {r["p"]: (r["ret"], r["log_return"]) for r in H.returns(px).collect()}
    assert got == {3: (2.0, math.log(2.0)), 4: (0.0, None)}


def test_deltas(spark):
    w = spark.createDataFrame([("f", "a", 1, 10, 1.0), ("f", "b", 3, 5, 0.5), ("f", "b", 3, 5, 0.5), ("g", "a", 3, 1, 1.0)], "cik string, cusip string, p int, shares long, weight double")
    aum = spark.createDataFrame([("f", 1, 100.0), ("f", 3, 50.0), ("g", 3, 9.0)], "cik string, p int, total double")
    got = {(r["cik"], r["cusip"], r["p"]): tuple(r)[3:] for r in H.deltas(w, aum).collect()}
    assert got == {("f", "a", 3): (-10, -1.0, -1.0), ("f", "b", 3): (10, 1.0, 0.5)}


def test_churn_counts_the_close_out(spark):
    w = spark.createDataFrame([("f", "a", 1, 1.0)], "cik string, cusip string, p int, weight double")
    r = P.churn(w, last=1).collect()
    assert [tuple(x) for x in r] == [("f", 2, 0.5, None, 1.0)]


def test_islands(spark):
    w = spark.createDataFrame([("f", "a", p) for p in (1, 2, 3, 5, 6)], "cik string, cusip string, p int")
    assert P.holding_duration(w).first()["avg_holding_duration"] == 2.5


def test_missing_metric_fails_a_bound(spark):
    p = spark.createDataFrame([("f", None), ("g", 3.0)], "cik string, m double")
    assert [r["cik"] for r in P.filter_profiles(p, {"m": (1, None)}).collect()] == ["g"]
    with pytest.raises(ValueError):
        P.filter_profiles(p, {}, "unknown")


def test_constant_column_has_zero_scores(spark):
    df = spark.createDataFrame([("a", 5.0, 1.0), ("b", None, 2.0), ("c", float("inf"), 3.0)], "k string, x double, y double")
    got = {r["k"]: (r["x"], r["y"]) for r in G.zscores(df, ["x", "y"]).collect()}
    assert got == {"a": (0.0, -1.0), "b": (0.0, 0.0), "c": (0.0, 1.0)}


def test_trailing_sum_needs_all_rows(spark):
    df = spark.createDataFrame([("a", p, float(p)) for p in range(1, 6)], "k string, p int, v double")
    assert {r["p"]: r["v_ttm"] for r in N.trailing_sum(df, "k", "p", ["v"]).collect()} == {1: None, 2: None, 3: None, 4: 10.0, 5: 14.0}


def test_asof_and_window_edges(spark):
    d = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    pts = spark.createDataFrame([("a", d(400)), ("a", d(-1)), ("b", d(0))], "k string, t date")
    s = spark.createDataFrame([("a", d(35), 1.0), ("a", d(36), 2.0), ("a", d(400), 4.0)], "k string, d date, v double")
    assert {(r["k"], r["t"]): r["v"] for r in N.asof_last(pts, s, "k", "t", "d", "v").collect()} == {("a", d(400)): 4.0, ("a", d(-1)): None, ("b", d(0)): None}
    assert {(r["k"], r["t"]): r["v_365d"] for r in N.sum_in_window(pts, s, "k", "t", "d", "v").collect()} == {("a", d(400)): 6.0, ("a", d(-1)): 0.0, ("b", d(0)): 0.0}


def test_oldest_only_judges_both_keys_on_the_original(spark):
    df = spark.createDataFrame([("c1", "T", 2012), ("c2", "T", 2013), ("c2", "U", 2015), ("", "", 2016)], "cusip string, ticker string, year int")
    got = U.oldest_only(df, ["cusip", "ticker"], "year", ["cusip", "ticker"])
    assert sorted(r["year"] for r in got.collect()) == [2012, 2016]


def test_auc_ties_and_curve(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, label int")
    assert M.auc(df).first()["auc"] == 0.5
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "score double, label int")
    assert M.auc(df).first()["auc"] == 0.75
    assert M.average_precision(df).first()["ap"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    b = M.best_f1(df).first()
    assert (b["f1"], b["threshold"]) == (pytest.approx(0.8), 0.7)


def test_hit_and_ndcg(spark):
    df = spark.createDataFrame([("f", f"s{i:02d}", 1.0 - i / 100, int(i in (1, 4, 9))) for i in range(1, 11)] + [("g", "s01", 1.0, 0)], "g string, i string, score double, label int")
    r = M.hit_ndcg(df, "g", "i", [10]).first()
    want = (1 + 1 / math.log2(5) + 1 / math.log2(10)) / (1 + 1 / math.log2(3) + 0.5)
    assert (r["hit_10"], r["groups"]) == (1.0, 1) and r["ndcg_10"] == pytest.approx(want)


def test_kendall_equals_pairs(spark):
    import random

    rng = random.Random(6)
    xs = [(rng.randrange(6), rng.randrange(9)) for _ in range(80)]
    s = tx = ty = 0
    for i in range(80):
        for j in range(i):
            a, b = xs[i][0] - xs[j][0], xs[i][1] - xs[j][1]
            s += (a > 0) - (a < 0) if b > 0 else (a < 0) - (a > 0) if b < 0 else 0
            tx, ty = tx + (a == 0), ty + (b == 0)
    n0 = 80 * 79 / 2
    df = spark.createDataFrame([("g", *x) for x in xs], "g string, a int, b int")
    assert M.kendall(df, "a", "b", "g").first()["tau"] == pytest.approx(s / math.sqrt((n0 - tx) * (n0 - ty)))


def test_flat_quarter(spark):
    picks = spark.createDataFrame([("a", 1), ("a", 2)], "cusip string, p int")
    ret = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 0.0)], "cusip string, p int, ret double")
    assert {r["p"]: r["r"] for r in B.portfolio_returns(picks, ret).collect()} == {1: 2.0, 2: 1.0}


def test_one_round_of_goodness(spark):
    e = spark.createDataFrame([("f", "s", 1.0)], "cik string, cusip string, w double")
    fair, good = G.rev2(e, rounds=1, tolerance=0)
    assert (fair.first()["f"], good.first()["g"]) == (0.5, 0.5)


def test_link_scores(spark):
    e = spark.createDataFrame([("f", "a"), ("f", "s"), ("g", "a"), ("g", "s"), ("h", "s")], "cik string, cusip string")
    pairs = spark.createDataFrame([("f", "s"), ("h", "a"), ("h", "z")], "cik string, cusip string")
    aa = {(r["cik"], r["cusip"]): r["raw"] for r in L.adamic_adar(pairs, e).collect()}
    assert aa[("f", "s")] == pytest.approx(2 / math.log(2)) and aa[("h", "a")] == pytest.approx(2 / math.log(2)) and aa[("h", "z")] == 0
    jc = {(r["cik"], r["cusip"]): r["raw"] for r in L.jaccard(pairs, e).collect()}
    assert jc[("f", "s")] == pytest.approx((1.0 + 0.5) / 2) and jc[("h", "z")] == 0


def test_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.31,), (1.0,)], "s double")
    assert [r[0] for r in df.select(R.buckets(F.col("s"), [0, 0.3, 1])).collect()] == [None, "(0, 0.3]", "(0.3, 1]", "(0.3, 1]"]


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(f"{i:03d}", f"{i:03d}") for i in range(40)] + [(f"{i + 1:03d}", f"{i:03d}") for i in range(39)] + [("900", "900")], "cik string, cusip string")
    got = {r["node"]: r["component"] for r in G.components(e).collect()}
    assert len(got) == 82 and set(got.values()) == {"f:000", "f:900"}


def test_sources_and_sinks(spark, tmp_path):
    from quarterloom.sinks import writers as K
    from quarterloom.sources import readers as S

    (tmp_path / "a.csv").write_text("x,y\n1,2.5\nz,3\n")
    S.csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "a.parquet"), {"x": "int", "y": "double"}, "zstd")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "a.parquet")).collect()), key=repr) == [(1, 2.5), (None, 3.0)]
    (tmp_path / "b.csv").write_text("x,y\n")
    with pytest.raises(ValueError):
        S.csv_to_parquet(spark, str(tmp_path / "b.csv"), str(tmp_path / "b.parquet"))
    assert S.parquet_or_empty(spark, str(tmp_path / "none"), "x int").count() == 0
    (tmp_path / "c.json").write_text('{"db": {"host": "h", "port": "1"}, "x": {"y": "z"}}')
    assert {tuple(r) for r in S.flatten_config(spark, str(tmp_path / "c.json")).collect()} == {("db_host", "h"), ("db_port", "1"), ("x_y", "z")}
    (tmp_path / "russell2014.txt").write_text("Company\nAcme Corp (a,b)\nBeta Inc .... 12\n3M\nacme corp\n")
    assert sorted(r["name"] for r in S.read_index_file(spark, str(tmp_path / "russell2014.txt")).collect()) == ["Acme Corp", "Beta Inc"]
    df = spark.createDataFrame([(1, 2020, 1.0), (2, 2021, 2.0)], "k int, year int, m double")
    path = str(tmp_path / "t")
    K.replace_table(df, path)
    K.replace_table(df.filter("k = 1"), path)
    assert spark.read.parquet(path).count() == 1
    assert K.save_best(df.filter("k = 1"), df, str(tmp_path / "best"), "m") and not K.save_best(df.filter("k = 1"), df, str(tmp_path / "best"), "m")
    assert [r["k"] for r in K.remaining(df, path, ["k"], ["m"]).collect()] == [2]


def test_listing_lines_and_versions(spark, tmp_path):
    from quarterloom.sinks import writers as K
    from quarterloom.sources import readers as S

    text = "SCHEDULE\nCommon Stocks  1,000  $ 2,000\nAcme & Co. (a)  12,345  $ 678,901\n3M Group 1 2\nBeta Inc 5  7 ACME & CO. 9 10\nno shares here"
    got = S.names_from_text(spark.createDataFrame([(text,), (None,), ("",)], "t string"), "t")
    assert sorted(r["name"] for r in got.collect()) == ["ACME & CO", "Beta Inc", "M Group"]
    path = str(tmp_path / "v")
    assert K.read_version(spark, path) is None
    for n in (3, 5):
        K.write_version(spark.range(n).toDF("k"), path)
        assert K.read_version(spark, path).count() == n


def test_a_failed_exchange_puts_the_old_table_back(spark, tmp_path, monkeypatch):
    from quarterloom.sinks import writers as K

    path = str(tmp_path / "t")
    K.replace_table(spark.range(3).toDF("k"), path)
    real = K._fs

    class Failing:
        """A file system on which the new table cannot be moved."""

        def __init__(self, fs):
            self.fs = fs

        def rename(self, a, b):
            return False if ".tmp-" in a.toString() else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(K, "_fs", lambda s, p: (Failing(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(OSError):
        K.replace_table(spark.range(9).toDF("k"), path)
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 3


def test_formats_and_softmax(spark):
    from quarterloom.functions import text as X

    df = spark.createDataFrame([(5.25,), (125.0,), (7300.0,)], "s double")
    assert [r[0] for r in df.select(X.duration(F.col("s"))).collect()] == ["5.2s", "2m 5s", "2h 1m"]
    got = M.softmax(spark.createDataFrame([("a", 1000.0), ("a", 1000.0), ("b", -5.0)], "g string, x double"), "x", "g").collect()
    assert sorted((r["g"], r["probability"]) for r in got) == [("a", 0.5), ("a", 0.5), ("b", 1.0)]
