import random

import pytest

from quarterloom.operators.snapshots import snapshot_diff


def brute(rows, log):
    snaps = {}
    for o, k, p, v in rows:
        if p is not None:
            snaps.setdefault((o, p), {})[k] = v
    rec = {}
    for o, k, p, c in log:
        if p is not None:
            rec.setdefault((o, k, p), set()).add(c)
    out = []
    for (o, p), now in snaps.items():
        old = snaps.get((o, p - 1))
        if old is None:
            continue
        for k in set(now) | set(old):
            if k in now and k in old and now[k] == old[k]:
                continue
            kind = "added" if k not in old else "removed" if k not in now else "changed"
            delta = (now.get(k) or 0) - (old.get(k) or 0)
            r = rec.get((o, k, p))
            out.append((o, k, p, kind, old.get(k), now.get(k), "absent" if r is None else "same" if delta in r else "differs"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_against_brute_force(spark, batch):
    rng = random.Random(5)
    rows = {(rng.choice(["f", "f", "g", None]), rng.choice(["a", "b", "c", "d", None]), rng.choice([1, 2, 3, 5, 6])): rng.choice([1, 2, 3, None]) for _ in range(90)}
    rows = [(*k, v) for k, v in rows.items()]
    log = [(rng.choice(["f", "g", None]), rng.choice(["a", "b", "c", None]), rng.choice([1, 2, 3, 4, 6, None]), rng.choice([-1, 0, 1, None])) for _ in range(60)]
    log = list({(o, k, p): (o, k, p, c) for o, k, p, c in log}.values())
    df = spark.createDataFrame([*rows, *rows[:9]], "o string, k string, p int, v long").withColumn("diff_kind", pytest.importorskip("pyspark.sql.functions").lit("x"))
    rec = spark.createDataFrame(log, "o string, k string, p int, v long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = snapshot_diff(df, ["o", "k"], "p", ["v"], ["o"], recorded=rec, recorded_change="v")
        have = sorted(((r["o"], r["k"], r["p"], r["diff_kind"], r["old_v"], r["new_v"], r["recorded_as"]) for r in got.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert have == brute(rows, log)


def test_several_columns_and_long_texts(spark):
    long = "x" * 200_000
    df = spark.createDataFrame([(1, 1, "", 1.0), (1, 2, long, float("nan")), (1, 3, long, float("nan")), (2, 2, None, None), (2, 3, "", None)], "k int, p int, t string, v double")
    got = snapshot_diff(df, ["k"], "p", ["t", "v"]).collect()
    assert sorted((r["k"], r["p"], r["diff_kind"], tuple(r["changed_columns"])) for r in got) == [(1, 2, "changed", ("t", "v")), (2, 2, "added", ()), (2, 3, "changed", ("t",))]


def test_empty_and_null_period(spark):
    df = spark.createDataFrame([(1, None, 1)], "k int, p int, v int")
    assert snapshot_diff(df, ["k"], "p", ["v"]).count() == 0
    assert snapshot_diff(df.limit(0), ["k"], "p", ["v"]).count() == 0
