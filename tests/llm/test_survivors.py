import datetime as dt
import random

from pyspark.sql import functions as F

from quarterloom.llm.survivors import Field, survivors


def test_against_brute_force(spark):
    rng = random.Random(2)
    day = lambda: rng.choice([None, dt.date(2020, 1, rng.randrange(1, 6))])
    rows = [(rng.choice(["a", "a", "b", None]), f"{rng.randrange(12):03d}", day(), rng.choice([None, -1, 0, 5, 9]), rng.choice(["", None, "n" * 50_000, "m"])) for _ in range(60)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += rows[:7]
    df = spark.createDataFrame(rows, "k string, id string, day date, v int, t string").withColumn("first_id", F.lit("clash"))
    got = {r["k"]: r for r in survivors(df, ["k"], "id", "day", [Field("v", F.col("v"), F.col("v") > 0), Field("t", F.col("t"), priority=F.length("t"))]).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    key = lambda r: (r[2] is not None, r[2] or dt.date.min, r[1])
    for k, rs in by.items():
        g = got[k]
        assert (g["first_id"], g["survivor_id"], g["several"]) == (min(r[1] for r in rs), max(rs, key=key)[1], len({r[1] for r in rs}) > 1)
        ok = [r for r in rs if (r[3] or 0) > 0]
        assert (g["v"], g["v_from"]) == ((max(ok, key=key)[3], max(ok, key=key)[1]) if ok else (None, None))
        ok = [r for r in rs if r[4] is not None]
        best = max(ok, key=lambda r: (len(r[4]), *key(r))) if ok else None
        assert (g["t"], g["t_from"]) == ((best[4], best[1]) if best else (None, None))


def test_missing_ids_and_empty(spark):
    df = spark.createDataFrame([("a", None, None, 3), ("a", None, None, 4)], "k string, id string, day date, v int")
    r = survivors(df, ["k"], "id", "day", [Field("v", F.col("v"))]).first()
    assert (r["first_id"], r["survivor_id"], r["several"], r["v"]) == (None, None, False, 4)
    assert survivors(df.limit(0), ["k"], "id", "day", [Field("v", F.col("v"))]).count() == 0
