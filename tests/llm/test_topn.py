import math
import random

import pytest

from quarterloom.llm.topn import top_n


def brute(rows, n):
    by = {}
    for g, i, s in rows:
        if i is not None and s is not None and not math.isnan(s):
            by.setdefault(g, set()).add((-(s + 0.0), i.encode(), i))
    return sorted(((g, i, -s) for g, xs in by.items() for s, _, i in sorted(xs)[:n]), key=repr)


def run(spark, rows, n):
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "g string, i string, s double, __x double")
    return sorted(((r["g"], r["i"], r["s"] + 0.0) for r in top_n(df, ["g"], "s", "i", n).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    score = lambda: rng.choice([0.5, -0.5, 0.25, 0.0, -0.0, 1e300, -1e-300, float("inf"), float("-inf"), float("nan"), None, rng.uniform(-1, 1)])
    item = lambda: rng.choice([None, "", "a", "ab", "abcdefg", "abcdefgh", "abcdefgh0", "é", "\x00", "a\x00", f"{rng.randrange(300):09d}"])
    rows = [(rng.choice(["x", "x", "x", "y", "z", None]), item(), score()) for _ in range(250)]
    rows += rows[:20]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_all_scores_equal_and_long_items(spark):
    rows = [("g", f"{i:05d}", 1.0) for i in range(400)] + [("h", "p" * 30 + str(i), 2.0) for i in range(9)] + [("h", "q" * 20_000, 2.0)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_small_groups_and_empty(spark):
    assert run(spark, [("g", "a", 1.0)], 3) == [("g", "a", 1.0)]
    df = spark.createDataFrame([], "g string, i string, s double")
    assert top_n(df, ["g"], "s", "i", 3).count() == 0


def test_no_task_reads_a_hot_group_as_a_whole(spark):
    """A million rows of one group, without help of the adaptive planner; the tasks' records are what Spark counted."""
    from pyspark.sql import functions as F

    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(1_000_000).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("s"))
        df = df.unionByName(spark.range(2000).select(F.concat(F.lit("h"), F.col("id") % 500).alias("g"), F.col("id").cast("string").alias("i"), F.lit(1.0).alias("s")))
        first = max([s.stageId() for s in _stages(store)], default=-1)
        got = top_n(df, ["g"], "s", "i", 3, hot_rows=20_000).collect()
        best = df.filter("g = 'g'").orderBy(F.desc("s"), "i").limit(3).collect()
        assert sorted((r["i"], r["s"]) for r in got if r["g"] == "g") == sorted((r["i"], r["s"]) for r in best)
        assert len(got) == 3 + 3 * 500
        read = [t.taskMetrics().get().shuffleReadMetrics().recordsRead() for s in _stages(store) if s.stageId() > first for t in _list(store.taskList(s.stageId(), s.attemptId(), 10_000)) if t.taskMetrics().isDefined()]
        assert 50_000 < max(read) < 200_000  # 50 salts fall into 16 tasks by hash
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _stages(store):
    return _list(store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None))


def _list(seq):
    return [seq.apply(i) for i in range(seq.size())]
