"""Behavioural profiles of filers from weights and assets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ARCHETYPES = ("buy_and_hold", "high_churn", "concentrated", "diversified")


def concentration(w: DataFrame, top: int = 5) -> DataFrame:
    """Per portfolio: number of rows, sum of squared weights, weight of the ``top`` largest rows.

    The top is taken from per-weight counts, so equal weights need no tie rule and the window sees
    distinct weights only.
    """
    per = w.groupBy("cik", "p", "weight").agg(F.count(F.lit(1)).alias("c"))
    down = W.partitionBy("cik", "p").orderBy(F.desc("weight")).rowsBetween(W.unboundedPreceding, 0)
    per = per.withColumn("upto", F.sum("c").over(down))
    taken = F.greatest(F.least(F.col("c"), F.lit(top) - (F.col("upto") - F.col("c"))), F.lit(0))
    return per.groupBy("cik", "p").agg(F.sum("c").alias("n_holdings"), F.sum(F.col("c") * F.col("weight") * F.col("weight")).alias("hhi"), F.sum(taken * F.col("weight")).alias("top5"))


def churn(w: DataFrame, last: int | None = None) -> DataFrame:
    """Per portfolio with a predecessor: turnover, share of positions opened and closed.

    Union with the shadow of every row in the next quarter, so one shuffle instead of an outer join;
    the close-out quarter after the last one counts.
    """
    one = w.select("cik", "cusip", "p", F.col("weight").alias("w1"), F.lit(0.0).alias("w0"))
    old = w.select("cik", "cusip", (F.col("p") + 1).alias("p"), F.lit(0.0).alias("w1"), F.col("weight").alias("w0"))
    both = one.unionByName(old)
    if last is not None:
        both = both.filter(F.col("p") <= last + 1)
    s = both.groupBy("cik", "cusip", "p").agg(F.sum("w1").alias("w1"), F.sum("w0").alias("w0"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    cur, prev = F.col("w1") > 0, F.col("w0") > 0
    got = s.groupBy("cik", "p").agg(
        (F.sum(F.abs(F.col("w1") - F.col("w0"))) * 0.5).alias("turnover"), F.try_divide(n(cur & ~prev), n(cur)).alias("open_rate"), F.try_divide(n(~cur & prev), n(prev)).alias("close_rate"), n(prev).alias("prev_n")
    )
    return got.filter("prev_n > 0").drop("prev_n")


def holding_duration(w: DataFrame) -> DataFrame:
    """Mean length of runs of consecutive quarters in which a filer holds a security."""
    held = w.select("cik", "cusip", "p").distinct()
    r = held.withColumn("g", F.col("p") - F.row_number().over(W.partitionBy("cik", "cusip").orderBy("p")))
    runs = r.groupBy("cik", "cusip", "g").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("cik").agg(F.avg("n").alias("avg_holding_duration"))


def growth(aum: DataFrame) -> DataFrame:
    """Spread of log assets and annual growth between the first and the last quarter."""
    a = aum.filter("total > 0").groupBy("cik").agg(
        F.stddev_samp(F.ln("total")).alias("aum_log_std"), F.min_by("total", "p").alias("a0"), F.max_by("total", "p").alias("a1"), F.min("p").alias("p0"), F.max("p").alias("p1")
    )
    years = F.greatest((F.col("p1") - F.col("p0")) / 4, F.lit(0.25))
    return a.select("cik", "aum_log_std", (F.pow(F.col("a1") / F.col("a0"), 1 / years) - 1).alias("aum_cagr"))


def profile(w: DataFrame, aum: DataFrame, last: int | None = None) -> DataFrame:
    """The expanding profile of every filer, up to a quarter if one is given."""
    upto = F.lit(True) if last is None else F.col("p") <= last
    h, a = w.filter((F.col("weight") > 0) & upto), aum.filter((F.col("total") > 0) & upto)
    per = concentration(h).join(a, ["cik", "p"], "left")
    base = per.groupBy("cik").agg(
        F.count_distinct("p").alias("n_quarters"), F.min("p").alias("first_p"), F.max("p").alias("last_p"), F.avg("total").alias("mean_aum"), F.median("total").alias("median_aum"),
        F.avg("n_holdings").alias("mean_holdings"), F.stddev_samp("n_holdings").alias("std_holdings"), F.avg("hhi").alias("mean_hhi"), F.avg("top5").alias("mean_top5"),
    )
    c = churn(h, last).groupBy("cik").agg(*[f(x).alias(f"{n}_{x}") for x in ("turnover", "open_rate", "close_rate") for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    return base.join(growth(a), "cik", "left").join(c, "cik", "left").join(holding_duration(h), "cik", "left")


def archetypes(prof: DataFrame) -> DataFrame:
    """Flags by the quartiles over the whole profile, which is one row joined to all."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    cuts = prof.agg(q("mean_turnover").alias("t"), q("avg_holding_duration").alias("d"), q("mean_open_rate").alias("o"), q("mean_hhi").alias("h")).select(F.struct("*").alias("c"))
    row = cuts.scalar()
    p = prof.withColumn("__c", row)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return p.withColumns({
        "buy_and_hold": yes((F.col("mean_turnover") <= F.col("__c.t")[0]) & (F.col("avg_holding_duration") >= F.col("__c.d")[1])),
        "high_churn": yes((F.col("mean_turnover") >= F.col("__c.t")[1]) | (F.col("mean_open_rate") >= F.col("__c.o")[1])),
        "concentrated": yes(F.col("mean_hhi") >= F.col("__c.h")[1]),
        "diversified": yes(F.col("mean_hhi") <= F.col("__c.h")[0]),
    }).drop("__c")


def bounds(limits: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """All bounds hold; a missing metric fails each of its bounds."""
    ok = F.lit(True)
    for c, (lo, hi) in limits.items():
        if lo is not None:
            ok = ok & F.coalesce(F.col(c) >= lo, F.lit(False))
        if hi is not None:
            ok = ok & F.coalesce(F.col(c) <= hi, F.lit(False))
    return ok


def filter_profiles(prof: DataFrame, limits: Mapping[str, tuple[float | None, float | None]], archetype: str | None = None) -> DataFrame:
    if archetype is not None and archetype not in ARCHETYPES:
        raise ValueError(f"unknown archetype {archetype}")
    got = prof.filter(bounds(limits))
    return got.filter(F.col(archetype)) if archetype else got


def survival(prof: DataFrame, column: str, thresholds: Sequence[float], at_least: bool = True) -> DataFrame:
    """(threshold, n): how many rows stay; the thresholds are counted side by side in one pass."""
    c = F.col(column)
    counts = prof.agg(*[F.sum(F.when((c >= t) if at_least else (c <= t), 1).otherwise(0)).alias(f"n{i}") for i, t in enumerate(thresholds)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("n")) for i, t in enumerate(thresholds)])).alias("s")).select("s.*")


def curvature(curve: DataFrame) -> DataFrame:
    """Second derivative of log n by log threshold with central differences (one row per threshold)."""
    w = W.orderBy("threshold")
    def gradient(y: str, x: str) -> Column:
        h0, h1 = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
        inner = (h0 * h0 * F.lead(y).over(w) + (h1 * h1 - h0 * h0) * F.col(y) - h1 * h1 * F.lag(y).over(w)) / (h0 * h1 * (h0 + h1))
        left, right = (F.lead(y).over(w) - F.col(y)) / h1, (F.col(y) - F.lag(y).over(w)) / h0
        return F.when(h0.isNull(), left).when(h1.isNull(), right).otherwise(inner)
    c = curve.filter("n > 0").select("threshold", "n", F.ln("threshold").alias("x"), F.ln("n").alias("y"))
    return c.withColumn("d1", gradient("y", "x")).withColumn("d2", gradient("d1", "x")).select("threshold", "n", "d1", "d2")
