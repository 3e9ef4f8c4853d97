"""Top-N portfolios from ranks, their curve, turnover and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def top_n(ranks: DataFrame, n: int, at: str = "pp") -> DataFrame:
    """Of every quarter the rows with rank up to ``n`` (ranks are dense from 1, so a filter suffices)."""
    return ranks.filter(F.col("rank") <= n).select("cusip", F.col(at).alias("p"), "rank")


def portfolio_returns(picks: DataFrame, ret: DataFrame) -> DataFrame:
    """Equal-weight mean of the picks' positive returns per quarter; 1.0 if there is none."""
    r = picks.join(ret.filter("ret > 0").select("cusip", "p", "ret"), ["cusip", "p"], "left")
    return r.groupBy("p").agg(F.coalesce(F.avg("ret"), F.lit(1.0)).alias("r"), F.count("ret").alias("n_available"))


def curve(per: DataFrame, start: float = 1_000_000.0) -> DataFrame:
    """Value, running peak and drawdown; one row per quarter, so the ordered windows are small."""
    w = W.orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    v = per.withColumn("value", start * F.exp(F.sum(F.ln("r")).over(w)))
    v = v.withColumn("peak", F.greatest(F.max("value").over(w), F.lit(start)))
    return v.withColumn("drawdown", (F.col("value") - F.col("peak")) / F.col("peak"))


def membership_changes(picks: DataFrame) -> DataFrame:
    """Per quarter the names that entered and left against the quarter before, sorted and joined."""
    s = picks.groupBy("p").agg(F.sort_array(F.collect_set("cusip")).alias("s"))  # N names a quarter
    prev = F.coalesce(F.lag("s").over(W.orderBy("p")), F.array().cast("array<string>"))
    return s.select("p", F.array_join(F.array_except("s", prev), ",").alias("entered"), F.array_join(F.array_except(prev, F.col("s")), ",").alias("exited"))


def summary(c: DataFrame, digits: int = 4) -> DataFrame:
    """Total and annualised return, Sharpe ratio and worst drawdown from returns rounded in percent."""
    r = F.round((F.col("r") - 1) * 100, digits) / 100
    a = c.agg(F.exp(F.sum(F.ln(1 + r))).alias("total"), F.count(F.lit(1)).alias("n"), F.avg(r).alias("m"), F.stddev_pop(r).alias("s"), F.min("drawdown").alias("max_drawdown"))
    return a.select((F.col("total") - 1).alias("total_return"), (F.pow("total", 4 / F.col("n")) - 1).alias("annualised"), F.when(F.col("s") > 0, F.col("m") / F.col("s") * 2).alias("sharpe"), "max_drawdown", F.col("n").alias("n_quarters"))


def quarterly_ratio(prices: DataFrame, day: str, value: str) -> DataFrame:
    """(p, close, ret): the last price of each quarter and its ratio to that of the quarter before (NULL if there is none or it is not positive)."""
    p = F.year(day) * 4 + F.quarter(day) - 1
    close = prices.groupBy(p.cast("int").alias("p")).agg(F.max_by(value, day).alias("close"))
    before = close.filter("close > 0").select((F.col("p") + 1).alias("p"), F.col("close").alias("before"))
    return close.join(before, "p", "left").select("p", "close", (F.col("close") / F.col("before")).alias("ret"))
