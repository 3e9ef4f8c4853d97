"""From holdings records to weights, assets, returns and quarter-over-quarter deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quarterloom.functions.keys import cik_key, cusip_key, period

EPS_VALUE, EPS_WEIGHT = 1e-6, 1e-12


def plain_names(df: DataFrame) -> DataFrame:
    """Lower-case column names without underscores; of names that then clash the first column stays."""
    seen, keep = set(), []
    for c in df.columns:
        n = c.lower().replace("_", "")
        if n not in seen:
            seen.add(n)
            keep.append(F.col(f"`{c}`").alias(n))
    return df.select(*keep)


def option_free(df: DataFrame, column: str = "putcall") -> DataFrame:
    """Rows whose option column is NULL or blank, without the column; all rows if there is none."""
    if column not in df.columns:
        return df
    return df.filter(F.col(column).isNull() | (F.trim(column) == "")).drop(column)


def report_period(c: Column) -> Column:
    """'31-DEC-2013' to '2013_Q4'; NULL if it is no date."""
    d = F.coalesce(F.try_to_date(F.initcap(c), "dd-MMM-yyyy"), F.try_to_date(c, "yyyy-MM-dd"))
    return F.concat(F.year(d), F.lit("_Q"), F.quarter(d))


def split_period(c: Column) -> tuple[Column, Column]:
    """'2013_Q4' to (2013, 4); NULLs if it is written otherwise."""
    return F.regexp_extract(c, r"^(\d{4})_Q[1-4]$", 1).try_cast("int"), F.regexp_extract(c, r"^\d{4}_Q([1-4])$", 1).try_cast("int")


def clean_records(raw: DataFrame) -> DataFrame:
    """Canonical keys, exact copies dropped, rows without cusip or value dropped, value per share
    recomputed, and a flag for rows with at least 80 % of their fields."""
    r = raw.withColumns({"cik": cik_key("cik"), "cusip": cusip_key("cusip"), "infotablesk": F.trim("infotablesk")}).dropDuplicates()
    r = r.filter(F.col("cusip").isNotNull() & F.col("value").isNotNull())
    filled = sum((F.col(c).isNotNull().cast("int") for c in raw.columns), F.lit(0))
    per_share = F.try_divide(F.col("value").cast("double"), F.col("sshprnamt").cast("double"))
    return r.withColumns({"value_per_share": per_share, "complete": filled >= 0.8 * len(raw.columns)})


def positions(holdings: DataFrame) -> DataFrame:
    """(cik, cusip, p, shares): lines with equal share counts are one line delivered again."""
    h = holdings.filter(F.col("sshprnamt").isNotNull())
    lines = h.select(cik_key("cik").alias("cik"), cusip_key("cusip").alias("cusip"), period().alias("p"), "sshprnamt").distinct()
    return lines.groupBy("cik", "cusip", "p").agg(F.sum("sshprnamt").alias("shares"))


def median_per_share(holdings: DataFrame) -> DataFrame:
    """(cusip, p, price): the exact median of the positive values per share of distinct records."""
    h = holdings.filter(F.col("value_per_share") > 0)
    h = h.select(F.trim("infotablesk").alias("sk"), cusip_key("cusip").alias("cusip"), period().alias("p"), F.col("value_per_share").cast("double").alias("v")).distinct()
    return h.groupBy("cusip", "p").agg(F.percentile("v", F.lit(0.5)).alias("price"))


def valid_at(p: Column, start: Column, end: Column) -> Column:
    """Closed validity interval, open at the end if that is NULL."""
    return (p >= start) & (end.isNull() | (p <= end))


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` with ``at`` within [start, end]; several valid rows fan out."""
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in right.columns})
    on = (F.col(key) == F.col(f"__r_{key}")) & valid_at(F.col(at), F.col(f"__r_{start}"), F.col(f"__r_{end}"))
    got = left.join(r, on, how)
    return got if how == "left_semi" else got.drop(f"__r_{key}").withColumnsRenamed({f"__r_{c}": c for c in right.columns if c != key})


def value_positions(pos: DataFrame, price: DataFrame) -> DataFrame:
    """Positions with price and value; positions without a price are dropped."""
    return pos.join(price, ["cusip", "p"]).withColumn("pv", F.col("shares") * F.col("price"))


def weights(valued: DataFrame, by: Sequence[str] = ("cik", "p"), value: str = "pv") -> DataFrame:
    """Share of each position in its portfolio; positions worth nothing are left out before totals.

    One row of totals per portfolio is joined back instead of a window, so that the largest
    portfolio's total is combined on the map side and its rows may be split.
    """
    v = valued.filter(F.col(value) > EPS_VALUE)
    total = v.groupBy(*by).agg(F.sum(value).alias("__total"))
    return v.join(total, list(by)).withColumn("weight", F.col(value) / F.col("__total")).drop("__total")


def weight_audit(w: DataFrame, by: Sequence[str] = ("cik", "p"), tolerance: float = 1e-6) -> DataFrame:
    return w.groupBy(*by).agg(F.sum("weight").alias("total")).filter(F.abs(F.col("total") - 1) > tolerance)


def assets(valued: DataFrame) -> DataFrame:
    """(cik, p, total): assets under management; nothing is left out."""
    return valued.groupBy("cik", "p").agg(F.sum("pv").alias("total"))


def returns(price: DataFrame) -> DataFrame:
    """Price over the security's previous available price, which bridges gaps; the first row is dropped."""
    w = W.partitionBy("cusip").orderBy("p")  # one row per quarter of a security
    r = F.col("price") / F.lag("price").over(w)
    got = price.withColumn("ret", r).filter(F.col("ret").isNotNull())
    return got.select("cusip", "p", "ret", F.when(F.col("ret") > 0, F.ln("ret")).alias("log_return"))


def deltas(w: DataFrame, aum: DataFrame) -> DataFrame:
    """Changes against the previous quarter present in the data, by union with the shifted quarter.

    Only filers with assets in both quarters; absent sides count as 0; all-zero rows are dropped.
    """
    # the list of quarters present: at most a few hundred rows, broadcast by its bound
    q = w.select("p").distinct().withColumn("qi", F.dense_rank().over(W.orderBy("p")))
    nxt = F.broadcast(q.select(F.col("p").alias("p"), F.lead("p").over(W.orderBy("p")).alias("next_p")))
    zero, zl = F.lit(0.0), F.lit(0).cast("bigint")
    one = w.groupBy("cik", "cusip", "p").agg(F.sum("shares").alias("s"), F.sum("weight").alias("w"))
    cur = one.select("cik", "cusip", "p", F.col("s").alias("s1"), F.col("w").alias("w1"), zl.alias("s0"), zero.alias("w0"))
    old = one.join(nxt, "p").filter("next_p IS NOT NULL").select("cik", "cusip", F.col("next_p").alias("p"), zl.alias("s1"), zero.alias("w1"), F.col("s").alias("s0"), F.col("w").alias("w0"))
    both = cur.unionByName(old).groupBy("cik", "cusip", "p").agg(*[F.sum(c).alias(c) for c in ("s1", "w1", "s0", "w0")])
    a = aum.filter(F.col("total") > 0)
    pairs = a.join(a.join(nxt, "p").select("cik", F.col("next_p").alias("p"), F.col("total").alias("total0")), ["cik", "p"])
    got = both.join(pairs, ["cik", "p"]).select(
        "cik", "cusip", "p", (F.col("s1") - F.col("s0")).alias("change_in_shares"), (F.col("w1") - F.col("w0")).alias("change_in_weight"),
        (F.col("w1") * (F.col("total") / F.col("total0")) - F.col("w0")).alias("change_in_adjusted_weight"),
    )
    return got.filter((F.abs("change_in_shares") > 0) | (F.abs("change_in_weight") > EPS_WEIGHT) | (F.abs("change_in_adjusted_weight") > EPS_WEIGHT))


def delta_stats(d: DataFrame, ret: DataFrame) -> DataFrame:
    """Per quarter: average degrees of both sides, distinct counts, means and the tertiles of log returns.

    Degrees come from one aggregation per side over distinct edges, not from a distinct count over all.
    """
    edges = d.select("p", "cik", "cusip").distinct()
    side = lambda k, n: edges.groupBy("p", k).count().groupBy("p").agg(F.avg("count").alias(f"avg_degree_{n}"), F.count(F.lit(1)).alias(f"num_{k}"))
    means = d.groupBy("p").agg(*[F.avg(f"change_in_{c}").alias(f"avg_change_in_{c}") for c in ("shares", "weight", "adjusted_weight")])
    t = ret.filter(F.col("log_return").isNotNull()).groupBy("p").agg(F.percentile("log_return", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("t"))
    got = side("cusip", "in_cusip").join(side("cik", "out_cik"), "p").join(means, "p").join(t, "p", "left")
    return got.withColumns({"log_return_tertile_1": F.col("t")[0], "log_return_tertile_2": F.col("t")[1]}).drop("t")


def tertile_class(value: Column, t1: Column, t2: Column) -> Column:
    return F.when(value.isNotNull(), F.when(value <= t1, 0).when(value <= t2, 1).otherwise(2)).cast(T.IntegerType())
