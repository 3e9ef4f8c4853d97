"""Trailing sums, as-of prices, trailing windows, ratios, upserts and nested JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def trailing_sum(df: DataFrame, key: str, at: str, columns: Sequence[str], rows: int = 4) -> DataFrame:
    """Sums over the last ``rows`` reported rows of a key; NULL while there are fewer values."""
    w = W.partitionBy(key).orderBy(at).rowsBetween(1 - rows, 0)
    return df.select("*", *[F.when(F.count(c).over(w) == rows, F.sum(c).over(w)).alias(f"{c}_ttm") for c in columns])


def asof_last(points: DataFrame, series: DataFrame, key: str, at: str, day: str, value: str) -> DataFrame:
    """The series' last value of the key on or before each point, NULL if there is none.

    Union of both sides, sorted by day with values before points, and a running last value; equal days
    take the greatest value.
    """
    s = series.filter(F.col(value).isNotNull()).groupBy(key, F.col(day).alias("__d")).agg(F.max(value).alias("__v"))
    p = points.select("*", F.col(at).alias("__d"))
    both = p.withColumn("__is", F.lit(1)).unionByName(s.withColumn("__is", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("__d", "__is").rowsBetween(W.unboundedPreceding, 0)
    got = both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).filter("__is = 1")
    return got.select(*points.columns, value)


def sum_in_window(points: DataFrame, series: DataFrame, key: str, at: str, day: str, value: str, days: int = 365) -> DataFrame:
    """Sum of the series within (at - days, at]; 0 if there is nothing.

    Range join bucketed by spans of ``days``: a point looks into its own bucket and the one before.
    """
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / days)
    s = series.groupBy(key, F.col(day).alias("__d")).agg(F.sum(value).alias("__v")).withColumn("__b", bucket(F.col("__d")))
    p = points.select(key, at).distinct().withColumn("__b", F.explode(F.array(bucket(F.col(at)), bucket(F.col(at)) - 1)))
    hit = p.join(s, [key, "__b"]).filter((F.col("__d") <= F.col(at)) & (F.col("__d") > F.date_sub(F.col(at), days)))
    sums = hit.groupBy(key, at).agg(F.sum("__v").alias("__s"))
    return points.join(sums, [key, at], "left").withColumn(f"{value}_{days}d", F.coalesce("__s", F.lit(0).cast("double"))).drop("__s")


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def insert_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows and the incoming ones whose key is new; of equal incoming keys the least row."""
    rest = [c for c in incoming.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__s")).select(*keys, "__s.*")
    return existing.unionByName(one.join(existing.select(*keys), list(keys), "left_anti"))


def upsert_newest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key: the newest by ``version``, incoming before existing when equal."""
    rest = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max(F.struct(F.col(version).alias("__ver"), F.col("__new"), *[F.col(c).alias(f"f_{c}") for c in rest])).alias("__s"))
    return best.select(*keys, *[F.col(f"__s.f_{c}").alias(c) for c in rest])


STATEMENTS = "struct<Financials: map<string, struct<quarterly: map<string, map<string, string>>>>>"


def statements(df: DataFrame, column: str, key: str) -> DataFrame:
    """Quarterly figures from a column of four-level JSON (Financials, statement, quarterly, date): one row per ``key`` and date
    of the income statement: key, date, year, quarter, net_income, revenue, ebitda, equity, shares, debt, cash, fcf and the ratios
    diluted_eps, roe, debt_to_equity, fcf_per_share.

    A figure that is missing, empty or no number counts as 0. Debt is the total or, where that is not given, short-term plus
    long-term debt; cash is cash and short-term investments or their parts; free cash flow is as given or, where 0, the
    operating cash flow less capital expenditures. Ratios on 0 are NULL. Dates that do not parse and documents that are no
    such JSON give no rows.
    """
    f = df.select(F.col(key).alias("__k"), F.from_json(column, STATEMENTS)["Financials"].alias("__f"))
    quarterly = lambda n: F.col("__f")[n]["quarterly"]
    rows = f.select("__k", F.explode(quarterly("Income_Statement")).alias("date", "i"), quarterly("Balance_Sheet").alias("b"), quarterly("Cash_Flow").alias("c"))
    rows = rows.select("__k", "date", F.try_to_date("date", "yyyy-MM-dd").alias("__d"), "i", F.col("b")[F.col("date")].alias("b"), F.col("c")[F.col("date")].alias("c")).filter("__d IS NOT NULL")
    number = lambda m, n: F.coalesce(F.col(m)[n].try_cast("double"), F.lit(0.0))
    given = lambda m, n: F.coalesce(F.col(m)[n] != "", F.lit(False))
    debt = F.when(given("b", "shortLongTermDebtTotal"), number("b", "shortLongTermDebtTotal")).otherwise(number("b", "shortTermDebt") + number("b", "longTermDebt"))
    cash = F.when(given("b", "cashAndShortTermInvestments"), number("b", "cashAndShortTermInvestments")).otherwise(number("b", "cash") + number("b", "shortTermInvestments"))
    flow = number("c", "totalCashFromOperatingActivities")
    fcf = F.when(number("c", "freeCashFlow") != 0, number("c", "freeCashFlow")).when(flow != 0, flow - number("c", "capitalExpenditures")).otherwise(0.0)
    got = rows.select(
        F.col("__k").alias(key), "date", F.year("__d").alias("year"), F.quarter("__d").alias("quarter"), number("i", "netIncome").alias("net_income"), number("i", "totalRevenue").alias("revenue"), number("i", "ebitda").alias("ebitda"),
        number("b", "totalStockholderEquity").alias("equity"), number("b", "commonStockSharesOutstanding").alias("shares"), debt.alias("debt"), cash.alias("cash"), fcf.alias("fcf"),
    )
    x = F.col
    return got.withColumns({
        "diluted_eps": safe_ratio(x("net_income"), x("shares")), "roe": safe_ratio(x("net_income"), x("equity")), "debt_to_equity": safe_ratio(x("debt"), x("equity")), "fcf_per_share": safe_ratio(x("fcf"), x("shares")),
    })


NESTED = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))


def flatten_json(df: DataFrame, column: str, separator: str = "_") -> DataFrame:
    """A column of two-level JSON objects as rows (…, key, value) with joined keys."""
    outer = df.select("*", F.explode(F.from_json(column, NESTED)).alias("__a", "__m"))
    return outer.select(*df.columns, "__a", F.explode("__m").alias("__b", "value")).withColumn("key", F.concat_ws(separator, "__a", "__b")).drop("__a", "__b")
