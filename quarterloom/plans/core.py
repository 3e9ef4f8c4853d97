"""Cleaning, weights, assets, returns, deltas and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.functions.keys import cusip_key, period
from quarterloom.operators import holdings as H
from quarterloom.plans import oracle as o
from quarterloom.plans.base import Base, big, rnd
from quarterloom.plans.registry import query


@query(
    "clean_holdings",
    f"""SELECT sk, cik, cusip, CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter, CAST(value AS DOUBLE) AS value,
  round(CAST(value AS DOUBLE) / nullif(sshprnamt, 0), 6) AS value_per_share, complete
FROM (SELECT DISTINCT trim(infotablesk) AS sk, {o.cik()} AS cik, {o.cusip()} AS cusip, year, quarter, value, sshprnamt, accessionnumber, nameofissuer, filingdate, value_per_share, period_start,
  (CAST(accessionnumber IS NOT NULL AS INT) + CAST(infotablesk IS NOT NULL AS INT) + CAST(nameofissuer IS NOT NULL AS INT) + CAST({o.cusip()} IS NOT NULL AS INT) + CAST(value IS NOT NULL AS INT) + CAST(sshprnamt IS NOT NULL AS INT)
   + CAST(filingdate IS NOT NULL AS INT) + CAST({o.cik()} IS NOT NULL AS INT) + CAST(value_per_share IS NOT NULL AS INT) + CAST(year IS NOT NULL AS INT) + CAST(quarter IS NOT NULL AS INT) + CAST(period_start IS NOT NULL AS INT)) >= 9.6 AS complete
  FROM holdings) WHERE cusip IS NOT NULL AND value IS NOT NULL""",
)
def clean_holdings(spark: SparkSession, d: str) -> DataFrame:
    got = H.clean_records(Base(spark, d).raw("holdings"))
    return got.select(F.col("infotablesk").alias("sk"), "cik", "cusip", *big("year", "quarter"), F.col("value").cast("double").alias("value"), *rnd("value_per_share"), "complete")


@query(
    "option_filter",
    "SELECT event_id, CAST(user_id AS BIGINT) AS user_id FROM events WHERE nullif(trim(CASE WHEN event_type = 'click' THEN '' WHEN event_id % 3 = 0 THEN event_type END), '') IS NULL",
)
def option_filter(spark: SparkSession, d: str) -> DataFrame:
    e = Base(spark, d).raw("events").withColumn("putcall", F.when(F.col("event_type") == "click", "").when(F.col("event_id") % 3 == 0, F.col("event_type")))
    return H.option_free(e).select("event_id", *big("user_id"))


@query(
    "period_normalisation",
    "SELECT o_orderkey, period, CAST(period[1:4] AS BIGINT) AS year, CAST(period[7:7] AS BIGINT) AS quarter FROM (SELECT o_orderkey, year(o_orderdate) || '_Q' || quarter(o_orderdate) AS period FROM orders) WHERE period >= '1996_Q2'",
)
def period_normalisation(spark: SparkSession, d: str) -> DataFrame:
    text = F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy"))
    r = Base(spark, d).raw("orders").select("o_orderkey", H.report_period(text).alias("period")).filter(F.col("period") >= "1996_Q2")
    y, q = H.split_period(F.col("period"))
    return r.select("o_orderkey", "period", y.cast("bigint").alias("year"), q.cast("bigint").alias("quarter"))


@query("submission_join", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, o_custkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def submission_join(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    return b.raw("lineitem").join(b.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", *big("l_linenumber"), "o_custkey", "o_orderpriority")


@query(
    "median_value_per_share",
    """SELECT cik, cusip, CAST(p AS BIGINT) AS p, shares, round(shares * m, 4) AS value FROM (
  SELECT pos.*, m FROM pos JOIN (SELECT p, quantile_cont(price, 0.5) AS m FROM px GROUP BY 1) USING (p))""",
)
def median_value_per_share(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    med = b.px().groupBy("p").agg(F.percentile("price", F.lit(0.5)).alias("m"))
    return b.pos().join(med, "p").select("cik", "cusip", *big("p"), "shares", F.round(F.col("shares") * F.col("m"), 4).alias("value"))


@query("filtered_holdings", "SELECT cik, cusip, CAST(p AS BIGINT) AS p, shares, CAST(year AS BIGINT) AS year, ticker FROM pos JOIN ru USING (cusip) WHERE p // 4 >= year AND ticker IS NOT NULL AND (e IS NULL OR year(e) * 4 + quarter(e) - 1 >= p)")
def filtered_holdings(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    ru = b.ru().filter("ticker IS NOT NULL").select("cusip", "year", "ticker", (F.col("year") * 4).alias("start_p"), period(F.year("e"), F.quarter("e")).alias("end_p"))
    return H.interval_join(b.pos(), ru, "cusip", "p", "start_p", "end_p").select("cik", "cusip", *big("p"), "shares", *big("year"), "ticker")


@query("universe_semi_filter", "SELECT cik, cusip, CAST(p AS BIGINT) AS p, shares FROM pos WHERE EXISTS (SELECT 1 FROM ru WHERE ru.cusip = pos.cusip AND ru.year = pos.p // 4)")
def universe_semi_filter(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    pos = b.pos().withColumn("year", F.floor(F.col("p") / 4).cast("int"))
    return pos.join(b.ru().select("cusip", "year"), ["cusip", "year"], "left_semi").select("cik", "cusip", *big("p"), "shares")


@query("partition_pruned_range", f"SELECT {o.cusip()} AS cusip, count(*) AS n FROM holdings WHERE period_start >= DATE '2020-04-01' AND period_start < DATE '2021-01-01' GROUP BY 1")
def partition_pruned_range(spark: SparkSession, d: str) -> DataFrame:
    h = Base(spark, d).raw("holdings").filter("period_start >= DATE '2020-04-01' AND period_start < DATE '2021-01-01'")
    return h.groupBy(cusip_key("cusip").alias("cusip")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_statistics", "SELECT count(*) AS n_all, CAST(sum(CASE WHEN u.cusip IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_kept, round(100.0 * sum(CASE WHEN u.cusip IS NOT NULL THEN 1 ELSE 0 END) / count(*), 4) AS pct_kept FROM pos LEFT JOIN (SELECT DISTINCT cusip FROM ru) u ON u.cusip = pos.cusip")
def filter_statistics(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    u = b.ru().select("cusip").distinct().withColumn("listed", F.lit(1))
    kept = F.sum(F.coalesce("listed", F.lit(0)))
    return b.pos().join(u, "cusip", "left").agg(F.count(F.lit(1)).alias("n_all"), kept.alias("n_kept"), F.round(100.0 * kept / F.count(F.lit(1)), 4).alias("pct_kept"))


@query("price_per_quarter", "SELECT t.ticker, CAST(p AS BIGINT) AS p, round(avg(price), 6) AS price FROM px JOIN tm t USING (cusip) WHERE t.s IS NULL OR p >= year(t.s) * 4 + quarter(t.s) - 1 GROUP BY 1, 2")
def price_per_quarter(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    tm = b.tm().select("cusip", "ticker", F.coalesce(period(F.year("s"), F.quarter("s")), F.lit(0)).alias("sp"), F.lit(None).cast("int").alias("ep"))
    return H.interval_join(b.px(), tm, "cusip", "p", "sp", "ep").groupBy("ticker", *big("p")).agg(F.round(F.avg("price"), 6).alias("price"))


@query("stocks_return", "SELECT cusip, CAST(p AS BIGINT) AS p, round(ret, 6) AS ret, round(log_return, 6) + 0.0 AS log_return FROM ret")
def stocks_return(spark: SparkSession, d: str) -> DataFrame:
    return Base(spark, d).ret().select("cusip", *big("p"), *rnd("ret", "log_return"))


@query("normalized_holdings", "SELECT cik, cusip, CAST(p AS BIGINT) AS p, shares, round(price, 6) AS price, round(weight, 9) AS weight FROM nh")
def normalized_holdings(spark: SparkSession, d: str) -> DataFrame:
    return Base(spark, d).nh().select("cik", "cusip", *big("p"), "shares", *rnd("price"), *rnd("weight", digits=9))


@query("weight_sum_audit", "SELECT count(*) AS portfolios, CAST(sum(CASE WHEN abs(t - 1) > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS off FROM (SELECT sum(weight) AS t FROM nh GROUP BY cik, p)")
def weight_sum_audit(spark: SparkSession, d: str) -> DataFrame:
    nh = Base(spark, d).kept().nh()
    off = H.weight_audit(nh).agg(F.count(F.lit(1)).alias("off"))
    return nh.select("cik", "p").distinct().agg(F.count(F.lit(1)).alias("portfolios")).select("portfolios", off.scalar().alias("off"))


@query("cik_aum", "SELECT cik, CAST(p AS BIGINT) AS p, round(total, 5) AS total FROM aum")
def cik_aum(spark: SparkSession, d: str) -> DataFrame:
    return Base(spark, d).aum().select("cik", *big("p"), *rnd("total", digits=5))


@query("computed_deltas", "SELECT cik, cusip, CAST(p AS BIGINT) AS p, CAST(change_in_shares AS BIGINT) AS change_in_shares, round(change_in_weight, 9) + 0.0 AS change_in_weight, round(change_in_adjusted_weight, 7) + 0.0 AS change_in_adjusted_weight FROM dl")
def computed_deltas(spark: SparkSession, d: str) -> DataFrame:
    return Base(spark, d).dl().select("cik", "cusip", *big("p", "change_in_shares"), *rnd("change_in_weight", digits=9), *rnd("change_in_adjusted_weight", digits=7))


@query(
    "changed_stats",
    """, e AS (SELECT DISTINCT p, cik, cusip FROM dl),
i AS (SELECT p, avg(n) AS avg_degree_in_cusip, count(*) AS num_cusip FROM (SELECT p, cusip, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT p, avg(n) AS avg_degree_out_cik, count(*) AS num_cik FROM (SELECT p, cik, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT p, avg(change_in_shares) AS a, avg(change_in_weight) AS b, avg(change_in_adjusted_weight) AS c FROM dl GROUP BY 1),
t AS (SELECT p, quantile_cont(log_return, 1.0::DOUBLE / 3) AS t1, quantile_cont(log_return, 2.0::DOUBLE / 3) AS t2 FROM ret WHERE log_return IS NOT NULL GROUP BY 1)
SELECT CAST(i.p AS BIGINT) AS p, round(avg_degree_in_cusip, 6) AS avg_degree_in_cusip, num_cusip, round(avg_degree_out_cik, 6) AS avg_degree_out_cik, num_cik, round(a, 4) + 0.0 AS avg_change_in_shares,
  round(b, 8) + 0.0 AS avg_change_in_weight, round(c, 6) + 0.0 AS avg_change_in_adjusted_weight, round(t1, 6) + 0.0 AS log_return_tertile_1, round(t2, 6) + 0.0 AS log_return_tertile_2
FROM i JOIN u USING (p) JOIN m USING (p) LEFT JOIN t USING (p)""",
)
def changed_stats(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    s = H.delta_stats(b.dl(), b.ret())
    return s.select(*big("p"), *rnd("avg_degree_in_cusip"), "num_cusip", *rnd("avg_degree_out_cik"), "num_cik", *rnd("avg_change_in_shares", digits=4), *rnd("avg_change_in_weight", digits=8), *rnd("avg_change_in_adjusted_weight", "log_return_tertile_1", "log_return_tertile_2"))


@query("distinct_quarters", "SELECT DISTINCT CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter FROM holdings")
def distinct_quarters(spark: SparkSession, d: str) -> DataFrame:
    return Base(spark, d).raw("holdings").select(*big("year", "quarter")).distinct()
