"""Queries on filers' behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.operators import profile as P
from quarterloom.plans.base import Base, big, rnd
from quarterloom.plans.registry import query

PER = "per AS (SELECT cik, p, count(*) AS n, sum(weight * weight) AS hhi, sum(CASE WHEN rn <= 5 THEN weight ELSE 0 END) AS top5 FROM (SELECT *, row_number() OVER (PARTITION BY cik, p ORDER BY weight DESC) AS rn FROM nh WHERE weight > 0) GROUP BY 1, 2)"
CHURN = """s AS (SELECT cik, cusip, p, sum(w1) AS w1, sum(w0) AS w0 FROM (SELECT cik, cusip, p, weight AS w1, 0 AS w0 FROM nh UNION ALL SELECT cik, cusip, p + 1, 0, weight FROM nh) GROUP BY 1, 2, 3),
tv AS (SELECT cik, p, 0.5 * sum(abs(w1 - w0)) AS turnover, count(*) FILTER (WHERE w1 > 0 AND w0 = 0) / nullif(count(*) FILTER (WHERE w1 > 0), 0) AS open_rate, count(*) FILTER (WHERE w1 = 0 AND w0 > 0) / nullif(count(*) FILTER (WHERE w0 > 0), 0) AS close_rate
  FROM s GROUP BY 1, 2 HAVING count(*) FILTER (WHERE w0 > 0) > 0)"""
DUR = "dur AS (SELECT cik, avg(n) AS avg_holding_duration FROM (SELECT cik, cusip, g, count(*) AS n FROM (SELECT cik, cusip, p - row_number() OVER (PARTITION BY cik, cusip ORDER BY p) AS g FROM nh) GROUP BY 1, 2, 3) GROUP BY 1)"
GROW = "gr AS (SELECT cik, stddev_samp(ln(total)) AS aum_log_std, pow(arg_max(total, p) / arg_min(total, p), 1 / greatest(0.25, (max(p) - min(p)) / 4)) - 1 AS aum_cagr FROM aum WHERE total > 0 GROUP BY 1)"
PROFILE = f""", {PER}, {CHURN}, {DUR}, {GROW},
b AS (SELECT per.cik, count(DISTINCT per.p) AS n_quarters, min(per.p) AS first_p, max(per.p) AS last_p, avg(a.total) AS mean_aum, quantile_cont(a.total, 0.5) AS median_aum, avg(n) AS mean_holdings, stddev_samp(n) AS std_holdings, avg(hhi) AS mean_hhi, avg(top5) AS mean_top5
  FROM per LEFT JOIN (SELECT * FROM aum WHERE total > 0) a ON a.cik = per.cik AND a.p = per.p GROUP BY 1),
c AS (SELECT cik, avg(turnover) AS mean_turnover, stddev_samp(turnover) AS std_turnover, avg(open_rate) AS mean_open_rate, stddev_samp(open_rate) AS std_open_rate, avg(close_rate) AS mean_close_rate, stddev_samp(close_rate) AS std_close_rate FROM tv GROUP BY 1),
prof AS (SELECT b.*, gr.aum_log_std, gr.aum_cagr, c.* EXCLUDE (cik), dur.avg_holding_duration FROM b LEFT JOIN gr USING (cik) LEFT JOIN c USING (cik) LEFT JOIN dur USING (cik))"""
METRICS = ["mean_holdings", "std_holdings", "mean_hhi", "mean_top5", "aum_log_std", "aum_cagr", "mean_turnover", "std_turnover", "mean_open_rate", "std_open_rate", "mean_close_rate", "std_close_rate", "avg_holding_duration"]


def _profile(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d).kept()
    return P.profile(b.nh(), b.aum())


@query("concentration", f", {PER} SELECT cik, CAST(p AS BIGINT) AS p, n AS n_holdings, round(hhi, 6) AS hhi, round(top5, 6) AS top5 FROM per JOIN (SELECT DISTINCT cik, p FROM nh) USING (cik, p)")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    return P.concentration(Base(spark, d).nh()).select("cik", *big("p"), "n_holdings", *rnd("hhi", "top5"))


@query("turnover", f", {CHURN}, q AS (SELECT 1 FROM nh LIMIT 1) SELECT cik, CAST(p AS BIGINT) AS p, round(turnover, 6) AS turnover, round(open_rate, 6) AS open_rate, round(close_rate, 6) AS close_rate FROM tv")
def turnover(spark: SparkSession, d: str) -> DataFrame:
    return P.churn(Base(spark, d).nh()).select("cik", *big("p"), *rnd("turnover", "open_rate", "close_rate"))


@query("holding_duration", f", {DUR}, q AS (SELECT 1 FROM nh LIMIT 1) SELECT cik, round(avg_holding_duration, 6) AS avg_holding_duration FROM dur")
def holding_duration(spark: SparkSession, d: str) -> DataFrame:
    return P.holding_duration(Base(spark, d).nh()).select("cik", *rnd("avg_holding_duration"))


@query("aum_growth", f", {GROW}, q AS (SELECT 1 FROM aum LIMIT 1) SELECT cik, round(aum_log_std, 6) AS aum_log_std, round(aum_cagr, 6) + 0.0 AS aum_cagr FROM gr")
def aum_growth(spark: SparkSession, d: str) -> DataFrame:
    return P.growth(Base(spark, d).aum()).select("cik", *rnd("aum_log_std", "aum_cagr"))


@query("cik_profile", PROFILE + ", q AS (SELECT 1 FROM aum, nh LIMIT 1) SELECT cik, n_quarters, CAST(first_p AS BIGINT) AS first_p, CAST(last_p AS BIGINT) AS last_p, round(round(mean_aum, 4)) AS mean_aum, round(round(median_aum, 4)) AS median_aum, " + ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in METRICS) + " FROM prof")
def cik_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d).select("cik", "n_quarters", *big("first_p", "last_p"), *[F.round(F.round(c, 4), 0).alias(c) for c in ("mean_aum", "median_aum")], *rnd(*METRICS))


ARCH = """, cut AS (SELECT quantile_cont(mean_turnover, 0.25) AS t0, quantile_cont(mean_turnover, 0.75) AS t1, quantile_cont(avg_holding_duration, 0.75) AS d1, quantile_cont(mean_open_rate, 0.75) AS o1, quantile_cont(mean_hhi, 0.25) AS h0, quantile_cont(mean_hhi, 0.75) AS h1 FROM prof),
arch AS (SELECT prof.*, coalesce(mean_turnover <= t0 AND avg_holding_duration >= d1, false) AS buy_and_hold, coalesce(mean_turnover >= t1 OR mean_open_rate >= o1, false) AS high_churn, coalesce(mean_hhi >= h1, false) AS concentrated, coalesce(mean_hhi <= h0, false) AS diversified FROM prof, cut), q AS (SELECT 1 FROM aum, nh LIMIT 1)"""


@query("archetypes", PROFILE + ARCH + " SELECT CAST(sum(buy_and_hold::INT) AS BIGINT) AS buy_and_hold, CAST(sum(high_churn::INT) AS BIGINT) AS high_churn, CAST(sum(concentrated::INT) AS BIGINT) AS concentrated, CAST(sum(diversified::INT) AS BIGINT) AS diversified, count(*) AS n FROM arch")
def archetypes(spark: SparkSession, d: str) -> DataFrame:
    a = P.archetypes(_profile(spark, d))
    return a.agg(*[F.sum(F.col(c).cast("bigint")).alias(c) for c in P.ARCHETYPES], F.count(F.lit(1)).alias("n"))


@query("filter_ciks", PROFILE + ARCH + " SELECT cik, round(mean_holdings, 6) AS mean_holdings FROM arch WHERE n_quarters >= 4 AND coalesce(mean_holdings >= 5, false) AND coalesce(mean_turnover <= 0.6, false) AND diversified")
def filter_ciks(spark: SparkSession, d: str) -> DataFrame:
    a = P.archetypes(_profile(spark, d))
    got = P.filter_profiles(a, {"n_quarters": (4, None), "mean_holdings": (5, None), "mean_turnover": (None, 0.6)}, "diversified")
    return got.select("cik", *rnd("mean_holdings"))


@query("threshold_p20_p80", PROFILE + ", q AS (SELECT 1 FROM aum, nh LIMIT 1) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(quantile_cont({m}, 0.2), 6) + 0.0 AS p20, round(quantile_cont({m}, 0.5), 6) + 0.0 AS p50, round(quantile_cont({m}, 0.8), 6) + 0.0 AS p80 FROM prof" for m in METRICS))
def threshold_p20_p80(spark: SparkSession, d: str) -> DataFrame:
    at = F.array(*[F.lit(x) for x in (0.2, 0.5, 0.8)])
    one = _profile(spark, d).agg(*[F.percentile(m, at).alias(m) for m in METRICS])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("s"))
    return rows.select("s.metric", *[(F.round(F.col("s.v")[i], 6) + 0.0).alias(n) for i, n in enumerate(("p20", "p50", "p80"))])


STEPS = [1, 2, 4, 8, 16, 32, 64]


@query("survival_curve", PROFILE + ", q AS (SELECT 1 FROM aum, nh LIMIT 1), t AS (SELECT unnest(" + str(STEPS) + ")::DOUBLE AS threshold) SELECT threshold, (SELECT count(*) FROM prof WHERE mean_holdings >= threshold) AS n_min, (SELECT count(*) FROM prof WHERE mean_holdings <= threshold) AS n_max FROM t")
def survival_curve(spark: SparkSession, d: str) -> DataFrame:
    p = _profile(spark, d)
    a = P.survival(p, "mean_holdings", STEPS).withColumnRenamed("n", "n_min")
    return a.join(P.survival(p, "mean_holdings", STEPS, at_least=False).withColumnRenamed("n", "n_max"), "threshold")


@query(
    "survival_elbow",
    PROFILE + f""", q AS (SELECT 1 FROM aum, nh LIMIT 1), t AS (SELECT unnest({STEPS})::DOUBLE AS threshold), k AS (SELECT threshold, (SELECT count(*) FROM prof WHERE mean_holdings >= threshold) AS n FROM t),
cc AS (SELECT threshold, n, ln(threshold) AS x, ln(n) AS y FROM k WHERE n > 0),
g1 AS (SELECT *, CASE WHEN lag(x) OVER w IS NULL THEN (lead(y) OVER w - y) / (lead(x) OVER w - x) WHEN lead(x) OVER w IS NULL THEN (y - lag(y) OVER w) / (x - lag(x) OVER w)
  ELSE (pow(x - lag(x) OVER w, 2) * lead(y) OVER w + (pow(lead(x) OVER w - x, 2) - pow(x - lag(x) OVER w, 2)) * y - pow(lead(x) OVER w - x, 2) * lag(y) OVER w) / ((x - lag(x) OVER w) * (lead(x) OVER w - x) * (lead(x) OVER w - lag(x) OVER w)) END AS d1 FROM cc WINDOW w AS (ORDER BY threshold)),
g2 AS (SELECT *, CASE WHEN lag(x) OVER w IS NULL THEN (lead(d1) OVER w - d1) / (lead(x) OVER w - x) WHEN lead(x) OVER w IS NULL THEN (d1 - lag(d1) OVER w) / (x - lag(x) OVER w)
  ELSE (pow(x - lag(x) OVER w, 2) * lead(d1) OVER w + (pow(lead(x) OVER w - x, 2) - pow(x - lag(x) OVER w, 2)) * d1 - pow(lead(x) OVER w - x, 2) * lag(d1) OVER w) / ((x - lag(x) OVER w) * (lead(x) OVER w - x) * (lead(x) OVER w - lag(x) OVER w)) END AS d2 FROM g1 WINDOW w AS (ORDER BY threshold))
SELECT threshold, n, round(d1, 6) + 0.0 AS d1, round(d2, 6) + 0.0 AS d2 FROM g2""",
)
def survival_elbow(spark: SparkSession, d: str) -> DataFrame:
    return P.curvature(P.survival(_profile(spark, d), "mean_holdings", STEPS)).select("threshold", "n", *rnd("d1", "d2"))
