"""Queries on ranks: agreement, stability, portfolios, reports and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarterloom.functions import text as X
from quarterloom.operators import backtest as B
from quarterloom.operators import holdings as H
from quarterloom.operators import metrics as M
from quarterloom.operators import reports as R
from quarterloom.operators import vectors as V
from quarterloom.plans.base import Base, big, rnd
from quarterloom.plans.registry import query

RR = "rr AS MATERIALIZED (SELECT rk.cusip, rk.pp AS p, rk.rank, rk.net, ret.ret, ret.log_return FROM rk JOIN ret ON ret.cusip = rk.cusip AND ret.p = rk.pp)"


def _rr(b: Base) -> DataFrame:
    return b.rk().select("cusip", F.col("pp").alias("p"), "rank", "net").join(b.ret(), ["cusip", "p"])


def _corr_sql(x: str, y: str) -> str:
    return f"(sum({x} * {y}) - sum({x}) * sum({y}) / count(*)) / nullif(sqrt((sum({x} * {x}) - sum({x}) * sum({x}) / count(*)) * (sum({y} * {y}) - sum({y}) * sum({y}) / count(*))), 0)"


@query("spearman", f", {RR}, k AS (SELECT p, rank() OVER (PARTITION BY p ORDER BY net) + (count(*) OVER (PARTITION BY p, net) - 1) / 2 AS x, rank() OVER (PARTITION BY p ORDER BY log_return) + (count(*) OVER (PARTITION BY p, log_return) - 1) / 2 AS y FROM rr WHERE log_return IS NOT NULL) SELECT CAST(p AS BIGINT) AS p, count(*) AS n, CASE WHEN count(*) >= 5 THEN round({_corr_sql('x', 'y')}, 6) + 0.0 END AS spearman FROM k, (SELECT 1 FROM rk, ret LIMIT 1) GROUP BY 1")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return M.spearman(_rr(Base(spark, d)), "net", "log_return", "p").select(*big("p"), "n", *rnd("spearman"))


CLS = """c AS (SELECT p, quantile_cont(log_return, 1.0::DOUBLE / 3) AS t1, quantile_cont(log_return, 2.0::DOUBLE / 3) AS t2, quantile_cont(CAST(net AS DOUBLE), 1.0::DOUBLE / 3) AS n1, quantile_cont(CAST(net AS DOUBLE), 2.0::DOUBLE / 3) AS n2 FROM rr WHERE log_return IS NOT NULL GROUP BY 1),
cl AS MATERIALIZED (SELECT rr.p, CASE WHEN log_return <= t1 THEN 0 WHEN log_return <= t2 THEN 1 ELSE 2 END AS truth, CASE WHEN net <= n1 THEN 0 WHEN net <= n2 THEN 1 ELSE 2 END AS guess FROM rr JOIN c ON c.p = rr.p WHERE log_return IS NOT NULL)"""


def _classes(b: Base) -> DataFrame:
    r = _rr(b).filter("log_return IS NOT NULL")
    at = F.array(F.lit(1 / 3), F.lit(2 / 3))
    c = r.groupBy("p").agg(F.percentile("log_return", at).alias("t"), F.percentile(F.col("net").cast("double"), at).alias("m"))
    r = r.join(c, "p")
    return r.select("p", H.tertile_class(F.col("log_return"), F.col("t")[0], F.col("t")[1]).alias("truth"), H.tertile_class(F.col("net"), F.col("m")[0], F.col("m")[1]).alias("guess"))


@query("confusion", f", {RR}, {CLS} SELECT truth, guess, count(*) AS n FROM cl, (SELECT 1 FROM rk, ret LIMIT 1) GROUP BY 1, 2")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(_classes(Base(spark, d)), "truth", "guess")


@query("macro_f1", f", {RR}, {CLS}, f AS (SELECT " + ", ".join(f"2.0 * sum((truth = {k} AND guess = {k})::INT) / (sum((truth = {k})::INT) + sum((guess = {k})::INT)) AS f{k}" for k in range(3)) + ", avg((truth = guess)::INT) AS a FROM cl) SELECT round(a, 6) AS accuracy, round((f0 + f1 + f2) / 3, 6) AS macro_f1 FROM f, (SELECT 1 FROM rk, ret LIMIT 1)")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return M.macro_f1(_classes(Base(spark, d)), "truth", "guess", [0, 1, 2]).select(*rnd("accuracy", "macro_f1"))


@query("kendall_tau", f""", {RR}, x AS (SELECT p, net, log_return AS y, row_number() OVER () AS i FROM rr WHERE log_return IS NOT NULL),
s AS (SELECT a.p, sum(sign(a.net - b.net) * sign(a.y - b.y)) AS s, sum((a.net = b.net)::INT) AS tx, sum((a.y = b.y)::INT) AS ty, count(*) AS m FROM x a JOIN x b ON a.p = b.p AND a.i < b.i GROUP BY 1)
SELECT CAST(x.p AS BIGINT) AS p, count(*) AS n, round(max(s / sqrt(CAST(m - tx AS DOUBLE) * (m - ty))), 6) + 0.0 AS tau FROM x JOIN s ON s.p = x.p, (SELECT 1 FROM rk, ret LIMIT 1) GROUP BY 1""")
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    return M.kendall(_rr(Base(spark, d)), "net", "log_return", "p").select(*big("p"), "n", *rnd("tau"))


@query("topk_overlap", "SELECT CAST(a.p AS BIGINT) AS p, round(count(b.cusip) / 10.0, 6) AS overlap FROM (SELECT * FROM rk WHERE rank <= 10) a LEFT JOIN (SELECT * FROM rk WHERE rank <= 10) b ON b.p = a.p + 1 AND b.cusip = a.cusip GROUP BY 1")
def topk_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = Base(spark, d).rk().filter("rank <= 10").groupBy("p").agg(F.collect_set("cusip").alias("s"))  # ten names a quarter
    nxt = s.select((F.col("p") - 1).alias("p"), F.col("s").alias("t"))
    j = s.join(nxt, "p", "left")
    return j.select(*big("p"), F.round(F.coalesce(F.size(F.array_intersect("s", "t")), F.lit(0)) / 10.0, 6).alias("overlap"))


@query("rank_stability", "SELECT cusip, count(*) AS n, round(avg(rank), 6) AS mean_rank, round(stddev_samp(rank), 6) AS std_rank, CAST(min(rank) AS BIGINT) AS best, round(avg((rank <= 10)::INT), 6) AS top_10, round(avg((rank <= 25)::INT), 6) AS top_25, round(avg((rank <= 50)::INT), 6) AS top_50 FROM rk GROUP BY 1 HAVING count(*) >= greatest(2, floor((SELECT count(DISTINCT p) FROM rk) * 0.5))")
def rank_stability(spark: SparkSession, d: str) -> DataFrame:
    rk = Base(spark, d).rk()
    least = rk.agg(F.greatest(F.lit(2), F.floor(F.count_distinct("p") * 0.5))).scalar()
    share = lambda k: F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"top_{k}")
    g = rk.groupBy("cusip").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.stddev_samp("rank"), 6).alias("std_rank"), F.min("rank").cast("bigint").alias("best"), share(10), share(25), share(50))
    return g.filter(F.col("n") >= least)


@query("topn_return", f", {RR}, q AS (SELECT p, avg(ret) AS m, stddev_samp(ret) AS s FROM rr WHERE rank <= 10 GROUP BY 1) SELECT count(*) AS n, round(avg(m), 6) AS mean_return, round(stddev_samp(m), 6) AS std_return, round((avg(m) - 1) / stddev_samp(m), 6) + 0.0 AS sharpe_like FROM q, (SELECT 1 FROM rk, ret LIMIT 1)")
def topn_return(spark: SparkSession, d: str) -> DataFrame:
    q = _rr(Base(spark, d)).filter("rank <= 10").groupBy("p").agg(F.avg("ret").alias("m"))
    return q.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 6).alias("mean_return"), F.round(F.stddev_samp("m"), 6).alias("std_return"), (F.round((F.avg("m") - 1) / F.stddev_samp("m"), 6) + 0.0).alias("sharpe_like"))


@query("paired_t", f", {RR}, q AS (SELECT p, avg(CASE WHEN rank <= 10 THEN ret END) AS a, avg(ret) AS b FROM rr GROUP BY 1) SELECT count(b - a) AS n, round(avg(b - a), 6) + 0.0 AS mean_diff, round(avg(b - a) / (stddev_samp(b - a) / sqrt(count(b - a))), 6) + 0.0 AS t FROM q, (SELECT 1 FROM rk, ret LIMIT 1)")
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    q = _rr(Base(spark, d)).groupBy("p").agg(F.avg(F.when(F.col("rank") <= 10, F.col("ret"))).alias("a"), F.avg("ret").alias("b"))
    return M.paired_t(q, "a", "b").select("n", *rnd("mean_diff", "t"))


@query("rank_pivot", "SELECT cusip, CAST(min(CASE WHEN p = 8088 THEN rank END) AS BIGINT) AS q8088, CAST(min(CASE WHEN p = 8089 THEN rank END) AS BIGINT) AS q8089, CAST(min(CASE WHEN p = 8090 THEN rank END) AS BIGINT) AS q8090 FROM rk WHERE p BETWEEN 8088 AND 8090 GROUP BY 1")
def rank_pivot(spark: SparkSession, d: str) -> DataFrame:
    r = Base(spark, d).rk().filter(F.col("p").between(8088, 8090)).withColumn("q", F.concat(F.lit("q"), "p"))
    return r.groupBy("cusip").pivot("q", ["q8088", "q8089", "q8090"]).agg(F.min(F.col("rank").cast("bigint")))


# ---------------------------------------------------------------- backtest

PF = "pf AS MATERIALIZED (SELECT k.p, coalesce(avg(r.ret), 1.0) AS r, count(r.ret) AS n FROM (SELECT cusip, pp AS p FROM rk WHERE rank <= 10) k LEFT JOIN (SELECT * FROM ret WHERE ret > 0) r ON r.cusip = k.cusip AND r.p = k.p GROUP BY 1)"
CV = "v AS (SELECT p, r, 1000000.0 * exp(sum(ln(r)) OVER (ORDER BY p)) AS value FROM pf), cv AS MATERIALIZED (SELECT *, greatest(max(value) OVER (ORDER BY p), 1000000.0) AS peak FROM v)"
ONE = "(SELECT 1 FROM rk, ret LIMIT 1)"


def _per(b: Base) -> DataFrame:
    return B.portfolio_returns(B.top_n(b.rk(), 10), b.ret())


@query("top_n_portfolio", f", {PF} SELECT CAST(p AS BIGINT) AS p, round(r, 6) AS r, n AS n_available FROM pf, {ONE}")
def top_n_portfolio(spark: SparkSession, d: str) -> DataFrame:
    return _per(Base(spark, d)).select(*big("p"), *rnd("r"), "n_available")


@query("portfolio_curve", f", {PF}, {CV} SELECT CAST(p AS BIGINT) AS p, round(value, 2) AS value, round(peak, 2) AS peak, round((value - peak) / peak, 6) + 0.0 AS drawdown FROM cv, {ONE}")
def portfolio_curve(spark: SparkSession, d: str) -> DataFrame:
    return B.curve(_per(Base(spark, d))).select(*big("p"), *rnd("value", "peak", digits=2), *rnd("drawdown"))


@query("turnover_sets", """, k AS (SELECT cusip, pp AS p FROM rk WHERE rank <= 10), q AS (SELECT p, lag(p) OVER (ORDER BY p) AS pp FROM (SELECT DISTINCT p FROM k))
SELECT CAST(q.p AS BIGINT) AS p, coalesce((SELECT string_agg(cusip, ',' ORDER BY cusip) FROM k WHERE k.p = q.p AND cusip NOT IN (SELECT cusip FROM k z WHERE z.p = q.pp)), '') AS entered,
  coalesce((SELECT string_agg(cusip, ',' ORDER BY cusip) FROM k WHERE k.p = q.pp AND cusip NOT IN (SELECT cusip FROM k z WHERE z.p = q.p)), '') AS exited FROM q""")
def turnover_sets(spark: SparkSession, d: str) -> DataFrame:
    return B.membership_changes(B.top_n(Base(spark, d).rk(), 10)).select(*big("p"), "entered", "exited")


@query("backtest_summary", f", {PF}, {CV}, z AS (SELECT p, round((r - 1) * 100, 4) / 100 AS r, (value - peak) / peak AS dd FROM cv), a AS (SELECT exp(sum(ln(1 + r))) AS t, count(*) AS n, avg(r) AS m, stddev_pop(r) AS s, min(dd) AS dd FROM z) SELECT round(t - 1, 6) AS total_return, round(pow(t, 4.0 / n) - 1, 6) AS annualised, round(m / s * 2, 6) AS sharpe, round(dd, 6) AS max_drawdown, n AS n_quarters FROM a, {ONE}")
def backtest_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.summary(B.curve(_per(Base(spark, d)))).select(*rnd("total_return", "annualised", "sharpe", "max_drawdown"), "n_quarters")


@query("frequent_holdings", "SELECT cusip, count(*) AS n FROM rk WHERE rank <= 10 GROUP BY 1 ORDER BY n DESC, cusip LIMIT 15")
def frequent_holdings(spark: SparkSession, d: str) -> DataFrame:
    """A top-fifteen report."""
    return B.top_n(Base(spark, d).rk(), 10).groupBy("cusip").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cusip").limit(15)


@query("benchmark_return", "WITH q AS (SELECT year(ts) AS y, quarter(ts) AS q, month(ts) AS m, day(ts) AS d, max(value) AS v FROM events GROUP BY 1, 2, 3, 4), l AS (SELECT y, q, m, arg_max(v, d) AS close FROM q GROUP BY 1, 2, 3) SELECT CAST(y AS BIGINT) AS year, CAST(m AS BIGINT) AS month, round(close, 6) AS close, round(close / lag(close) OVER (ORDER BY y, m), 6) AS ret FROM l")
def benchmark_return(spark: SparkSession, d: str) -> DataFrame:
    e = Base(spark, d).raw("events").groupBy(F.year("ts").alias("year"), F.month("ts").alias("month"), F.to_date("ts").alias("day")).agg(F.max("value").alias("v"))
    close = e.groupBy("year", "month").agg(F.max_by("v", "day").alias("close"))
    w = W.orderBy("year", "month")  # one row per month
    return close.select(*big("year", "month"), F.round("close", 6).alias("close"), F.round(F.col("close") / F.lag("close").over(w), 6).alias("ret"))


@query("benchmark_quarters", """WITH v AS (SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS v FROM orders GROUP BY 1), l AS (SELECT year(day) * 4 + quarter(day) - 1 AS p, arg_max(v, day) AS close FROM v GROUP BY 1)
SELECT CAST(a.p AS BIGINT) AS p, round(a.close, 6) AS close, round(a.close / b.close, 6) AS ret FROM l a LEFT JOIN l b ON b.p = a.p - 1 AND b.close > 0""")
def benchmark_quarters(spark: SparkSession, d: str) -> DataFrame:
    """Last close of each quarter and its ratio to the quarter before, NULL if that has none."""
    o = Base(spark, d).raw("orders")
    return B.quarterly_ratio(o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("v")), "day", "v").select(*big("p"), *rnd("close", "ret"))


@query("softmax_of_net", "SELECT cusip, CAST(p AS BIGINT) AS p, round(exp(net - max(net) OVER w) / (sum(exp(net - t)) OVER w), 9) AS probability FROM (SELECT *, max(net) OVER (PARTITION BY p) AS t FROM rk) WINDOW w AS (PARTITION BY p)")
def softmax_of_net(spark: SparkSession, d: str) -> DataFrame:
    return M.softmax(Base(spark, d).rk().select("cusip", "p", "net"), "net", "p").select("cusip", *big("p"), *rnd("probability", digits=9))


@query("formatted_report", """WITH n AS (SELECT year, quarter, count(*) AS n FROM changed_holdings GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM n)
SELECT year || ' Q' || quarter AS label, format('{:,}', n) AS rows, printf('%.1f', 100.0 * n / t) || '%' AS share,
  CASE WHEN n < 60 THEN printf('%.1f', n * 1.0) || 's' WHEN n < 3600 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE (n // 3600) || 'h ' || ((n % 3600) // 60) || 'm' END AS took FROM n, t""")
def formatted_report(spark: SparkSession, d: str) -> DataFrame:
    n = Base(spark, d).raw("changed_holdings").groupBy("year", "quarter").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("t", n.agg(F.sum("n")).scalar())
    return n.select(X.quarter_label(F.col("year"), F.col("quarter")).alias("label"), X.grouped(F.col("n")).alias("rows"), X.percent(F.col("n") / F.col("t"), 1).alias("share"), X.duration(F.col("n").cast("double")).alias("took"))


@query("rank_fundamentals", ", k AS (SELECT cusip, pp, rank FROM rk WHERE rank <= 10) SELECT k.cusip, CAST(k.pp AS BIGINT) AS p, CAST(k.rank AS BIGINT) AS rank, round(fd.pe_ratio, 6) AS pe_ratio, tm.ticker FROM k LEFT JOIN fd ON fd.cusip = k.cusip AND fd.p = k.pp - 1 LEFT JOIN tm ON tm.cusip = k.cusip")
def rank_fundamentals(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    f = b.fd().select("cusip", (F.col("p") + 1).alias("p"), "pe_ratio")
    return B.top_n(b.rk(), 10).join(f, ["cusip", "p"], "left").join(b.tm().select("cusip", "ticker"), "cusip", "left").select("cusip", *big("p", "rank"), *rnd("pe_ratio"), "ticker")


# ---------------------------------------------------------------- reports

PROB = "pb AS MATERIALIZED (SELECT cik, cusip, p, dw / (SELECT max(dw) FROM buys) AS s FROM buys)"


def _prob(b: Base) -> DataFrame:
    x = b.buys()
    top = x.agg(F.max("dw")).scalar()
    return x.select("cik", "cusip", "p", (F.col("dw") / top).alias("s"))


@query("prediction_stats", f", {PROB}, m AS (SELECT avg(s) AS mu FROM pb) SELECT count(*) AS n, round(min(s), 9) AS min, round(max(s), 6) AS max, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(stddev_samp(s), 6) AS std, round(avg(pow(s - mu, 3)) / pow(avg(pow(s - mu, 2)), 1.5), 4) AS skew, round(avg(pow(s - mu, 4)) / pow(avg(pow(s - mu, 2)), 2) - 3, 4) AS kurtosis, round(avg((s >= 0.1)::INT), 6) AS share_0_1, round(avg((s >= 0.5)::INT), 6) AS share_0_5 FROM pb, m")
def prediction_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.describe(_prob(Base(spark, d)), "s", [0.1, 0.5]).select("n", *rnd("min", digits=9), *rnd("max", "mean", "median", "std"), *rnd("skew", "kurtosis", digits=4), *rnd("share_0_1", "share_0_5"))


@query("confidence_buckets", f", {PROB} SELECT CASE WHEN s > 0 AND s <= 0.01 THEN '(0, 0.01]' WHEN s > 0.01 AND s <= 0.1 THEN '(0.01, 0.1]' WHEN s > 0.1 AND s <= 1 THEN '(0.1, 1]' END AS bucket, count(*) AS n FROM pb GROUP BY 1")
def confidence_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _prob(Base(spark, d)).groupBy(R.buckets(F.col("s"), [0, 0.01, 0.1, 1]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("quarter_summary", f", {PROB} SELECT CAST(p AS BIGINT) AS p, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM pb), 6) AS pct, round(avg(s), 6) AS avg_score, round(min(s), 9) AS min_score, round(max(s), 6) AS max_score FROM pb GROUP BY 1")
def quarter_summary(spark: SparkSession, d: str) -> DataFrame:
    x = _prob(Base(spark, d))
    n = x.agg(F.count(F.lit(1))).scalar()
    return x.groupBy(*big("p")).agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count(F.lit(1)) / n, 6).alias("pct"), F.round(F.avg("s"), 6).alias("avg_score"), F.round(F.min("s"), 9).alias("min_score"), F.round(F.max("s"), 6).alias("max_score"))


@query("top_entities", f", {PROB} SELECT cik, count(*) AS n, round(avg(s), 6) AS avg_score, round(avg((s >= 0.9)::INT), 6) AS share_high FROM pb GROUP BY 1 ORDER BY n DESC, cik LIMIT 15")
def top_entities(spark: SparkSession, d: str) -> DataFrame:
    return R.top_entities(_prob(Base(spark, d)), "cik", "s").select("cik", "n", *rnd("avg_score", "share_high"))


CORR = ["pe_ratio", "price_to_sales", "price_to_book", "debt_to_equity"]


@query("corr_matrix", ", f AS (SELECT * FROM fd WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in CORR) + ") " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_corr_sql(a, b)}, 6) + 0.0 AS corr FROM f, (SELECT 1 FROM fd LIMIT 1)" for i, a in enumerate(CORR) for b in CORR[i + 1 :]))
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return R.correlations(Base(spark, d).fd(), CORR).select("a", "b", *rnd("corr"))


@query("dashboard_kpis", f", {PROB} SELECT count(*) AS total, CAST(sum((s >= 0.5)::INT) AS BIGINT) AS high, count(DISTINCT cik) AS funds, count(DISTINCT cusip) AS stocks, round(avg(s), 6) AS avg_score FROM pb")
def dashboard_kpis(spark: SparkSession, d: str) -> DataFrame:
    x = _prob(Base(spark, d))
    return x.agg(F.count(F.lit(1)).alias("total"), F.sum((F.col("s") >= 0.5).cast("bigint")).alias("high"), F.count_distinct("cik").alias("funds"), F.count_distinct("cusip").alias("stocks"), F.round(F.avg("s"), 6).alias("avg_score"))


@query("predictions_with_ticker", f", {PROB} SELECT pb.cik, pb.cusip, CAST(pb.p AS BIGINT) AS p, round(pb.s, 6) AS score, tm.ticker, tm.name FROM pb LEFT JOIN tm ON tm.cusip = pb.cusip WHERE pb.s >= 0.05")
def predictions_with_ticker(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    return _prob(b).filter("s >= 0.05").join(b.tm().select("cusip", "ticker", "name"), "cusip", "left").select("cik", "cusip", *big("p"), F.round("s", 6).alias("score"), "ticker", "name")


@query("buyers_per_stock", "SELECT cusip, CAST(p AS BIGINT) AS p, count(DISTINCT cik) AS buyers, round(sum(dw), 6) AS bought FROM buys GROUP BY 1, 2")
def buyers_per_stock(spark: SparkSession, d: str) -> DataFrame:
    e = Base(spark, d).buys().groupBy("cusip", "p", "cik").agg(F.sum("dw").alias("w"))
    return e.groupBy("cusip", *big("p")).agg(F.count(F.lit(1)).alias("buyers"), F.round(F.sum("w"), 6).alias("bought"))


# ---------------------------------------------------------------- vectors

COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query("cosine_topk", f"WITH s AS (SELECT a.vec_id AS query, b.vec_id AS item, {COS} AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT query, item, round(c, 6) + 0.0 AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, item) AS rn FROM s) WHERE rn <= 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = Base(spark, d).raw("embeddings")
    return V.nearest(e, e.filter("vec_id % 50 = 0"), 10).select("query", "item", *rnd("cosine"))


@query("embedding_rank", "WITH s AS (SELECT b.vec_id AS item, avg(1 / (1 + exp(-list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])))) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY 1) SELECT item, round(s, 6) AS score FROM s")
def embedding_rank(spark: SparkSession, d: str) -> DataFrame:
    """One side of the vectors (even ids) stands for funds, the other for securities."""
    e = Base(spark, d).raw("embeddings")
    return V.mean_score(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1")).select("item", *rnd("score"))


@query("yearly_metrics", f", {RR}, q AS (SELECT p, count(*) AS n, avg(ret) AS m FROM rr WHERE rank <= 10 GROUP BY 1) SELECT CAST(p // 4 AS BIGINT) AS year, count(*) AS quarters, round(avg(m), 6) AS mean_return, round(stddev_samp(m), 6) AS std_return FROM q, (SELECT 1 FROM rk, ret LIMIT 1) GROUP BY 1")
def yearly_metrics(spark: SparkSession, d: str) -> DataFrame:
    q = _rr(Base(spark, d)).filter("rank <= 10").groupBy("p").agg(F.avg("ret").alias("m"))
    return q.groupBy(F.floor(F.col("p") / 4).alias("year")).agg(F.count(F.lit(1)).alias("quarters"), F.round(F.avg("m"), 6).alias("mean_return"), F.round(F.stddev_samp("m"), 6).alias("std_return"))
