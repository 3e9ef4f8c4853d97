"""Queries on the bipartite graph of all quarters; those of windows and of single quarters are in ``windows``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.operators import graph as G
from quarterloom.operators import holdings as H
from quarterloom.operators import linkpred as L
from quarterloom.plans.base import Base, big, rnd
from quarterloom.plans.registry import query


@query("graph_build", "SELECT CAST(p AS BIGINT) AS p, count(DISTINCT cik) AS n_funds, count(DISTINCT cusip) AS n_stocks, count(DISTINCT cik || cusip) AS n_edges FROM buys GROUP BY 1")
def graph_build(spark: SparkSession, d: str) -> DataFrame:
    e = Base(spark, d).buys().select("p", "cik", "cusip").distinct()
    side = lambda k, n: e.groupBy("p", k).count().groupBy("p").agg(F.count(F.lit(1)).alias(n))
    return side("cik", "n_funds").join(side("cusip", "n_stocks"), "p").join(e.groupBy("p").agg(F.count(F.lit(1)).alias("n_edges")), "p").withColumn("p", F.col("p").cast("bigint"))


@query("degree_series", "SELECT CAST(p AS BIGINT) AS p, cusip, count(DISTINCT cik) AS degree FROM ch GROUP BY 1, 2")
def degree_series(spark: SparkSession, d: str) -> DataFrame:
    e = Base(spark, d).ch().select("p", "cik", "cusip").distinct()
    return G.degrees(e, "cusip", "p").withColumn("p", F.col("p").cast("bigint"))


@query("weight_histogram", """, x AS (SELECT log10(abs(dw)) AS x FROM ch WHERE dw <> 0), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
SELECT CAST(least(floor((x - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS bin, count(*) AS n FROM x, e GROUP BY 1""")
def weight_histogram(spark: SparkSession, d: str) -> DataFrame:
    return G.log_histogram(Base(spark, d).ch(), "dw")


@query("tertile_labels", ", c AS (SELECT p, quantile_cont(log_return, 1.0::DOUBLE / 3) AS t1, quantile_cont(log_return, 2.0::DOUBLE / 3) AS t2 FROM ret WHERE log_return IS NOT NULL GROUP BY 1) SELECT cusip, CAST(ret.p AS BIGINT) AS p, CASE WHEN log_return <= t1 THEN 0 WHEN log_return <= t2 THEN 1 ELSE 2 END AS label FROM ret JOIN c ON c.p = ret.p WHERE log_return IS NOT NULL")
def tertile_labels(spark: SparkSession, d: str) -> DataFrame:
    r = Base(spark, d).ret().filter("log_return IS NOT NULL")
    c = r.groupBy("p").agg(F.percentile("log_return", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("t"))
    return r.join(c, "p").select("cusip", *big("p"), H.tertile_class(F.col("log_return"), F.col("t")[0], F.col("t")[1]).alias("label"))


@query("median_labels", ", c AS (SELECT p, quantile_cont(log_return, 0.5) AS m FROM ret WHERE log_return IS NOT NULL GROUP BY 1) SELECT cusip, CAST(ret.p AS BIGINT) AS p, CAST(log_return > m AS INT) AS label FROM ret JOIN c ON c.p = ret.p WHERE log_return IS NOT NULL")
def median_labels(spark: SparkSession, d: str) -> DataFrame:
    r = Base(spark, d).ret().filter("log_return IS NOT NULL")
    c = r.groupBy("p").agg(F.median("log_return").alias("m"))
    return r.join(c, "p").select("cusip", *big("p"), (F.col("log_return") > F.col("m")).cast("int").alias("label"))


@query("profitability", "SELECT nh.cik, CAST(nh.p AS BIGINT) AS p, round(sum(weight * log_return), 6) + 0.0 AS profit FROM nh JOIN ret ON ret.cusip = nh.cusip AND ret.p = nh.p + 1 GROUP BY 1, 2")
def profitability(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    return G.profitability(b.nh(), b.ret()).select("cik", *big("p"), *rnd("profit"))


@query("available_pairs", "SELECT CAST(p AS BIGINT) AS p, CAST(p + 1 AS BIGINT) AS next_p FROM (SELECT DISTINCT p FROM buys) WHERE p + 1 IN (SELECT p FROM buys) AND p - 1 IN (SELECT p FROM buys)")
def available_pairs(spark: SparkSession, d: str) -> DataFrame:
    q = Base(spark, d).buys().select("p").distinct()
    nxt, prev = q.select((F.col("p") - 1).alias("p")), q.select((F.col("p") + 1).alias("p"))
    return q.join(nxt, "p", "left_semi").join(prev, "p", "left_semi").select(*big("p"), (F.col("p") + 1).cast("bigint").alias("next_p"))


# ---------------------------------------------------------------- link prediction


@query("window_splits", ", q AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i FROM (SELECT DISTINCT p FROM buys)), w AS (SELECT unnest(range((SELECT count(*) FROM q) - 8)) AS win) SELECT CAST(win AS BIGINT) AS win, CAST(p AS BIGINT) AS p, CASE WHEN i = win + 8 THEN 'test' ELSE 'train' END AS role FROM w JOIN q ON i BETWEEN win AND win + 8")
def window_splits(spark: SparkSession, d: str) -> DataFrame:
    w = L.windows(Base(spark, d).buys().select("p"), 8)
    return w.select(F.col("window").cast("bigint").alias("win"), *big("p"), "role")


@query("min_max_weights", "SELECT cik, cusip, CAST(p AS BIGINT) AS p, round(CASE WHEN hi = lo THEN 1 ELSE (dw - lo) / (hi - lo) END, 6) AS scaled FROM buys JOIN (SELECT p, min(dw) AS lo, max(dw) AS hi FROM buys GROUP BY 1) USING (p)")
def min_max_weights(spark: SparkSession, d: str) -> DataFrame:
    """Per quarter; a quarter without variation gives 1."""
    x = Base(spark, d).buys()
    ends = x.groupBy("p").agg(F.min("dw").alias("lo"), F.max("dw").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("dw") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return x.join(ends, "p").select("cik", "cusip", *big("p"), F.round(scaled, 6).alias("scaled"))


@query("hard_negatives", "WITH s AS (SELECT a.vec_id AS query, b.vec_id AS item, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS c FROM embeddings a JOIN embeddings b ON b.vec_id % 2 = 1 WHERE a.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, item) AS rn FROM s) SELECT query, item FROM k WHERE rn <= 20 AND item % 7 <> query % 7")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Of the 20 most similar securities of each query (every fiftieth vector) those it is not linked to;
    links stand between ids that are equal modulo 7."""
    from quarterloom.operators import vectors as V

    e = Base(spark, d).raw("embeddings")
    top = V.nearest(e.filter("vec_id % 2 = 1"), e.filter("vec_id % 50 = 0"), 20)
    linked = e.select(F.col("vec_id").alias("item"), (F.col("vec_id") % 7).alias("m"))
    near = top.withColumn("m", F.col("query") % 7)
    return near.join(linked, ["item", "m"], "left_anti").select("query", "item")
