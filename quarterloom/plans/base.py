"""The derived tables that most queries start from, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarterloom.functions.keys import cik_key, cusip_key, finite, period, ticker_key
from quarterloom.operators import holdings as H
from quarterloom.plans import oracle as o
from quarterloom.session import written
from quarterloom.sources.tables import table

RATIOS = ["diluted_eps", "roe", "ev_ebitda", "pe_ratio", "price_to_sales", "price_to_book", "debt_to_equity", "dividend_yield", "fcf_per_share"]
FINITE = ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in RATIOS)
SQL = {
    "h": f"SELECT DISTINCT {o.cik()} AS cik, {o.cusip()} AS cusip, year * 4 + quarter - 1 AS p, sshprnamt FROM holdings WHERE sshprnamt IS NOT NULL",
    "pos": "SELECT cik, cusip, p, CAST(sum(sshprnamt) AS BIGINT) AS shares FROM h GROUP BY 1, 2, 3",
    "px": f"SELECT cusip, p, quantile_cont(v, 0.5) AS price FROM (SELECT DISTINCT trim(infotablesk) AS sk, {o.cusip()} AS cusip, year * 4 + quarter - 1 AS p, CAST(value_per_share AS DOUBLE) AS v FROM holdings WHERE value_per_share > 0) GROUP BY 1, 2",
    "vp": "SELECT cik, cusip, p, shares, price, shares * price AS pv FROM pos JOIN px USING (cusip, p)",
    "nh": "SELECT *, pv / sum(pv) OVER (PARTITION BY cik, p) AS weight FROM vp WHERE pv > 1e-6",
    "aum": "SELECT cik, p, sum(pv) AS total FROM vp GROUP BY 1, 2",
    "ret": "SELECT cusip, p, ret, CASE WHEN ret > 0 THEN ln(ret) END AS log_return FROM (SELECT cusip, p, price / lag(price) OVER (PARTITION BY cusip ORDER BY p) AS ret FROM px) WHERE ret IS NOT NULL",
    "qn": "SELECT p, lead(p) OVER (ORDER BY p) AS np FROM (SELECT DISTINCT p FROM nh)",
    "dl": """SELECT b.cik, b.cusip, b.p, s1 - s0 AS change_in_shares, w1 - w0 AS change_in_weight, w1 * (a1.total / a0.total) - w0 AS change_in_adjusted_weight
  FROM (SELECT coalesce(c.cik, o.cik) AS cik, coalesce(c.cusip, o.cusip) AS cusip, coalesce(c.p, o.np) AS p, coalesce(c.shares, 0) AS s1, coalesce(c.weight, 0) AS w1, coalesce(o.shares, 0) AS s0, coalesce(o.weight, 0) AS w0
    FROM nh c FULL JOIN (SELECT nh.*, np FROM nh JOIN qn USING (p) WHERE np IS NOT NULL) o ON c.cik = o.cik AND c.cusip = o.cusip AND c.p = o.np) b
  JOIN aum a1 ON a1.cik = b.cik AND a1.p = b.p JOIN qn ON qn.np = b.p JOIN aum a0 ON a0.cik = b.cik AND a0.p = qn.p
  WHERE a1.total > 0 AND a0.total > 0 AND (abs(s1 - s0) > 0 OR abs(w1 - w0) > 1e-12 OR abs(w1 * (a1.total / a0.total) - w0) > 1e-12)""",
    # the recorded deltas, with canonical keys, each once
    "ch": f"SELECT DISTINCT {o.cik()} AS cik, {o.cusip()} AS cusip, year * 4 + quarter - 1 AS p, change_in_shares AS ds, CASE WHEN isnan(change_in_weight) THEN NULL ELSE change_in_weight END AS dw FROM changed_holdings",
    "buys": "SELECT * FROM ch WHERE dw > 0",
    "rk": """SELECT cusip, p, p + 1 AS pp, net, row_number() OVER (PARTITION BY p ORDER BY net DESC, cusip) AS rank
  FROM (SELECT cusip, p, CAST(sum(CASE WHEN dw > 0 THEN 1 WHEN dw < 0 THEN -1 ELSE 0 END) AS BIGINT) AS net FROM ch GROUP BY 1, 2)""",
    # the index listing, each security and year once
    "ru": f"SELECT {o.cusip()} AS cusip, year, max({o.ticker()}) AS ticker, max(upper(trim(name))) AS name, max(trading_start_date) AS s, max(CASE WHEN trading_end_date < DATE '2099-01-01' THEN trading_end_date END) AS e FROM russell3000 GROUP BY 1, 2",
    # the security's map of tickers: newest listing
    "tm": "SELECT cusip, arg_max(ticker, year) AS ticker, min(s) AS s, arg_max(name, year) AS name FROM ru WHERE ticker IS NOT NULL GROUP BY 1",
    "fd": f"SELECT * FROM (SELECT {o.cusip()} AS cusip, year * 4 + quarter - 1 AS p, revision, {FINITE}, row_number() OVER (PARTITION BY {o.cusip()}, year, quarter ORDER BY revision DESC) AS rn FROM cusip_financial_data) WHERE rn = 1",
}
NEEDS = {"pos": ["h"], "vp": ["pos", "px"], "nh": ["vp"], "aum": ["vp"], "ret": ["px"], "qn": ["nh"], "dl": ["nh", "aum", "qn"], "buys": ["ch"], "rk": ["ch"], "tm": ["ru"]}


def ctes(*names: str) -> str:
    """The WITH clause for the named tables and what they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in NEEDS.get(n, []):
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order)


class Base:
    """The same tables as lazy frames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self._px: DataFrame | None = None
        self._vp: DataFrame | None = None

    def kept(self) -> Base:
        """For plans that read the valued positions several times: they and the prices are written once."""
        self._px = written(H.median_per_share(self.raw("holdings")), "prices")
        self._vp = written(self.vp(), "positions")
        return self

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def pos(self) -> DataFrame:
        return H.positions(self.raw("holdings"))

    def px(self) -> DataFrame:
        return self._px if self._px is not None else H.median_per_share(self.raw("holdings"))

    def vp(self) -> DataFrame:
        if self._vp is not None:
            return self._vp
        return H.value_positions(self.pos(), self.px()).select("cik", "cusip", "p", "shares", "price", "pv")

    def nh(self) -> DataFrame:
        return H.weights(self.vp()).select("cik", "cusip", "p", "shares", "price", "pv", "weight")

    def aum(self) -> DataFrame:
        return H.assets(self.vp())

    def ret(self) -> DataFrame:
        return H.returns(self.px())

    def dl(self) -> DataFrame:
        self.kept()
        return H.deltas(self.nh(), self.aum())

    def ch(self) -> DataFrame:
        w = F.col("change_in_weight")
        return self.raw("changed_holdings").select(cik_key("cik").alias("cik"), cusip_key("cusip").alias("cusip"), period().alias("p"), F.col("change_in_shares").alias("ds"), F.when(~F.isnan(w), w).alias("dw")).distinct()

    def buys(self) -> DataFrame:
        return self.ch().filter(F.col("dw") > 0)

    def rk(self) -> DataFrame:
        sign = F.when(F.col("dw") > 0, 1).when(F.col("dw") < 0, -1).otherwise(0)
        net = self.ch().groupBy("cusip", "p").agg(F.sum(sign).alias("net"))
        # at most one row per security of a quarter
        return net.select("cusip", "p", (F.col("p") + 1).alias("pp"), "net", F.row_number().over(W.partitionBy("p").orderBy(F.desc("net"), "cusip")).alias("rank"))

    def ru(self) -> DataFrame:
        end = F.col("trading_end_date")
        r = self.raw("russell3000").select(
            cusip_key("cusip").alias("cusip"), "year", ticker_key("ticker").alias("ticker"), F.upper(F.trim("name")).alias("name"), F.col("trading_start_date").alias("s"), F.when(end < F.lit("2099-01-01").cast("date"), end).alias("e")
        )
        return r.groupBy("cusip", "year").agg(*[F.max(c).alias(c) for c in ("ticker", "name", "s", "e")])

    def tm(self) -> DataFrame:
        return self.ru().filter("ticker IS NOT NULL").groupBy("cusip").agg(F.max_by("ticker", "year").alias("ticker"), F.min("s").alias("s"), F.max_by("name", "year").alias("name"))

    def fd(self) -> DataFrame:
        f = self.raw("cusip_financial_data").select(cusip_key("cusip").alias("cusip"), period().alias("p"), "revision", *[finite(F.col(c)).alias(c) for c in RATIOS])
        return f.groupBy("cusip", "p").agg(F.max(F.struct("revision", *RATIOS)).alias("s")).select("cusip", "p", "s.*")


def big(*columns: str) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


def rnd(*columns: str, digits: int = 6) -> list[Column]:
    """Rounded doubles, never -0.0."""
    return [(F.round(c, digits) + F.lit(0.0)).alias(c) for c in columns]
