"""Queries of the general record-level operators over the holdings tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.functions.keys import OPEN_END, cik_key, cusip_key, finite, period, period_quarter, period_year, quarter_end, ticker_key
from quarterloom.operators import holdings as H
from quarterloom.operators.asof import asof_known
from quarterloom.operators.history import new_store
from quarterloom.operators.impute import als_impute, held_out_errors
from quarterloom.operators.skew import heavy_keys, key_percentiles, key_profile
from quarterloom.operators.snapshots import snapshot_diff
from quarterloom.plans import oracle as o
from quarterloom.plans.registry import query
from quarterloom.sources.tables import table

# ---------------------------------------------------------------- p3: a few keys holding most records


@query(
    "p3_found",
    f"""
WITH r AS (SELECT 'holdings' AS table_name, {o.cik()} AS cik FROM holdings
  UNION ALL SELECT 'changed_holdings', {o.cik()} FROM changed_holdings),
n AS (SELECT table_name, cik, count(*) AS n FROM r GROUP BY 1, 2),
t AS (SELECT table_name, sum(n) AS total FROM n GROUP BY 1)
SELECT n.table_name, n.cik FROM n JOIN t USING (table_name) WHERE n.n >= 0.025 * t.total AND n.cik IS NOT NULL""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = None
    for name in ("holdings", "changed_holdings"):
        one = table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), cik_key("cik").alias("cik"), period().alias("period"))
        rows = one if rows is None else rows.unionByName(one)
    return heavy_keys(rows, "table_name", "cik", "period", 0.025).select("table_name", "cik")


@query(
    "p3_filer_profile",
    f"""
WITH h AS (SELECT {o.cik()} AS cik, sshprnamt FROM holdings),
f AS (SELECT cik, sshprnamt, count(*) AS n FROM h WHERE sshprnamt IS NOT NULL GROUP BY 1, 2),
m AS (SELECT cik, sshprnamt, row_number() OVER (PARTITION BY cik ORDER BY n DESC, sshprnamt) AS rn FROM f)
SELECT h.cik, count(*) AS n_rows, count(h.sshprnamt) AS n_values, count(DISTINCT h.sshprnamt) AS n_distinct,
  CAST(sum(h.sshprnamt) AS BIGINT) AS total, max(m.sshprnamt) AS mode
FROM h LEFT JOIN m ON m.cik = h.cik AND m.rn = 1 GROUP BY h.cik""",
)
def p3_filer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "holdings").select(cik_key("cik").alias("cik"), "sshprnamt")
    return key_profile(rows, ["cik"], "sshprnamt").drop("mode_freq")


@query(
    "p3_filer_percentiles",
    f"""
SELECT {o.cik()} AS cik, quantile_disc(sshprnamt, 0.1) AS p10, quantile_disc(sshprnamt, 0.5) AS p50, quantile_disc(sshprnamt, 0.9) AS p90
FROM holdings WHERE sshprnamt IS NOT NULL GROUP BY 1""",
)
def p3_filer_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "holdings").select(cik_key("cik").alias("cik"), "sshprnamt")
    got = key_percentiles(rows, ["cik"], "sshprnamt", [0.1, 0.5, 0.9])
    return got.select("cik", *[F.col("percentiles")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@query(
    "p3_filer_changes",
    f"""
SELECT {o.cik()} AS cik, count(*) AS n_rows, count(change_in_shares) AS n_values, count(DISTINCT change_in_shares) AS n_distinct,
  CAST(sum(change_in_shares) AS BIGINT) AS total FROM changed_holdings GROUP BY 1""",
)
def p3_filer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "changed_holdings").select(cik_key("cik").alias("cik"), "change_in_shares")
    return key_profile(rows, ["cik"], "change_in_shares").drop("mode", "mode_freq")


# ---------------------------------------------------------------- p4: attributes as known at event time

EVENTS_SQL = f"""e AS (SELECT DISTINCT 'holdings' AS event_table, trim(infotablesk) AS event_key, {o.cusip()} AS cusip, filingdate AS day
    FROM holdings WHERE filingdate IS NOT NULL
  UNION SELECT 'changed_holdings', {o.cik()} || '|' || {o.cusip()} || '|' || year || '|' || quarter, {o.cusip()},
    last_day(make_date(year, quarter * 3, 1)) FROM changed_holdings)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "holdings").filter(F.col("filingdate").isNotNull())
    h = h.select(F.lit("holdings").alias("event_table"), F.trim("infotablesk").alias("event_key"), cusip_key("cusip").alias("cusip"), F.col("filingdate").alias("day"))
    c = table(spark, sf_dir, "changed_holdings").select(cik_key("cik").alias("cik"), cusip_key("cusip").alias("cusip"), "year", "quarter")
    c = c.select(F.lit("changed_holdings").alias("event_table"), F.concat_ws("|", "cik", "cusip", "year", "quarter").alias("event_key"), "cusip", quarter_end().alias("day"))
    return h.unionByName(c)


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "cusip_financial_data")
    return f.select(cusip_key("cusip").alias("cusip"), "year", "quarter", "revision", "reported_on", finite(F.col("pe_ratio")).alias("pe_ratio"))


@query(
    "p4_found",
    f"""
WITH {EVENTS_SQL},
v AS (SELECT {o.cusip()} AS cusip, year, quarter, revision, reported_on FROM cusip_financial_data WHERE reported_on IS NOT NULL)
SELECT event_table, event_key, (max(k) // 1000) // 10 AS fin_year, (max(k) // 1000) % 10 AS fin_quarter, max(k) % 1000 AS fin_revision
FROM (SELECT e.*, (v.year * 10 + v.quarter) * 1000 + v.revision AS k FROM e JOIN v ON v.cusip = e.cusip AND v.reported_on <= e.day)
GROUP BY event_table, event_key""".replace("(max(k) // 1000) // 10 AS", "CAST((max(k) // 1000) // 10 AS INT) AS").replace("(max(k) // 1000) % 10 AS", "CAST((max(k) // 1000) % 10 AS INT) AS").replace("max(k) % 1000 AS", "CAST(max(k) % 1000 AS INT) AS"),
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = asof_known(_events(spark, sf_dir), _versions(spark, sf_dir), "cusip", "day", "reported_on", ["year", "quarter", "revision"], ["year", "quarter", "revision"], drop_copies=True)
    return got.filter(F.col("known").isNotNull()).select("event_table", "event_key", *[F.col(f"known.{c}").alias(f"fin_{c}") for c in ("year", "quarter", "revision")])


@query(
    "p4_known_ratio",
    f"""
WITH {EVENTS_SQL},
v AS (SELECT {o.cusip()} AS cusip, reported_on, (year * 10 + quarter) * 1000 + revision AS k,
  CASE WHEN isfinite(pe_ratio) THEN pe_ratio END AS pe_ratio FROM cusip_financial_data WHERE reported_on IS NOT NULL),
b AS (SELECT e.event_table, e.event_key, arg_max(struct_pack(p := v.pe_ratio), v.k) AS s FROM e LEFT JOIN v ON v.cusip = e.cusip AND v.reported_on <= e.day GROUP BY 1, 2)
SELECT event_table, event_key, s.p AS pe_ratio FROM b""",
)
def p4_known_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = asof_known(_events(spark, sf_dir), _versions(spark, sf_dir), "cusip", "day", "reported_on", ["year", "quarter", "revision"], ["pe_ratio"], drop_copies=True)
    return got.select("event_table", "event_key", F.col("known.pe_ratio").alias("pe_ratio"))


# ---------------------------------------------------------------- p5: history of changing attributes


@query(
    "p5_found",
    f"""
WITH r AS (SELECT {o.cusip()} AS cusip, year, max({o.ticker()}) AS ticker, max(trading_start_date) AS s,
    max(CASE WHEN trading_end_date < DATE '2099-01-01' THEN trading_end_date END) AS e
  FROM russell3000 GROUP BY 1, 2),
c AS (SELECT cusip, year, s, e, last_value(ticker IGNORE NULLS) OVER (PARTITION BY cusip ORDER BY year ROWS UNBOUNDED PRECEDING) AS ticker FROM r),
g AS (SELECT *, CASE WHEN lag(year) OVER w = year - 1 AND lag(ticker) OVER w IS NOT DISTINCT FROM ticker
    AND lag(s) OVER w IS NOT DISTINCT FROM s AND lag(e) OVER w IS NOT DISTINCT FROM e THEN 0 ELSE 1 END AS new
  FROM c WINDOW w AS (PARTITION BY cusip ORDER BY year)),
v AS (SELECT *, sum(new) OVER (PARTITION BY cusip ORDER BY year) AS run FROM g)
SELECT cusip, ticker, min(year) AS from_year, max(year) AS to_year FROM v GROUP BY cusip, ticker, run""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_history(spark, sf_dir).select("cusip", "ticker", "from_year", "to_year")


@query(
    "p5_history",
    f"""
WITH r AS (SELECT {o.cusip()} AS cusip, year, max({o.ticker()}) AS ticker, max(trading_start_date) AS s,
    max(CASE WHEN trading_end_date < DATE '2099-01-01' THEN trading_end_date END) AS e
  FROM russell3000 GROUP BY 1, 2),
c AS (SELECT cusip, year, s, e, last_value(ticker IGNORE NULLS) OVER (PARTITION BY cusip ORDER BY year ROWS UNBOUNDED PRECEDING) AS ticker FROM r),
g AS (SELECT *, CASE WHEN lag(year) OVER w = year - 1 AND lag(ticker) OVER w IS NOT DISTINCT FROM ticker
    AND lag(s) OVER w IS NOT DISTINCT FROM s AND lag(e) OVER w IS NOT DISTINCT FROM e THEN 0 ELSE 1 END AS new
  FROM c WINDOW w AS (PARTITION BY cusip ORDER BY year)),
v AS (SELECT *, sum(new) OVER (PARTITION BY cusip ORDER BY year) AS run FROM g)
SELECT cusip, min(year) AS from_year, max(year) AS to_year, ticker, s AS trading_start_date, e AS trading_end_date FROM v GROUP BY cusip, ticker, s, e, run""",
)
def p5_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("trading_end_date")
    r = table(spark, sf_dir, "russell3000").select(
        cusip_key("cusip").alias("cusip"), "year", ticker_key("ticker").alias("ticker"), "trading_start_date", F.when(end < F.lit(OPEN_END).cast("date"), end).alias("trading_end_date")
    )
    # two deliveries: all listings but the newest, then that one, which only appends what it changes
    store = new_store(spark, "cusip", "year", {"symbol": ["ticker"], "trading": ["trading_start_date", "trading_end_date"]}, carried=["ticker"])
    newest = r.agg(F.max("year")).first()[0]
    store.load(r.filter(F.col("year") < newest))
    store.load(r.filter(F.col("year") == newest))
    return store.versions().withColumnsRenamed({"from_at": "from_year", "to_at": "to_year"})


# ---------------------------------------------------------------- p6: what changed between full snapshots


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, cusip, period, shares): lines with the same share count are one line delivered again."""
    return H.positions(table(spark, sf_dir, "holdings")).withColumnRenamed("p", "period")


@query(
    "p6_found",
    f"""
WITH h AS (SELECT DISTINCT {o.cik()} AS cik, {o.cusip()} AS cusip, year * 4 + quarter - 1 AS p, sshprnamt FROM holdings),
q AS (SELECT DISTINCT cik, p FROM h),
s AS (SELECT cik, cusip, p, sum(sshprnamt) AS n FROM h WHERE sshprnamt IS NOT NULL GROUP BY 1, 2, 3),
d AS (SELECT coalesce(b.cik, a.cik) AS cik, coalesce(b.cusip, a.cusip) AS cusip, coalesce(b.p, a.p + 1) AS p, a.n AS n0, b.n AS n1
  FROM s a FULL JOIN s b ON b.cik = a.cik AND b.cusip = a.cusip AND b.p = a.p + 1),
k AS (SELECT d.* FROM d JOIN q x ON x.cik = d.cik AND x.p = d.p JOIN q y ON y.cik = d.cik AND y.p = d.p - 1 WHERE n0 IS DISTINCT FROM n1),
c AS (SELECT DISTINCT {o.cik()} AS cik, {o.cusip()} AS cusip, year * 4 + quarter - 1 AS p, change_in_shares AS ch FROM changed_holdings)
SELECT k.cik, k.cusip, CAST(k.p // 4 AS INT) AS year, CAST(k.p % 4 + 1 AS INT) AS quarter,
  CASE WHEN n0 IS NULL THEN 'added' WHEN n1 IS NULL THEN 'removed' ELSE 'changed' END AS diff_kind,
  CASE WHEN bool_or(coalesce(ch = coalesce(n1, 0) - coalesce(n0, 0), false)) THEN 'same' WHEN count(c.cik) > 0 THEN 'differs' ELSE 'absent' END AS recorded_as
FROM k LEFT JOIN c ON c.cik = k.cik AND c.cusip = k.cusip AND c.p = k.p GROUP BY k.cik, k.cusip, k.p, n0, n1""",
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "holdings").select(cik_key("cik").alias("cik"), period().alias("period"))
    log = table(spark, sf_dir, "changed_holdings").select(cik_key("cik").alias("cik"), cusip_key("cusip").alias("cusip"), period().alias("period"), "change_in_shares")
    got = snapshot_diff(positions(spark, sf_dir), ["cik", "cusip"], "period", ["shares"], ["cik"], listed, log, "change_in_shares")
    p = F.col("period")
    return got.select("cik", "cusip", period_year(p).alias("year"), period_quarter(p).alias("quarter"), "diff_kind", "recorded_as")


# ---------------------------------------------------------------- p7: filling missing values

#: Numbers that the ratios can take; codes such as -9999, 999999 or 1e9 lie outside.
RANGES = {"ev_ebitda": (-5000.0, 5000.0), "dividend_yield": (0.0, 10.0), "fcf_per_share": (-5000.0, 5000.0), "roe": (-500.0, 500.0)}
CONTEXT = {c: (-5000.0, 5000.0) for c in ("diluted_eps", "pe_ratio", "price_to_sales", "price_to_book", "debt_to_equity")}


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "cusip_financial_data").select(cusip_key("cusip").alias("cusip"), period().alias("period"), "revision", *RANGES, *CONTEXT)
    # of each quarter the highest revision, with map-side combining
    return f.groupBy("cusip", "period").agg(F.max(F.struct("revision", *RANGES, *CONTEXT)).alias("s")).select("cusip", "period", "s.*")


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return als_impute(ratios(spark, sf_dir), "cusip", "period", RANGES, CONTEXT, categorical=["period"])


def _p7_sql() -> str:
    parts = []
    for f, (lo, hi) in RANGES.items():
        parts.append(f"SELECT cusip, p, '{f}' AS field_name, CASE WHEN isfinite({f}) AND {f} BETWEEN {lo} AND {hi} THEN {f} END AS x FROM t WHERE rn = 1")
    return f"""
WITH t AS (SELECT *, {o.cusip()} AS k, year * 4 + quarter - 1 AS p,
  row_number() OVER (PARTITION BY {o.cusip()}, year, quarter ORDER BY revision DESC) AS rn FROM cusip_financial_data),
u AS ({" UNION ALL ".join(parts).replace("SELECT cusip,", "SELECT k AS cusip,")}),
l AS (SELECT *, coalesce(max(CASE WHEN x IS NOT NULL THEN p END) OVER (PARTITION BY cusip, field_name ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS f FROM u)
SELECT cusip, CAST(p // 4 AS INT) AS year, CAST(p % 4 + 1 AS INT) AS quarter, field_name,
  CAST(CASE WHEN f < 0 THEN 0 ELSE f // 4 END AS INT) AS from_year, CAST(CASE WHEN f < 0 THEN 0 ELSE f % 4 + 1 END AS INT) AS from_quarter
FROM l WHERE x IS NULL"""


@query("p7_found", _p7_sql())
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_filled").alias("filled"), F.col(f"{f}_from").alias("from_p")) for f in RANGES]))
    got = completed(spark, sf_dir).select("cusip", "period", cells.alias("c")).filter("c.filled")
    p, q = F.col("period"), F.col("c.from_p")
    return got.select(
        "cusip", period_year(p).alias("year"), period_quarter(p).alias("quarter"), "c.field_name",
        F.coalesce(period_year(q), F.lit(0)).alias("from_year"), F.coalesce(period_quarter(q), F.lit(0)).alias("from_quarter"),
    )


@query("p7_completed")
def p7_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("period")
    return completed(spark, sf_dir).select("cusip", period_year(p).alias("year"), period_quarter(p).alias("quarter"), *[c for f in RANGES for c in (f, f"{f}_filled")])


@query("p7_held_out")
def p7_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median absolute errors on known cells kept out of the fit: of the method, of the last value and of the security's median."""
    return held_out_errors(ratios(spark, sf_dir), "cusip", "period", RANGES, CONTEXT, categorical=["period"])


@query("p7_status")
def p7_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings' trading_status, a category, filled from similar listings."""
    r = table(spark, sf_dir, "russell3000")
    end = F.when(F.col("trading_end_date") < F.lit(OPEN_END).cast("date"), F.col("trading_end_date"))
    r = r.select(cusip_key("cusip").alias("cusip"), "year", F.initcap(F.trim("trading_status")).alias("trading_status"), F.year("trading_start_date").alias("since"), (F.year(end) - F.col("year")).alias("left"), end.isNotNull().cast("double").alias("ends"))
    got = als_impute(r, "cusip", "year", {}, {"since": (1800.0, 2100.0), "left": (-300.0, 300.0), "ends": (0.0, 1.0)}, fill_categorical=["trading_status"])
    return got.select("cusip", "year", "trading_status", "trading_status_filled")
