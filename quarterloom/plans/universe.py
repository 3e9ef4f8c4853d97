"""Queries that build and audit the security universe, and those on fundamentals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.functions.keys import cusip_key, period, quarter_end
from quarterloom.operators import fundamentals as N
from quarterloom.operators import universe as U
from quarterloom.plans import oracle as o
from quarterloom.plans.base import Base, big, rnd
from quarterloom.plans.registry import query


@query("pad_cusip", "SELECT DISTINCT cusip AS raw, left(lpad(coalesce(trim(cusip), ''), 9, '0'), 9) AS cusip FROM russell3000")
def pad_cusip(spark: SparkSession, d: str) -> DataFrame:
    r = Base(spark, d).raw("russell3000").select(F.col("cusip").alias("raw")).distinct()
    return r.select("raw", U.pad_cusip(F.col("raw")).alias("cusip"))


@query("first_three_words", "SELECT DISTINCT name, array_to_string(string_split_regex(trim(name), '\\s+')[1:3], ' ') AS words FROM russell3000")
def first_three_words(spark: SparkSession, d: str) -> DataFrame:
    return Base(spark, d).raw("russell3000").select("name").distinct().select("name", U.first_words(F.col("name")).alias("words"))


@query(
    "name_match_cusip",
    """, n AS (SELECT DISTINCT name, array_to_string(string_split_regex(trim(name), '\\s+')[1:2], ' ') AS w FROM tm),
i AS (SELECT upper(trim(nameofissuer)) AS issuer, """ + o.cusip() + """ AS cusip, count(*) AS n FROM holdings GROUP BY 1, 2),
s AS (SELECT n.name, i.cusip, CAST(sum(i.n) AS BIGINT) AS n FROM n JOIN i ON contains(i.issuer, n.w) AND list_contains(string_split(i.issuer, ' '), string_split(n.w, ' ')[1]) WHERE n.w <> '' GROUP BY 1, 2)
SELECT name, cusip, n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, cusip) AS rn FROM s) WHERE rn = 1""",
)
def name_match_cusip(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    h = b.raw("holdings").select(F.upper(F.trim("nameofissuer")).alias("issuer"), cusip_key("cusip").alias("cusip"))
    return U.match_names(b.tm(), h, "name", "issuer", "cusip", words=2, whole_first=True)


@query(
    "name_containment_cusip",
    """, n AS (SELECT DISTINCT name, array_to_string(string_split_regex(trim(name), '\\s+')[1:3], ' ') AS w FROM tm),
i AS (SELECT upper(trim(nameofissuer)) AS issuer, """ + o.cusip() + """ AS cusip, count(*) AS n FROM holdings GROUP BY 1, 2),
s AS (SELECT n.name, i.cusip, CAST(sum(i.n) AS BIGINT) AS n FROM n JOIN i ON contains(i.issuer, n.w) WHERE n.w <> '' GROUP BY 1, 2)
SELECT name, cusip, n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, cusip) AS rn FROM s) WHERE rn = 1""",
)
def name_containment_cusip(spark: SparkSession, d: str) -> DataFrame:
    """The reference's match: three words, contained anywhere; name_match_cusip is its restricted form."""
    b = Base(spark, d)
    h = b.raw("holdings").select(F.upper(F.trim("nameofissuer")).alias("issuer"), cusip_key("cusip").alias("cusip"))
    return U.match_names(b.tm(), h, "name", "issuer", "cusip")


@query("ticker_lookup", f"""
WITH r AS (SELECT cusip, min({o.ticker()}) AS ticker FROM russell3000 GROUP BY 1), k AS (SELECT DISTINCT cusip FROM holdings)
SELECT k.cusip, coalesce(a.ticker, b.ticker) AS ticker FROM k LEFT JOIN r a ON a.cusip = k.cusip LEFT JOIN r b ON b.cusip = left(lpad(coalesce(trim(k.cusip), ''), 9, '0'), 9)""")
def ticker_lookup(spark: SparkSession, d: str) -> DataFrame:
    from quarterloom.functions.keys import ticker_key

    b = Base(spark, d)
    ref = b.raw("russell3000").select("cusip", ticker_key("ticker").alias("ticker"))
    return U.lookup_padded(b.raw("holdings").select("cusip").distinct(), ref.withColumnRenamed("cusip", "ref"), "cusip", "ref", "ticker")


@query("valid_records", "SELECT CASE WHEN coalesce(cusip, '') IN ('', '0', '000000000') OR coalesce(ticker, '') IN ('', '0', '000000000') THEN 'invalid' ELSE 'valid' END AS kind, count(*) AS n FROM ru GROUP BY 1")
def valid_records(spark: SparkSession, d: str) -> DataFrame:
    good, bad = U.split_valid(Base(spark, d).ru(), "cusip", "ticker")
    return good.select(F.lit("valid").alias("kind")).unionByName(bad.select(F.lit("invalid").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dedupe_oldest",
    """SELECT cusip, ticker, CAST(year AS BIGINT) AS year FROM (
  SELECT *, row_number() OVER (PARTITION BY cusip ORDER BY year, coalesce(ticker, '')) AS a, row_number() OVER (PARTITION BY ticker ORDER BY year, cusip) AS b FROM ru)
WHERE a = 1 AND (b = 1 OR ticker IS NULL)""",
)
def dedupe_oldest(spark: SparkSession, d: str) -> DataFrame:
    r = Base(spark, d).ru().select("cusip", "ticker", "year", F.coalesce("ticker", F.lit("")).alias("t"))
    return U.oldest_only(r, ["cusip", "ticker"], "year", ["t", "cusip"]).select("cusip", "ticker", *big("year"))


@query("company_oldest_year", "SELECT name, CAST(min(year) AS BIGINT) AS first_year, arg_max(cusip, (year, cusip)) AS cusip FROM ru GROUP BY 1")
def company_oldest_year(spark: SparkSession, d: str) -> DataFrame:
    got = U.first_then_newest(Base(spark, d).ru(), "name", "year", "cusip")
    return got.select("name", F.col("first_at").cast("bigint").alias("first_year"), "cusip")


@query("trading_periods", "SELECT CAST(user_id AS BIGINT) AS ticker, CAST(min(ts) AS DATE) AS start_date, CAST(max(ts) AS DATE) AS end_date, CASE WHEN CAST(max(ts) AS DATE) >= (SELECT CAST(max(ts) AS DATE) - 3 FROM events) THEN 'active' ELSE 'inactive' END AS status FROM events GROUP BY 1")
def trading_periods(spark: SparkSession, d: str) -> DataFrame:
    e = Base(spark, d).raw("events").select(F.col("user_id").cast("bigint").alias("ticker"), F.to_date("ts").alias("day"))
    last = e.agg(F.date_sub(F.max("day"), 3)).scalar()
    got = e.groupBy("ticker").agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"))
    return got.withColumn("status", F.when(F.col("end_date") >= last, "active").otherwise("inactive"))


@query("end_date_filter", "SELECT cusip, CAST(year AS BIGINT) AS year, e AS end_date FROM ru WHERE e IS NULL OR e >= DATE '2018-01-01'")
def end_date_filter(spark: SparkSession, d: str) -> DataFrame:
    return Base(spark, d).ru().filter(F.col("e").isNull() | (F.col("e") >= F.lit("2018-01-01").cast("date"))).select("cusip", *big("year"), F.col("e").alias("end_date"))


@query("next_trading_day", "WITH c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5), f AS (SELECT DISTINCT filingdate AS f FROM holdings WHERE filingdate IS NOT NULL), g AS (SELECT DISTINCT f - INTERVAL 22 YEAR AS m FROM f) SELECT DISTINCT CAST(m AS DATE) AS day_at, (SELECT min(d) FROM c WHERE d >= m AND d <= m + INTERVAL 10 DAY) AS next_day FROM g")
def next_trading_day(spark: SparkSession, d: str) -> DataFrame:
    """The calendar is the order dates from Monday to Friday; the dates are moved into its years."""
    b = Base(spark, d)
    cal = b.raw("orders").filter("dayofweek(o_orderdate) BETWEEN 2 AND 6").select(F.to_date("o_orderdate").alias("d"))
    at = b.raw("holdings").filter("filingdate IS NOT NULL").select(F.add_months("filingdate", -264).alias("day_at")).distinct()
    return U.asof_next(at, cal, "day_at", "d")


@query("nearest_quarter_end", """
WITH f AS (SELECT DISTINCT filingdate AS d FROM holdings WHERE filingdate IS NOT NULL), q AS (SELECT d, last_day(make_date(year(d), 3 * k, 1)) AS q FROM f, (VALUES (1), (2), (3), (4)) t(k))
SELECT d, arg_min(q, (abs(date_diff('day', d, q)), q)) AS quarter_end FROM q GROUP BY d""")
def nearest_quarter_end(spark: SparkSession, d: str) -> DataFrame:
    f = Base(spark, d).raw("holdings").filter("filingdate IS NOT NULL").select(F.col("filingdate").alias("d")).distinct()
    return f.select("d", U.nearest_quarter_end(F.col("d")).alias("quarter_end"))


@query("quarter_calendar", "SELECT CAST(range AS DATE) AS period_start, CAST(year(range) AS BIGINT) AS year, CAST(quarter(range) AS BIGINT) AS quarter FROM range(DATE '2013-04-01', DATE '2025-01-01', INTERVAL 3 MONTH)")
def quarter_calendar(spark: SparkSession, d: str) -> DataFrame:
    q = U.quarter_starts(spark, "2013-04-01", "2025-01-01")
    return q.select("period_start", F.year("period_start").cast("bigint").alias("year"), F.quarter("period_start").cast("bigint").alias("quarter"))


@query("match_stats", """, t AS (SELECT cusip, ticker FROM ru WHERE year = 2020 AND ticker IS NOT NULL), n AS (SELECT cusip, ticker FROM ru WHERE year = 2023 AND ticker IS NOT NULL)
SELECT CASE WHEN t.cusip IS NULL THEN 'right_only' WHEN n.cusip IS NULL THEN 'left_only' ELSE 'both' END AS origin, count(*) AS n, CAST(sum(CASE WHEN t.ticker = n.ticker THEN 1 ELSE 0 END) AS BIGINT) AS same
FROM t FULL JOIN n ON t.cusip = n.cusip GROUP BY 1""")
def match_stats(spark: SparkSession, d: str) -> DataFrame:
    ru = Base(spark, d).ru().filter("ticker IS NOT NULL")
    both = U.outer_with_origin(ru.filter("year = 2020"), ru.filter("year = 2023"), "cusip", "ticker")
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("same").cast("bigint")).alias("same"))


@query("coverage", "SELECT (SELECT count(*) FROM (SELECT DISTINCT cusip FROM pos) k WHERE EXISTS (SELECT 1 FROM fd WHERE fd.cusip = k.cusip)) AS covered, (SELECT count(*) FROM (SELECT DISTINCT cusip FROM pos) k WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.cusip = k.cusip)) AS missing")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    k, f = b.pos().select("cusip").distinct(), b.fd().select("cusip").distinct().withColumn("there", F.lit(1))
    return k.join(f, "cusip", "left").agg(F.count("there").alias("covered"), (F.count(F.lit(1)) - F.count("there")).alias("missing"))


@query("issuer_mode", f"SELECT issuer, cusip, n FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY n DESC, cusip) AS rn FROM (SELECT upper(trim(nameofissuer)) AS issuer, {o.cusip()} AS cusip, count(*) AS n FROM holdings GROUP BY 1, 2)) WHERE rn = 1 AND issuer IS NOT NULL")
def issuer_mode(spark: SparkSession, d: str) -> DataFrame:
    h = Base(spark, d).raw("holdings").select(F.upper(F.trim("nameofissuer")).alias("issuer"), cusip_key("cusip").alias("cusip")).filter("issuer IS NOT NULL")
    return U.most_frequent(h, ["issuer"], "cusip")


@query("before_after_counts", "SELECT count(*) AS rows_before, count(DISTINCT cusip) AS keys_before, (SELECT count(*) FROM ru) AS rows_after, (SELECT count(DISTINCT cusip) FROM ru) AS keys_after, round(100.0 * ((SELECT count(*) FROM ru) - count(*)) / count(*), 4) AS pct_rows FROM russell3000")
def before_after_counts(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    after = b.ru().agg(F.count(F.lit(1)).alias("r"), F.count_distinct("cusip").alias("k")).select(F.struct("r", "k").alias("s")).scalar()
    before = b.raw("russell3000").agg(F.count(F.lit(1)).alias("rows_before"), F.count_distinct("cusip").alias("keys_before")).withColumn("s", after)
    return before.select("rows_before", "keys_before", F.col("s.r").alias("rows_after"), F.col("s.k").alias("keys_after"), F.round(100.0 * (F.col("s.r") - F.col("rows_before")) / F.col("rows_before"), 4).alias("pct_rows"))


# ---------------------------------------------------------------- fundamentals


@query("ttm_sums", "SELECT cusip, CAST(p AS BIGINT) AS p, round(CASE WHEN count(fcf_per_share) OVER w = 4 THEN sum(fcf_per_share) OVER w END, 6) AS fcf_per_share_ttm, round(CASE WHEN count(diluted_eps) OVER w = 4 THEN sum(diluted_eps) OVER w END, 6) AS diluted_eps_ttm FROM fd WINDOW w AS (PARTITION BY cusip ORDER BY p ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def ttm_sums(spark: SparkSession, d: str) -> DataFrame:
    got = N.trailing_sum(Base(spark, d).fd(), "cusip", "p", ["fcf_per_share", "diluted_eps"])
    return got.select("cusip", *big("p"), *rnd("fcf_per_share_ttm", "diluted_eps_ttm"))


EV = "e AS (SELECT CAST(user_id AS BIGINT) AS ticker, CAST(ts AS DATE) AS day, value FROM events), pt AS (SELECT ticker, m AS day_at FROM (SELECT DISTINCT ticker FROM e), (SELECT DISTINCT last_day(day) AS m FROM e))"


def _series(b: Base) -> tuple[DataFrame, DataFrame]:
    e = b.raw("events").select(F.col("user_id").cast("bigint").alias("ticker"), F.to_date("ts").alias("day"), "value")
    months = e.select(F.last_day("day").alias("m")).distinct().agg(F.sort_array(F.collect_set("m"))).scalar()  # one entry per month
    return e, e.select("ticker").distinct().select("ticker", F.explode(months).alias("day_at"))


@query("price_asof", f"WITH {EV}, v AS (SELECT ticker, day, max(value) AS value FROM e GROUP BY 1, 2) SELECT ticker, day_at, arg_max(v.value, v.day) AS value FROM pt LEFT JOIN v USING (ticker) WHERE v.day <= day_at GROUP BY 1, 2 UNION ALL SELECT ticker, day_at, NULL FROM pt WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.ticker = pt.ticker AND v.day <= day_at)")
def price_asof(spark: SparkSession, d: str) -> DataFrame:
    e, pt = _series(Base(spark, d))
    return N.asof_last(pt, e, "ticker", "day_at", "day", "value")


@query("dividends_trailing", f"WITH {EV} SELECT ticker, day_at, round(coalesce((SELECT sum(value) FROM e WHERE e.ticker = pt.ticker AND e.day <= day_at AND e.day > day_at - 10), 0), 6) AS total FROM pt")
def dividends_trailing(spark: SparkSession, d: str) -> DataFrame:
    e, pt = _series(Base(spark, d))
    return N.sum_in_window(pt, e, "ticker", "day_at", "day", "value", days=10).select("ticker", "day_at", F.round("value_10d", 6).alias("total"))


@query("valuation_ratios", "SELECT px.cusip, CAST(px.p AS BIGINT) AS p, round(price / nullif(diluted_eps, 0), 6) AS pe, round(fcf_per_share / nullif(price, 0), 6) + 0.0 AS fcf_yield FROM px JOIN fd ON fd.cusip = px.cusip AND fd.p = px.p")
def valuation_ratios(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    j = b.px().join(b.fd(), ["cusip", "p"])
    return j.select("cusip", *big("p"), F.round(N.safe_ratio(F.col("price"), F.col("diluted_eps")), 6).alias("pe"), (F.round(N.safe_ratio(F.col("fcf_per_share"), F.col("price")), 6) + 0.0).alias("fcf_yield"))


@query("upsert_do_nothing", """, a AS (SELECT cusip, p, roe FROM fd WHERE p < 8085), b AS (SELECT cusip, p, roe + 1 AS roe FROM fd WHERE p >= 8083)
SELECT cusip, CAST(p AS BIGINT) AS p, round(roe, 6) + 0.0 AS roe FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.cusip = b.cusip AND a.p = b.p))""")
def upsert_do_nothing(spark: SparkSession, d: str) -> DataFrame:
    f = Base(spark, d).fd().select("cusip", "p", "roe")
    got = N.insert_new(f.filter("p < 8085"), f.filter("p >= 8083").withColumn("roe", F.col("roe") + 1), ["cusip", "p"])
    return got.select("cusip", *big("p"), *rnd("roe"))


@query("upsert_latest", f"""
WITH f AS (SELECT {o.cusip()} AS cusip, year * 4 + quarter - 1 AS p, revision, CASE WHEN isfinite(roe) THEN roe END AS roe FROM cusip_financial_data),
b AS (SELECT * FROM f WHERE revision = 0 UNION ALL SELECT * FROM f WHERE revision > 0)
SELECT cusip, CAST(p AS BIGINT) AS p, CAST(max(revision) AS BIGINT) AS revision, round(arg_max(struct_pack(v := roe), (revision, roe IS NOT NULL, roe)).v, 6) + 0.0 AS roe FROM b GROUP BY 1, 2""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    from quarterloom.functions.keys import finite

    f = Base(spark, d).raw("cusip_financial_data").select(cusip_key("cusip").alias("cusip"), period().alias("p"), "revision", finite(F.col("roe")).alias("roe"))
    got = N.upsert_newest(f.filter("revision = 0"), f.filter("revision > 0"), ["cusip", "p"], "revision")
    return got.select("cusip", *big("p", "revision"), *rnd("roe"))


@query("json_flatten", "SELECT event_id, 'props_k' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    e = Base(spark, d).raw("events").select("event_id", F.concat(F.lit('{"props": '), F.col("props"), F.lit("}")).alias("j"))
    return N.flatten_json(e, "j").select("event_id", "key", "value").filter("value IS NOT NULL")


@query("null_counts", "SELECT 'roe' AS field, count(roe) AS n, count(*) - count(roe) AS n_null FROM fd UNION ALL SELECT 'ev_ebitda', count(ev_ebitda), count(*) - count(ev_ebitda) FROM fd UNION ALL SELECT 'pe_ratio', count(pe_ratio), count(*) - count(pe_ratio) FROM fd")
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    f = Base(spark, d).fd()
    cols = ["roe", "ev_ebitda", "pe_ratio"]
    one = f.agg(F.count(F.lit(1)).alias("all"), *[F.count(c).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n"), (F.col("all") - F.col(c)).alias("n_null")) for c in cols])).alias("s")).select("s.*")


@query("period_range", "SELECT min(year(period_start)) || 'Q' || min(quarter) AS first, max(year(period_start)) || 'Q' || max(quarter) AS last, count(DISTINCT period_start) AS n FROM holdings")
def period_range(spark: SparkSession, d: str) -> DataFrame:
    return Base(spark, d).raw("holdings").agg(F.concat(F.min("year"), F.lit("Q"), F.min("quarter")).alias("first"), F.concat(F.max("year"), F.lit("Q"), F.max("quarter")).alias("last"), F.count_distinct("period_start").alias("n"))


@query("ticker_suffix", "SELECT DISTINCT ticker, CASE WHEN contains(ticker, '.') THEN ticker ELSE ticker || '.US' END AS symbol FROM ru WHERE ticker IS NOT NULL")
def ticker_suffix(spark: SparkSession, d: str) -> DataFrame:
    t = Base(spark, d).ru().filter("ticker IS NOT NULL").select("ticker").distinct()
    return t.select("ticker", F.when(F.instr("ticker", ".") > 0, F.col("ticker")).otherwise(F.concat("ticker", F.lit(".US"))).alias("symbol"))


@query("download_range", "SELECT cusip, CAST(min(q) - 400 AS DATE) AS from_day, CAST(max(q) + 10 AS DATE) AS to_day FROM (SELECT cusip, last_day(make_date(CAST(p // 4 AS INT), CAST(p % 4 * 3 + 3 AS INT), 1)) AS q FROM fd) GROUP BY 1")
def download_range(spark: SparkSession, d: str) -> DataFrame:
    q = quarter_end(F.floor(F.col("p") / 4).cast("int"), (F.col("p") % 4 + 1).cast("int"))
    f = Base(spark, d).fd().select("cusip", q.alias("q"))
    return f.groupBy("cusip").agg(F.date_sub(F.min("q"), 400).alias("from_day"), F.date_add(F.max("q"), 10).alias("to_day"))


@query("statement_figures", """WITH q AS (SELECT l_suppkey AS k, year(l_shipdate) AS y, quarter(l_shipdate) AS q, count(*) AS n, round(sum(l_extendedprice)) AS v, sum(l_linenumber) AS m FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT k, y, q, v AS net_income, CASE WHEN n % 3 = 0 THEN m ELSE n + 2 * m END AS debt, CASE WHEN n % 2 = 0 THEN n ELSE 3 * m END AS cash, CASE WHEN n % 4 = 0 THEN m WHEN n % 4 = 1 THEN v - m ELSE 0 END AS fcf, n * 10 AS shares FROM q)
SELECT CAST(k AS BIGINT) AS supplier, CAST(y AS INT) AS year, CAST(q AS INT) AS quarter, CAST(net_income AS DOUBLE) AS net_income, CAST(debt AS DOUBLE) AS debt, CAST(cash AS DOUBLE) AS cash, CAST(fcf AS DOUBLE) AS fcf, round(net_income / shares, 6) AS diluted_eps, round(fcf / shares, 6) + 0.0 AS fcf_per_share FROM f""")
def statement_figures(spark: SparkSession, d: str) -> DataFrame:
    """Statements as nested JSON, made of suppliers' lines as a stand-in, with figures left out so that others take their place."""
    li = Base(spark, d).raw("lineitem").withColumns({"y": F.year("l_shipdate"), "q": F.quarter("l_shipdate")})
    g = li.groupBy("l_suppkey", "y", "q").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice")).alias("v"), F.sum("l_linenumber").alias("m"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    fields = lambda **k: F.map_from_arrays(F.array(*[F.lit(x) for x in k]), F.array(*[text(v) for v in k.values()]))
    n, v, m = F.col("n"), F.col("v"), F.col("m")
    g = g.select("l_suppkey", F.date_format(F.make_date("y", F.col("q") * 3, F.lit(28)), "yyyy-MM-dd").alias("day"),
        fields(netIncome=v).alias("i"),
        fields(commonStockSharesOutstanding=n * 10, shortLongTermDebtTotal=F.when(n % 3 == 0, m), shortTermDebt=n, longTermDebt=2 * m, cashAndShortTermInvestments=F.when(n % 2 == 0, n), cash=m, shortTermInvestments=2 * m).alias("b"),
        fields(freeCashFlow=F.when(n % 4 == 0, m).when(n % 4 == 2, F.lit(0)), totalCashFromOperatingActivities=F.when(n % 4 == 1, v), capitalExpenditures=m).alias("c"),
    )
    part = lambda c: F.struct(F.map_from_entries(F.collect_list(F.struct("day", c))).alias("quarterly"))
    docs = g.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.to_json(F.struct(F.struct(part("i").alias("Income_Statement"), part("b").alias("Balance_Sheet"), part("c").alias("Cash_Flow")).alias("Financials"))).alias("json"))  # some dozen quarters each
    got = N.statements(docs, "json", "supplier")
    return got.select(*big("supplier"), "year", "quarter", "net_income", "debt", "cash", "fcf", *rnd("diluted_eps", "fcf_per_share"))
