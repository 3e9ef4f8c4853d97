"""Queries that go through sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.operators import holdings as H
from quarterloom.operators import universe as U
from quarterloom.plans.base import Base, big, rnd
from quarterloom.plans.registry import query
from quarterloom.sinks import writers as K
from quarterloom.session import written
from quarterloom.sources import readers as S
from quarterloom.streaming import jobs as J


@query("csv_to_parquet", "SELECT s_nationkey AS nation, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1")
def csv_to_parquet(spark: SparkSession, d: str) -> DataFrame:
    a, b = J.folder(spark, "csv"), J.folder(spark, "parquet")
    K.write_csv(Base(spark, d).raw("supplier"), a)
    S.csv_to_parquet(spark, a, b, {"s_suppkey": "bigint", "s_nationkey": "int", "s_acctbal": "double"})
    return spark.read.parquet(b).groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("filings_join", "SELECT o_custkey AS cik, count(*) AS n, round(sum(l_quantity), 2) AS shares FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (1, 2, 3, 5, 8, 13) GROUP BY 1")
def filings_join(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    x, y = J.folder(spark, "lines"), J.folder(spark, "submissions")
    b.raw("lineitem").select(F.col("l_orderkey").alias("ACCESSION_NUMBER"), F.col("l_quantity").alias("SSHPRNAMT")).write.option("header", True).option("sep", "\t").csv(x)
    b.raw("orders").select(F.col("o_orderkey").alias("ACCESSION_NUMBER"), F.col("o_custkey").alias("CIK")).write.option("header", True).option("sep", "\t").csv(y)
    got = S.extract(spark, "filings", lines=x, submissions=y, line_schema="ACCESSION_NUMBER string, SSHPRNAMT double", submission_schema="ACCESSION_NUMBER string, CIK string", filers=["1", "2", "3", "5", "8", "13"])
    return got.groupBy(F.col("CIK").cast("bigint").alias("cik")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("SSHPRNAMT"), 2).alias("shares"))


@query("quarter_files", "SELECT CAST(make_date(year, quarter * 3 - 2, 1) AS DATE) AS period_start, count(*) AS n FROM changed_holdings WHERE year = 2022 GROUP BY 1")
def quarter_files(spark: SparkSession, d: str) -> DataFrame:
    """One folder per quarter, the period only in its name."""
    f = J.folder(spark, "quarters")
    c = Base(spark, d).raw("changed_holdings").withColumn("f", F.make_date("year", F.col("quarter") * 3 - 2, F.lit(1)))
    c.drop("year", "quarter").write.partitionBy("f").parquet(f)
    got = S.read_quarter_files(spark, f"{f}/f=*", year=2022)
    return got.groupBy(F.col("PERIOD_START").alias("period_start")).agg(F.count(F.lit(1)).alias("n"))


@query("xml_scan", "SELECT s_name AS name, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS cusip FROM supplier")
def xml_scan(spark: SparkSession, d: str) -> DataFrame:
    f = J.folder(spark, "xml")
    r = Base(spark, d).raw("supplier").select(F.col("s_name").alias("name"), U.pad_cusip(F.col("s_suppkey").cast("string")).alias("cusip"))
    r.write.format("xml").option("rowTag", "invstOrSec").option("rootTag", "holdings").save(f)
    return S.read_xml(spark, f).select("name", "cusip")


LISTED = ", ".join(f"'{w}'" for w in S.NO_COMPANY)


@query("names_from_text", f"""WITH f AS (SELECT unnest(regexp_extract_all(text, '{S.LISTING_LINE.replace("'", "''")}', 1)) AS name FROM (SELECT nameofissuer || '  ' || format('{{:,}}', sshprnamt) || '  $ ' || format('{{:,}}', CAST(floor(value) AS BIGINT)) AS text FROM holdings WHERE sshprnamt >= 0 AND value >= 0)),
c AS (SELECT regexp_replace(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '\\([a-z,]+\\)', '', 'g'), '^\\s+|\\s+$', '', 'g') AS name FROM f)
SELECT min(name) AS name FROM c WHERE length(name) BETWEEN 2 AND 150 AND NOT regexp_matches(name, '^[0-9]') AND lower(name) NOT IN ({LISTED}) GROUP BY lower(name)""")
def names_from_text(spark: SparkSession, d: str) -> DataFrame:
    """Listing lines made of the holdings: issuer, shares, value."""
    h = Base(spark, d).raw("holdings").filter("sshprnamt >= 0 AND value >= 0")
    line = F.concat("nameofissuer", F.lit("  "), F.format_number("sshprnamt", 0), F.lit("  $ "), F.format_number(F.floor("value"), 0))
    return S.names_from_text(h.select(line.alias("text")), "text")


@query("partition_overwrite", "SELECT CAST(year AS BIGINT) AS year, count(*) AS n FROM changed_holdings GROUP BY 1")
def partition_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """All quarters appended, then those of one year delivered again."""
    f = J.folder(spark, "table")
    c = Base(spark, d).raw("changed_holdings")
    K.write_partitioned(c, f)
    K.write_partitioned(c.filter("year = 2022"), f, mode="replace")
    return spark.read.parquet(f).groupBy(*big("year")).agg(F.count(F.lit(1)).alias("n"))


@query("insert_if_absent", "SELECT count(*) AS n, CAST(sum(n_regionkey) AS BIGINT) AS keys FROM nation")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    f = J.folder(spark, "table")
    n = Base(spark, d).raw("nation")
    K.insert_if_absent(n.filter("n_nationkey < 10"), f, ["n_nationkey"])
    K.insert_if_absent(n, f, ["n_nationkey"])
    return spark.read.parquet(f).agg(F.count(F.lit(1)).alias("n"), F.sum("n_regionkey").cast("bigint").alias("keys"))


@query("resume_set", "SELECT DISTINCT CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter FROM changed_holdings WHERE NOT (year < 2022 AND quarter <> 2)")
def resume_set(spark: SparkSession, d: str) -> DataFrame:
    """Quarters still to do: finished are those with a metric."""
    f = J.folder(spark, "results")
    q = Base(spark, d).raw("changed_holdings").select(*big("year", "quarter")).distinct()
    q.filter("year < 2022").withColumn("metric", F.when(F.col("quarter") != 2, 1.0)).write.parquet(f)
    return K.remaining(q, f, ["year", "quarter"], ["metric"])


@query("graph_export", "SELECT 'nodes_cik' AS part, count(DISTINCT cik) AS n FROM ch UNION ALL SELECT 'nodes_cusip', count(DISTINCT cusip) FROM ch UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT cik, cusip, p FROM ch)")
def graph_export(spark: SparkSession, d: str) -> DataFrame:
    f = J.folder(spark, "graph")
    K.write_graph(Base(spark, d).ch().select("cik", "cusip", "p"), f, "cik", "cusip")
    one = lambda n: spark.read.parquet(f"{f}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n")
    return one("nodes_cik").unionByName(one("nodes_cusip")).unionByName(one("edges"))


@query("stream_quarters", "SELECT CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter, count(*) AS n FROM changed_holdings GROUP BY 1, 2")
def stream_quarters(spark: SparkSession, d: str) -> DataFrame:
    f, c = J.folder(spark, "table"), J.folder(spark, "offsets")
    schema = Base(spark, d).raw("changed_holdings").schema
    for _ in range(2):  # the second run finds nothing new
        J.ingest_quarters(spark.readStream.schema(schema).parquet(f"{d}/changed_holdings.parquet*"), f, c)
    return spark.read.parquet(f).groupBy(*big("year", "quarter")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_event_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    s = spark.readStream.schema(b.raw("events").schema).parquet(f"{d}/events.parquet*")
    return _complete(J.event_windows(s), spark).select("start", "event_type", "n", *rnd("total"))


@query("stream_late_events", """WITH e AS (SELECT *, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS upto FROM events),
m AS (SELECT max(CASE WHEN event_id % 3 = 0 THEN ts END) - INTERVAL 1 HOUR AS w1, max(ts) - INTERVAL 1 HOUR AS w2 FROM events)
SELECT CAST(start AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM e, m WHERE upto <= w2 AND (event_id % 3 < 2 OR upto > w1) GROUP BY 1, 2""")
def stream_late_events(spark: SparkSession, d: str) -> DataFrame:
    """Events come in three deliveries, by their number. Spark tells late rows by the watermark as it stood before the
    last delivery: rows of the third whose window the first has closed are left out, and only closed windows are given."""
    f, schema = J.folder(spark, "deliveries"), Base(spark, d).raw("events").schema
    for i in range(3):
        Base(spark, d).raw("events").filter(F.col("event_id") % 3 == i).coalesce(1).write.parquet(f"{f}/{i}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{f}/*")
    return J.run_to_table(J.event_windows(s), J.folder(spark, "windows"), J.folder(spark, "offsets")).select("start", "event_type", "n", *rnd("total"))


def _complete(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """The last complete result of a windowed stream, as a table."""
    path = J.folder(spark, "windows")

    def keep(batch: DataFrame, _: int) -> None:
        K.replace_table(batch, path)

    J._finish(stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", J.folder(spark, "offsets")).trigger(availableNow=True).start())
    return spark.read.parquet(path)


@query("stream_running_change", "SELECT CAST(user_id AS BIGINT) AS user_id, count(*) AS n, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1")
def stream_running_change(spark: SparkSession, d: str) -> DataFrame:
    path = J.folder(spark, "changes")

    def keep(batch: DataFrame, i: int) -> None:
        batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(path)

    s = spark.readStream.schema(Base(spark, d).raw("events").schema).parquet(f"{d}/events.parquet*")
    J._finish(J.running_change(s).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", J.folder(spark, "offsets")).trigger(availableNow=True).start())
    got = spark.read.parquet(path)
    return got.groupBy("user_id").agg(F.max_by("n", "batch").alias("n"), F.max_by("last", "batch").alias("last"))


# ---------------------------------------------------------------- tables, versions and exports


@query("create_and_copy", "SELECT CAST(year AS BIGINT) AS year, count(*) AS n, CAST(sum(abs(change_in_shares)) AS BIGINT) AS moved FROM changed_holdings GROUP BY 1")
def create_and_copy(spark: SparkSession, d: str) -> DataFrame:
    """Database and table made from a schema, rows inserted, a column filled in later, the table copied."""
    from uuid import uuid4

    c, db, f = Base(spark, d).raw("changed_holdings"), f"quarterloom_{uuid4().hex[:8]}", J.folder(spark, "table")
    K.create_database(spark, db, J.folder(spark, "database"))
    K.create_table(spark, f"{db}.loaded", c)
    if K.create_table(spark, f"{db}.loaded", c):
        raise AssertionError("a table was made twice")
    K.write_partitioned(c, f)
    K.backfill_column(spark, f, "moved", F.abs("change_in_shares"))
    spark.read.parquet(f).select(*c.columns).write.insertInto(f"{db}.loaded")
    K.copy_table(spark, f"{db}.loaded", f"{db}.copied")
    got = written(spark.table(f"{db}.copied").groupBy(*big("year")).agg(F.count(F.lit(1)).alias("n")).join(spark.read.parquet(f).groupBy(*big("year")).agg(F.sum("moved").alias("moved")), "year"), "copied")
    spark.sql(f"DROP DATABASE `{db}` CASCADE")
    return got


@query("table_versions", "SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation WHERE n_regionkey > 0")
def table_versions(spark: SparkSession, d: str) -> DataFrame:
    """The newest version holds; a damaged one is passed over."""
    f, n = J.folder(spark, "versions"), Base(spark, d).raw("nation")
    K.write_version(n, f)
    K.write_version(n.filter("n_regionkey > 0"), f)
    damaged = K.write_version(n.limit(1), f)
    fs, p = K._fs(spark, f"{f}/{damaged}")
    fs.delete(p, True)
    return K.read_version(spark, f).agg(F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").cast("bigint").alias("keys"))


@query("csv_by_quarter", "SELECT CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter, count(*) AS n FROM changed_holdings GROUP BY 1, 2")
def csv_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    """One folder of text files per quarter; the files are listed by the year in their name and read again."""
    f = J.folder(spark, "csv")
    K.write_csv(Base(spark, d).raw("changed_holdings"), f, by=["year", "quarter"])
    return spark.read.option("header", True).csv(f).groupBy(*big("year", "quarter")).agg(F.count(F.lit(1)).alias("n"))


@query("files_of_years", "SELECT DISTINCT CAST(year AS BIGINT) AS year FROM russell3000")
def files_of_years(spark: SparkSession, d: str) -> DataFrame:
    """Index files, listed by the four digits in their name; files without are passed over."""
    f = J.folder(spark, "files")
    r = Base(spark, d).raw("russell3000").select("year", "name")
    for y in [x["year"] for x in r.select("year").distinct().collect()]:  # one file per yearly listing
        r.filter(F.col("year") == y).select("name").coalesce(1).write.csv(f"{f}/index_{y}.csv")
    r.limit(1).coalesce(1).write.parquet(f"{f}/other")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f).select(F.regexp_replace("path", "/part-[^/]*$", "").alias("path")).distinct()
    return S.files_by_year(there).select(*big("year"))


@query("config_flattened", "SELECT 'region_' || r_name AS key, CAST(r_regionkey AS VARCHAR) AS value FROM region")
def config_flattened(spark: SparkSession, d: str) -> DataFrame:
    f = J.folder(spark, "config")
    m = Base(spark, d).raw("region").agg(F.map_from_entries(F.collect_list(F.struct("r_name", F.col("r_regionkey").cast("string")))).alias("m"))  # five regions
    m.select(F.to_json(F.struct(F.col("m").alias("region"))).alias("value")).coalesce(1).write.text(f)
    return S.flatten_config(spark, f)


@query("parquet_or_empty", "SELECT 'there' AS part, count(*) AS n FROM nation UNION ALL SELECT 'missing', 0")
def parquet_or_empty(spark: SparkSession, d: str) -> DataFrame:
    schema = Base(spark, d).raw("nation").schema
    one = lambda n, p: S.parquet_or_empty(spark, p, schema).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n")
    return one("there", f"{d}/nation.parquet").unionByName(one("missing", f"{d}/no-such-table.parquet"))


@query("plain_names", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem")
def plain_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in small letters without underscores; columns to leave out may be absent."""
    li = Base(spark, d).raw("lineitem").toDF(*[c.upper() for c in Base(spark, d).raw("lineitem").columns])
    return H.plain_names(li).drop("llinestatus", "putcall").agg(F.count(F.lit(1)).alias("n"), F.sum("llinenumber").cast("bigint").alias("numbers"))


@query("best_kept", "SELECT max(o_totalprice) AS metric FROM orders")
def best_kept(spark: SparkSession, d: str) -> DataFrame:
    """Metrics and their payload are replaced only by better ones."""
    f, o = J.folder(spark, "best"), Base(spark, d).raw("orders")
    for best in (o, o.filter("o_orderkey < 0"), o.withColumn("o_totalprice", F.col("o_totalprice") / 2)):
        K.save_best(best.agg(F.max("o_totalprice").alias("metric")), o.select("o_orderkey"), f, "metric")
    return spark.read.parquet(f"{f}/metrics")
