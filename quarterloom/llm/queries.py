"""Queries of the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.functions.keys import accession_key, cik_key, cusip_key, issuer_key
from quarterloom.llm.bpe import encode_corpus
from quarterloom.llm.mixing import Mix, mix_sources
from quarterloom.llm.sentences import split_sentences
from quarterloom.llm.survivors import Field, survivors
from quarterloom.llm.topn import top_n
from quarterloom.plans import oracle as o
from quarterloom.plans.registry import query
from quarterloom.sources.tables import table

LINE = ["cik", "cusip", "year", "quarter", "sshprnamt"]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "holdings")
    return h.select(cik_key("cik").alias("cik"), cusip_key("cusip").alias("cusip"), "year", "quarter", "sshprnamt", F.trim("infotablesk").alias("sk"), "filingdate", "value", "accessionnumber", "nameofissuer")


H_SQL = f"""h AS (SELECT {o.cik()} AS cik, {o.cusip()} AS cusip, year, quarter, sshprnamt, trim(infotablesk) AS sk, filingdate, value,
  coalesce(filingdate, DATE '0001-01-01') AS d, accessionnumber, nameofissuer FROM holdings)"""


@query(
    "p1_found",
    f"""
WITH {H_SQL}
SELECT min(sk) AS first_sk, arg_max(sk, (d, sk)) AS survivor_sk, coalesce(arg_max(sk, (d, sk)) FILTER (WHERE value > 0), '') AS value_sk
FROM h WHERE sshprnamt IS NOT NULL GROUP BY cik, cusip, year, quarter, sshprnamt HAVING count(DISTINCT sk) > 1""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).filter(F.col("sshprnamt").isNotNull()).select(*LINE, "sk", "filingdate", "value")
    got = survivors(r, LINE, "sk", "filingdate", [Field("value", F.col("value"), F.col("value") > 0)])
    return got.filter("several").select(F.col("first_id").alias("first_sk"), F.col("survivor_id").alias("survivor_sk"), F.coalesce("value_from", F.lit("")).alias("value_sk"))


@query(
    "p1_survivors",
    f"""
WITH {H_SQL},
l AS (SELECT *, CASE WHEN sshprnamt IS NULL THEN sk ELSE '' END AS alone,
  CASE WHEN length(translate(accessionnumber, ' -', '')) = 18 THEN translate(accessionnumber, ' -', '') END AS a FROM h)
SELECT cik, cusip, year, quarter, sshprnamt, arg_max(sk, (d, sk)) AS survivor_sk, arg_max(a[1:10] || '-' || a[11:12] || '-' || a[13:18], (d, sk)) AS accessionnumber,
  max(filingdate) AS filingdate, CAST(arg_max(value, (d, sk)) FILTER (WHERE value > 0) AS DOUBLE) AS value,
  arg_max(rtrim(upper(trim(regexp_replace(nameofissuer, '\\s+', ' ', 'g'))), '.'), (d, sk)) AS nameofissuer
FROM l GROUP BY cik, cusip, year, quarter, sshprnamt, alone""",
)
def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per position line; lines without share count stay alone."""
    r = _records(spark, sf_dir).withColumn("alone", F.when(F.col("sshprnamt").isNull(), F.col("sk")).otherwise(""))
    fields = [
        Field("accessionnumber", accession_key("accessionnumber")),
        Field("filingdate_", F.col("filingdate")),
        Field("value", F.col("value"), F.col("value") > 0),
        Field("nameofissuer", issuer_key("nameofissuer")),
    ]
    got = survivors(r, [*LINE, "alone"], "sk", "filingdate", fields)
    return got.select(*LINE, F.col("survivor_id").alias("survivor_sk"), "accessionnumber", F.col("filingdate_").alias("filingdate"), F.col("value").cast("double").alias("value"), "nameofissuer")


@query(
    "p2_found",
    f"""
WITH c AS (SELECT DISTINCT {o.cik()} AS cik, year, quarter, {o.cusip()} AS cusip, change_in_weight AS w FROM changed_holdings
  WHERE change_in_weight IS NOT NULL AND NOT isnan(change_in_weight)),
r AS (SELECT *, row_number() OVER (PARTITION BY cik, year, quarter ORDER BY w DESC, cusip) AS rn FROM c)
SELECT cik, year, quarter, cusip FROM r WHERE rn <= 3""",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "changed_holdings").select(cik_key("cik").alias("cik"), "year", "quarter", cusip_key("cusip").alias("cusip"), "change_in_weight")
    return top_n(c, ["cik", "year", "quarter"], "change_in_weight", "cusip", 3).select("cik", "year", "quarter", "cusip")


@query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


@query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report.filter("short").select("source")


@query("p9_report")
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report


@query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).documents.filter("copies > 0").select("doc_id", "source", "copies")
