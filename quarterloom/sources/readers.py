"""Files into frames: delimited, columnar, nested and semi-structured sources."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Strategy = Callable[..., DataFrame]
STRATEGIES: dict[str, Strategy] = {}


def strategy(name: str) -> Callable[[Strategy], Strategy]:
    """Registers an extraction strategy: a function of the session and options."""

    def add(fn: Strategy) -> Strategy:
        STRATEGIES[name] = fn
        return fn

    return add


def extract(spark: SparkSession, kind: str, **options: object) -> DataFrame:
    if kind not in STRATEGIES:
        raise ValueError(f"unknown extraction strategy {kind}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[kind](spark, **options)


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """Header line, declared schema; fields that do not parse become NULL."""
    return spark.read.csv(path, header=True, schema=schema, sep=sep, mode="PERMISSIVE")


@strategy("filings")
def read_filings(spark: SparkSession, lines: str, submissions: str, line_schema: str, submission_schema: str, key: str = "ACCESSION_NUMBER", filers: list[str] | None = None) -> DataFrame:
    """Position lines with their submissions, two tab-separated files joined on the accession number.

    The optional list of filers is filtered before the join.
    """
    a, b = read_delimited(spark, lines, line_schema, "\t"), read_delimited(spark, submissions, submission_schema, "\t")
    if filers:
        b = b.filter(F.col("CIK").isin(filers))
    return a.join(b, key)


def csv_to_parquet(spark: SparkSession, source: str, target: str, dtypes: Mapping[str, str] | None = None, compression: str = "snappy") -> None:
    """All columns as text, or cast as mapped; what does not cast becomes NULL. An empty source raises
    before anything is written; the writer's commit protocol leaves no partial output behind."""
    if compression not in ("snappy", "gzip", "brotli", "lz4", "zstd", "none"):
        raise ValueError(f"unknown compression {compression}")
    df = spark.read.csv(source, header=True, inferSchema=False)
    if not df.columns or df.isEmpty():
        raise ValueError(f"{source} has no rows")
    if dtypes:
        df = df.select(*[F.col(c).try_cast(dtypes[c]).alias(c) if c in dtypes else F.col(c) for c in df.columns])
    df.write.mode("overwrite").option("compression", compression).parquet(target)


def parquet_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The table, or no rows of the schema where there is no file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    if there is None or len(there) == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def upper_unique(df: DataFrame) -> DataFrame:
    """Upper-case names; of columns that then bear the same name the first stays."""
    seen: dict[str, Column] = {}
    for i, c in enumerate(df.columns):
        seen.setdefault(c.upper(), F.col(f"`{c}`"))
    return df.select(*[x.alias(n) for n, x in seen.items()])


def period_of_file(column: Column | None = None) -> Column:
    """The period column or, where it is missing, the date in the file's name."""
    named = F.try_to_date(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})(?!.*\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return named if column is None else F.coalesce(column, named)


def read_quarter_files(spark: SparkSession, pattern: str, period: str = "PERIOD_START", year: int | None = None) -> DataFrame:
    """All quarters' files as one frame, the period from the column or the file name."""
    df = spark.read.option("mergeSchema", "true").parquet(pattern).withColumn("__p", period_of_file())
    df = upper_unique(df).withColumnRenamed("__P", "__p")
    p = F.coalesce(F.col(period).cast("date"), F.col("__p")) if period in df.columns else F.col("__p")
    df = df.withColumn(period, p).drop("__p")
    return df.filter(F.year(period) == year) if year else df


def read_xml(spark: SparkSession, path: str, row_tag: str = "invstOrSec", schema: str = "name string, cusip string, ticker string") -> DataFrame:
    """One row per element; rows without a name are dropped."""
    df = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(schema).load(path)
    return df.filter(F.col("name").isNotNull() & (F.trim("name") != ""))


# A listing's line (company, shares, value) and the words that are no company.
LISTING_LINE = r"([A-Z][A-Za-z0-9\.\-&(),'/ ]+?)\s+(\d{1,3}(?:,\d{3})*)\s+\$?\s*(\d{1,3}(?:,\d{3})*)"
NO_COMPANY = ["the", "and", "or", "of", "in", "on", "at", "to", "for", "common stocks", "schedule", "security", "shares", "value", "form n-q", "ishares", "russell"]


def names_from_text(df: DataFrame, text: str) -> DataFrame:
    """Company names of a listing's lines in extracted text, each followed by its shares and value: cut at the last stop,
    footnote marks left out, 2 to 150 characters, no leading digit, no heading; each once in lower case (the least spelling stays)."""
    found = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(LISTING_LINE), 1)).alias("name"))
    cut = F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), r"\([a-z,]+\)", "")
    got = found.select(F.regexp_replace(cut, r"^\s+|\s+$", "").alias("name"))
    ok = F.length("name").between(2, 150) & ~F.col("name").rlike(r"^\d") & ~F.lower("name").isin(NO_COMPANY)
    return got.filter(ok).groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name")).select("name")


#: Words that head a plain list and are no company.
HEADINGS = ["company", "ticker", "page", "index", "total", "source"]


def names_from_lines(df: DataFrame, text: str) -> DataFrame:
    """Company names of a plain list, one per line: footnotes and trailing dots cut, 2 to 150 characters,
    no leading digit, no heading; each once in lower case (the least spelling stays)."""
    line = F.explode(F.split(F.col(text), r"\r?\n")).alias("line")
    c = F.trim(F.regexp_replace(F.regexp_replace("line", r"\([a-z],?\s?[a-z]?\)", ""), r"\s*\.{2,}.*$", ""))
    got = df.select(line).select(c.alias("name"))
    ok = F.length("name").between(2, 150) & ~F.col("name").rlike(r"^\d") & ~F.lower("name").isin(HEADINGS)
    return got.filter(ok).groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name")).select("name")


def read_binary_text(spark: SparkSession, path: str, decode: Callable[[bytes], str]) -> DataFrame:
    """(path, text) of binary documents by a decoder, one file at a time within a task."""
    import pandas as pd

    @F.pandas_udf("string")
    def to_text(content: pd.Series) -> pd.Series:
        return content.map(lambda b: decode(bytes(b)))

    return spark.read.format("binaryFile").load(path).select("path", to_text("content").alias("text"))


def read_index_file(spark: SparkSession, path: str, decode: Callable[[bytes], str] | None = None) -> DataFrame:
    """Names of an index listing by the file's suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "xml":
        return read_xml(spark, path)
    if suffix == "pdf":
        if decode is None:
            raise ValueError("a decoder is needed for PDF files")
        return names_from_text(read_binary_text(spark, path, decode), "text")
    if suffix in ("csv", "txt"):
        return names_from_lines(spark.read.text(path), "value")
    raise ValueError(f"no reader for .{suffix} files")


def files_by_year(df: DataFrame, path: str = "path") -> DataFrame:
    """Files with a four-digit year in their name, sorted by it."""
    y = F.regexp_extract(F.element_at(F.split(F.col(path), "/"), -1), r"(\d{4})", 1)
    return df.withColumn("year", y.try_cast("int")).filter("year IS NOT NULL").orderBy("year", path)


def flatten_config(spark: SparkSession, path: str, separator: str = "_") -> DataFrame:
    """(key, value) of a JSON object of objects, keys joined."""
    whole = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string, map<string, string>>")
    return whole.select(F.explode(m).alias("a", "m")).select("a", F.explode("m").alias("b", "value")).select(F.concat_ws(separator, "a", "b").alias("key"), "value")


# Fixed value: how the page of a security names its ticker.
TICKER_LINE = r"Ticker\s+Symbol[:\s]+([A-Za-z]{1,5})\*?"


def ticker_from_html(c: Column) -> Column:
    got = F.regexp_extract(c, TICKER_LINE, 1)
    return F.when(got != "", F.upper(got))
