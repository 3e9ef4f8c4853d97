"""Frames into files: partitioned tables, upserts, resume sets and exports.

Tables are parquet folders partitioned by columns. A write replaces whole partitions by the dynamic
overwrite of the commit protocol, so a failed job leaves the table as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.operators.fundamentals import insert_new
from quarterloom.session import written


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("year", "quarter"), mode: str = "append") -> None:
    """append: adds rows. replace: replaces the partitions that occur in ``df`` and no others. fail:
    raises if the table exists. Rows are brought together by partition (and split when large by AQE),
    so a partition is not written as one small file per task."""
    if mode not in ("append", "replace", "fail"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "fail" and exists(df.sparkSession, path):
        raise FileExistsError(path)
    w = df.hint("rebalance", *by).write.partitionBy(*by)
    if mode == "replace":
        w.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        w.mode("append").parquet(path)


def upsert_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Rows replace all earlier ones with the same partition values."""
    write_partitioned(df, path, by, "replace")


def insert_if_absent(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends the rows whose key the table does not have; returns their number."""
    spark = df.sparkSession
    if not exists(spark, path):
        there = spark.createDataFrame([], df.schema)
    else:
        there = spark.read.parquet(path).select(*df.columns)
    new = written(insert_new(there.limit(0), df, keys).join(there.select(*keys), list(keys), "left_anti"), "new")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def replace_table(df: DataFrame, path: str) -> None:
    """Writes the new table beside the old one, then exchanges them by renaming. If the second renaming fails, the old
    table is put back. Between the two there is a moment without a table at ``path``: readers that run at the same
    time use ``write_version``."""
    spark = df.sparkSession
    tmp, old = f"{path}.tmp-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(tmp)
    fs, p = _fs(spark, path)
    new, aside = _fs(spark, tmp)[1], _fs(spark, old)[1]
    had = fs.exists(p)
    if had and not fs.rename(p, aside):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(new, p):
        if had and not fs.rename(aside, p):
            raise OSError(f"{path} is at {old}: it could be neither replaced nor put back")
        raise OSError(f"{path} could not be replaced")
    if had:
        fs.delete(aside, True)


CURRENT = "_current"


def write_version(df: DataFrame, path: str) -> str:
    """A table of versions: every write is a folder of its own under ``path``, and a small pointer file, replaced last, names
    the one that holds. Readers see the old version or the new one, never none; a failed write changes nothing."""
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(f"{path}/{name}")
    spark.createDataFrame([(name,)], "version string").coalesce(1).write.mode("append").parquet(f"{path}/{CURRENT}")
    return name


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version that can be read: a version whose files are damaged or gone is passed over for the one before;
    None if there is none."""
    if not exists(spark, f"{path}/{CURRENT}"):
        return None
    pointers = spark.read.parquet(f"{path}/{CURRENT}").select("version", F.col("_metadata.file_modification_time").alias("t"))
    for r in pointers.orderBy(F.desc("t")).collect():  # one row per write of the table
        try:
            df = spark.read.parquet(f"{path}/{r['version']}")
            df.write.format("noop").mode("overwrite").save()
            return df
        except Exception:  # noqa: BLE001 - whatever makes it unreadable
            continue
    return None


def create_table(spark: SparkSession, name: str, like: DataFrame, by: Sequence[str] = ()) -> bool:
    """Creates a parquet table with the columns of ``like``, partitioned by ``by``, if there is none; whether it did."""
    if spark.catalog.tableExists(name):
        return False
    w = like.limit(0).write.format("parquet")
    (w.partitionBy(*by) if by else w).saveAsTable(name)
    return True


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Creates a database if there is none, in the warehouse or in a folder of its own."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`" + (f" LOCATION '{location}'" if location else ""))


def copy_table(spark: SparkSession, source: str, target: str) -> int:
    """Copies a table into another, which is replaced; the number of its rows."""
    spark.table(source).write.mode("overwrite").saveAsTable(target)
    return spark.table(target).count()


def backfill_column(spark: SparkSession, path: str, column: str, value: Column, by: Sequence[str] = ("year", "quarter")) -> None:
    """Adds or recomputes a column of a partitioned table: written to a new table, which then takes the old one's place."""
    df = written(spark.read.parquet(path).withColumn(column, value), "backfill")
    write_partitioned(df, path, by, "replace")


def remaining(todo: DataFrame, path: str, keys: Sequence[str], done: Sequence[str] = ()) -> DataFrame:
    """The part of ``todo`` whose key has no finished row (all of ``done`` given) in the table."""
    spark = todo.sparkSession
    if not exists(spark, path):
        return todo
    there = spark.read.parquet(path)
    for c in done:
        there = there.filter(F.col(c).isNotNull())
    return todo.join(there.select(*keys).distinct(), list(keys), "left_anti")


def write_csv(df: DataFrame, path: str, by: Sequence[str] = (), twin: str | None = None) -> None:
    """Text export, by partition if asked, with a parquet twin if a path is given."""
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)
    if twin:
        df.write.mode("overwrite").parquet(twin)


def write_split(valid: DataFrame, invalid: DataFrame, path: str) -> None:
    valid.write.mode("overwrite").parquet(f"{path}/valid")
    invalid.write.mode("overwrite").parquet(f"{path}/invalid")


def write_graph(edges: DataFrame, path: str, source: str, target: str) -> None:
    """Node and edge tables of a property graph: each node once, each edge once per period."""
    edges.select(F.col(source).alias("id")).distinct().write.mode("overwrite").parquet(f"{path}/nodes_{source}")
    edges.select(F.col(target).alias("id")).distinct().write.mode("overwrite").parquet(f"{path}/nodes_{target}")
    edges.dropDuplicates([source, target, *(["p"] if "p" in edges.columns else [])]).write.mode("overwrite").parquet(f"{path}/edges")


def save_best(metrics: DataFrame, payload: DataFrame, path: str, metric: str) -> bool:
    """Keeps the payload with its metrics if the metric beats the stored one."""
    spark = metrics.sparkSession
    new = metrics.agg(F.max(metric)).first()[0]
    if exists(spark, f"{path}/metrics"):
        old = spark.read.parquet(f"{path}/metrics").agg(F.max(metric)).first()[0]
        if old is not None and (new is None or new <= old):
            return False
    replace_table(payload, f"{path}/payload")
    replace_table(metrics, f"{path}/metrics")
    return True
