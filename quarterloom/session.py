"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(app: str = "quarterloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above. On a cluster the master and memory come from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: The folders made for applications that name none, by application.
_own: dict[str, str] = {}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, wherever they run: once per application its
    sources go to the executors as a zip file."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if sc.applicationId in _shipped or not root.is_dir():
        return
    name = os.path.join(tempfile.mkdtemp(prefix="quarterloom-code-"), f"{root.name}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).deleteOnExit(p)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (local runs, tests) a folder of this machine is made.
    """
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="quarterloom-")
        delete_on_exit(spark, _own[sc.applicationId])
    return _own[sc.applicationId]


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage so that lost executors cost no recomputation, fixes the rows (partition ids and
    samples taken from the result are stable) and gives the planner true sizes. The table is removed
    when the application ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.mode("error").parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table of a frame that ``written`` gave, once nothing reads it any more: steps of a long
    iteration would else fill the shared folder."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    shared = shared_dir(spark).rstrip("/").removeprefix("file://")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if shared in folder:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(conf).delete(p, True)
