"""Streams of quarterly deliveries and of events.

Every job runs with ``availableNow``: it takes what is there, commits its offsets and stops, so a later
run goes on where this one ended.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarterloom.session import delete_on_exit, shared_dir, ship
from quarterloom.sinks.writers import write_partitioned


def folder(spark: SparkSession, name: str) -> str:
    """A place that does not exist yet, in a new folder that goes when the application ends."""
    parent = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    delete_on_exit(spark, parent)
    return os.path.join(parent, name)


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Event-time windows with a watermark: in append or update mode rows later than ``late`` are left out of closed
    windows; complete mode keeps all windows and rows."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream to the end of its input and gives the table it wrote."""
    _finish(stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path))
    return stream.sparkSession.read.parquet(path)


def ingest_quarters(stream: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ("year", "quarter")) -> None:
    """Each micro-batch replaces the quarters it brings, so a repeated batch changes nothing."""

    def load(batch: DataFrame, _: int) -> None:
        write_partitioned(batch, path, by, "replace")

    _finish(stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def running_change(stream: DataFrame) -> DataFrame:
    """Stateful difference of a user's event values against the last one seen before: (user_id, n, last,
    change). The latest value is that of the greatest (ts, event_id) seen so far, whatever the chunks and batches
    its rows come in: an older event that comes later counts but changes nothing. The state is four numbers per user, so no
    user's history is held."""
    ship(stream.sparkSession)
    schema = "user_id long, n long, last double, change double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, ts, event = state.get if state.exists else (0, None, None, None)
        start, newest = last, None if ts is None else (ts, event)
        for b in batches:  # in no order among themselves
            b = b[b["ts"].notna() & b["event_id"].notna()]
            if len(b):
                at = b.sort_values(["ts", "event_id"]).iloc[-1]
                mine = (int(at["ts"].value), int(at["event_id"]))
                if newest is None or mine > newest:
                    newest, last = mine, float(at["value"])
                n += len(b)
        state.update((n, last, *(newest or (None, None))))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": [last], "change": [None if start is None or last is None else last - start]})

    return stream.groupBy("user_id").applyInPandasWithState(step, schema, "n long, last double, ts long, event long", "update", GroupStateTimeout.NoTimeout)
