from datetime import datetime, timedelta

from quarterloom.streaming import jobs as J


def test_running_change_over_several_chunks(spark, tmp_path):
    """A user's rows come in chunks of three, the latest in the first one."""
    day = datetime(2024, 1, 1)
    rows = [(i, day + timedelta(hours=i // 2), u, 100.0 * u + i) for u in (1, 2) for i in range(49, -1, -1)]
    source, out = str(tmp_path / "in"), []
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(source)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        s = spark.readStream.schema("event_id long, ts timestamp, user_id long, value double").parquet(source)
        keep = lambda batch, _: out.extend(batch.collect())
        J._finish(J.running_change(s).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, before)
    assert sorted((r["user_id"], r["n"], r["last"]) for r in out if r["n"]) == [(1, 50, 149.0), (2, 50, 249.0)]


def test_an_older_event_in_a_later_batch_is_no_last_value(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, value double"
    source, out = str(tmp_path / "in"), []
    keep = lambda batch, i: out.extend((i, *r) for r in batch.collect())
    for rows in ([(1, datetime(2024, 1, 2), 7, 20.0)], [(2, datetime(2024, 1, 1), 7, 10.0)], [(3, datetime(2024, 1, 3), 7, 50.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        s = spark.readStream.schema(schema).parquet(source)
        J._finish(J.running_change(s).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start())
    got = sorted(r for r in out)
    assert [r[1:] for r in got] == [(7, 1, 20.0, None), (7, 2, 20.0, 0.0), (7, 3, 50.0, 30.0)]
