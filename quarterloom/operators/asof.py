"""Attributes as known at event time.

Every event gets, of the versions of its entity that were known on its day, the best one by a given
order (which need not be the order in which they became known). Entities are sharded by time: a
shard is (entity, span of days). Each shard that has events receives the versions that became known
within it and, as carry-in, the best of all versions known before it, so every shard is complete in
itself. Shards with more events than ``hot_rows`` are split once more by a salt on the event's own
columns, with the shard's few versions replicated to each salt. Then every piece is merged
independently: its rows are sorted by day, versions before events, and a running maximum carries the
best version along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarterloom.session import written

#: The list of hot shards is broadcast (about 40 bytes each); it is kept below this length.
BROADCAST_ROWS = 200_000


def _shard(day: Column, span_days: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / span_days).cast("int")


def asof_known(
    events: DataFrame,
    versions: DataFrame,
    entity: str,
    event_day: str,
    known_day: str,
    order: Sequence[str],
    take: Sequence[str],
    span_days: int = 366,
    hot_rows: int = 500_000,
    drop_copies: bool = False,
) -> DataFrame:
    """``events`` with a struct column ``known`` of the ``take`` columns of the best version, or NULL.

    Best: the greatest ``order`` columns among the versions of the same ``entity`` with
    ``known_day <= event_day``; equal ``order``: the greatest ``take`` columns, so the result is the
    same on every run. NULLs in ``order`` and ``take`` count as smallest.

    Events keep all their columns and, unless ``drop_copies``, their repetitions. Events without entity or day, or with no
    version known, get ``known`` NULL. Versions without entity or ``known_day`` are never known.
    Columns of the two inputs may bear the same names; a column ``known`` of the events gives way to
    the result's. Empty inputs give no events or only NULLs.
    """
    events = events.drop("known")
    names = list(dict.fromkeys([*order, *take]))
    v = versions.filter(F.col(entity).isNotNull() & F.col(known_day).isNotNull()).select(
        F.col(entity).alias("__e"), F.col(known_day).alias("__day"), F.struct(*names).alias("__v")
    )
    # of the versions that became known on one day only the best can ever be taken
    v = v.groupBy("__e", "__day").agg(F.max("__v").alias("__v")).withColumn("__shard", _shard(F.col("__day"), span_days))

    e = (events.distinct() if drop_copies else events).select(
        F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("__ev"), F.col(entity).alias("__e"), F.col(event_day).alias("__day")
    ).withColumn("__shard", _shard(F.col("__day"), span_days))
    # where the events are (copies counted): at most (entities x spans) rows
    sizes = written(
        events.select(F.col(entity).alias("__e"), _shard(F.col(event_day), span_days).alias("__shard"))
        .filter(F.col("__e").isNotNull() & F.col("__shard").isNotNull())
        .groupBy("__e", "__shard").agg(F.count(F.lit(1)).alias("__n")),
        "shards",
    )
    # fewer than BROADCAST_ROWS shards can have more than the BROADCAST_ROWS-th part of all events
    least = max(hot_rows, (sizes.agg(F.sum("__n")).first()[0] or 0) // BROADCAST_ROWS + 1)
    hot = sizes.filter(F.col("__n") > least).select("__e", "__shard", F.ceil(F.col("__n") / hot_rows).cast("int").alias("__salts"))
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot)
        own = [F.col(f"__ev.`{c}`") for c in events.columns]
        if not drop_copies:  # copies are parted by a number, written so that a task run again sees the same
            e = written(e.withColumn("__copy", F.monotonically_increasing_id()), "events")
            own.append(F.col("__copy"))
        salt = F.pmod(F.xxhash64(*own), F.coalesce("__salts", F.lit(1)))
        e = e.join(hot, ["__e", "__shard"], "left").withColumn("__salt", salt.cast("int")).drop("__salts")
    else:
        e = e.withColumn("__salt", F.lit(0))

    # carry-in: the running best at the end of each shard of the entity, moved to its next shard with events
    ends = v.groupBy("__e", "__shard").agg(F.max("__v").alias("__v")).select("__e", "__shard", "__v", F.lit(None).cast("bigint").alias("__n"))
    marks = ends.unionByName(sizes.select("__e", "__shard", F.lit(None).cast(ends.schema["__v"].dataType).alias("__v"), "__n"))
    per_shard = marks.groupBy("__e", "__shard").agg(F.max("__v").alias("__v"), F.max("__n").alias("__n"))
    before = W.partitionBy("__e").orderBy("__shard").rowsBetween(W.unboundedPreceding, -1)  # one row per span of an entity
    carry = per_shard.withColumn("__v", F.max("__v").over(before)).filter(F.col("__n").isNotNull() & F.col("__v").isNotNull())
    first_day = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("__shard") * span_days).cast("int"))
    pieces = v.select("__e", "__shard", "__day", "__v").unionByName(carry.select("__e", "__shard", first_day.alias("__day"), "__v"))
    if n_hot:
        pieces = pieces.join(hot, ["__e", "__shard"], "left").withColumn(
            "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
        ).drop("__salts")
    else:
        pieces = pieces.withColumn("__salt", F.lit(0))

    nothing = F.lit(None).cast(e.schema["__ev"].dataType)
    both = e.select("__e", "__shard", "__salt", "__day", "__ev", F.lit(None).cast(v.schema["__v"].dataType).alias("__v"), F.lit(True).alias("__is")).unionByName(
        pieces.select("__e", "__shard", "__salt", "__day", nothing.alias("__ev"), "__v", F.lit(False).alias("__is"))
    )
    run = W.partitionBy("__e", "__shard", "__salt").orderBy("__day", "__is").rowsBetween(W.unboundedPreceding, 0)
    merged = both.withColumn("__best", F.max("__v").over(run)).filter("__is")
    best = F.when(F.col("__best").isNotNull() & F.col("__e").isNotNull(), F.struct(*[F.col(f"__best.`{c}`").alias(c) for c in take]))
    return merged.select("__ev.*", best.alias("known"))
