"""Best representative of each duplicate group, field by field.

One aggregation per group takes, for every field, the maximum of a composite struct: usable before
unusable, then source priority, then time, then record id, then the value. Maxima combine on the map
side, so a group that owns a third of all rows reaches its reducer as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """How a field of the survivor is chosen.

    value: the field's value in a record. usable: whether the record's value may be taken (default:
    not NULL). priority: the greater, the more trusted the record's source is for this field.
    """

    name: str
    value: Column
    usable: Column | None = None
    priority: Column | None = None


def survivors(df: DataFrame, keys: Sequence[str], record_id: str, time: str, fields: Sequence[Field]) -> DataFrame:
    """One row per group: keys, first_id, survivor_id, several, and per field its value and name_from.

    several: whether the group has two or more distinct record ids; exact copies of a record are one.
    first_id is the smallest id, survivor_id the
    record with the latest ``time`` (NULL is earliest), then the greatest id. A field comes from the
    best record that is usable for it (by priority, time, id); if there is none, value and name_from
    are NULL. NULL keys group together; rows without record id take part with their values (an id that
    is NULL is the smallest) but are no records of their own: a group of only such rows has NULL ids. Empty and very long texts are values like others. An empty
    table gives no rows; columns that are not named are ignored.
    """
    rank = [F.col(time).isNotNull().alias("has_time"), F.col(time).alias("time"), F.col(record_id).alias("id")]
    aggs = [
        F.min(record_id).alias("first_id"),
        F.max(record_id).alias("__last_id"),
        F.max(F.struct(*rank)).alias("__s"),
    ]
    for i, f in enumerate(fields):
        ok = f.value.isNotNull() if f.usable is None else F.coalesce(f.usable, F.lit(False)) & f.value.isNotNull()
        priority = F.lit(0) if f.priority is None else f.priority
        aggs.append(F.max(F.when(ok, F.struct(priority.alias("priority"), *rank, f.value.alias("value")))).alias(f"__f{i}"))
    got = df.groupBy(*keys).agg(*aggs)
    out = [F.col("first_id"), F.col("__s.id").alias("survivor_id"), F.coalesce(F.col("first_id") < F.col("__last_id"), F.lit(False)).alias("several")]
    for i, f in enumerate(fields):
        out += [F.col(f"__f{i}.value").alias(f.name), F.col(f"__f{i}.id").alias(f"{f.name}_from")]
    return got.select(*keys, *out)
