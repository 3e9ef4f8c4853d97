"""History of changing entity attributes as insert-only satellites.

Attributes are split by their rate of change into satellites, tables that only grow. A load of one or
more full snapshots appends to a satellite the rows whose hash of its attributes differs from the
entity's row before, which for the first of the new snapshots is the last row stored; nothing is ever
updated. A further table notes since when an entity is listed and since when it is not. The period in
which a row held is no stored column but computed by a view from the entity's next row (``lead``). A full
history is the merge of the satellites' change points.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quarterloom.session import delete_on_exit, discard, shared_dir, written


def hash_diff(attributes: Sequence[str]) -> Column:
    """128 bits over the attributes, each with its length in front, so that no two different rows read alike."""
    texts = [F.col(a).cast("string") for a in attributes]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def snapshot_rows(snapshots: DataFrame, entity: str, at: str, attributes: Sequence[str]) -> DataFrame:
    """One row per (entity, at): the fields' greatest non-NULL values.

    Repeated rows of a snapshot collapse with map-side combining, however many there are. Rows
    without entity or ``at`` are left out.
    """
    base = snapshots.filter(F.col(entity).isNotNull() & F.col(at).isNotNull())
    return base.groupBy(entity, at).agg(*[F.max(a).alias(a) for a in attributes])


class HistoryStore:
    """The satellites of one kind of entity in a folder.

    ``satellites`` maps a name to its attributes; ``carried`` attributes keep the entity's latest earlier
    value where a snapshot has none. ``at`` is an integer time axis of step 1; a snapshot is a full listing.
    """

    def __init__(self, spark: SparkSession, path: str, entity: str, at: str, satellites: Mapping[str, Sequence[str]], carried: Sequence[str] = ()) -> None:
        self.spark, self.path, self.entity, self.at = spark, path, entity, at
        self.satellites, self.carried = {n: list(a) for n, a in satellites.items()}, list(carried)
        self.attributes = [a for s in self.satellites.values() for a in s]
        self.schema: T.StructType | None = None
        self.last: int | None = None

    def table(self, name: str) -> DataFrame:
        """``name`` of a satellite: (entity, at, hash_diff, attributes), or 'presence': (entity, at, here)."""
        return self.spark.read.parquet(os.path.join(self.path, name))

    def _state(self) -> DataFrame:
        """Per entity its stored attributes and hashes, as a row of the last load if it was listed then and of an earlier time if not."""
        p = self.table("presence").groupBy(self.entity).agg(F.max_by("here", self.at).alias("__here"))
        rows = p.select(self.entity, F.when(F.col("__here"), self.last).otherwise(self.last - 1).cast(self.schema[self.at].dataType).alias(self.at), F.col("__here"))
        for name, own in self.satellites.items():
            s = self.table(name).groupBy(self.entity).agg(F.max_by(F.struct("hash_diff", *own), self.at).alias("__s"))
            rows = rows.join(s.select(self.entity, F.col("__s.hash_diff").alias(f"__h_{name}"), *[F.col(f"__s.{a}").alias(a) for a in own]), self.entity)
        return rows.withColumn("__old", F.lit(True))

    def load(self, snapshots: DataFrame) -> None:
        """Appends what the snapshots change. They must be later than those loaded before."""
        e, at = self.entity, self.at
        rows = written(snapshot_rows(snapshots, e, at, self.attributes), "listing")
        first, last = rows.agg(F.min(at), F.max(at)).first()
        if self.schema is None:
            self.schema = rows.schema
        if first is None:
            return
        if self.last is not None and first <= self.last:
            raise ValueError(f"snapshots up to {self.last} are loaded already")
        w = W.partitionBy(e).orderBy(at)  # one row per snapshot of an entity
        new = rows.withColumns({"__here": F.lit(True), "__old": F.lit(False)})
        if self.last is not None:
            new = new.unionByName(self._state(), allowMissingColumns=True)
        so_far = w.rowsBetween(W.unboundedPreceding, 0)
        new = new.withColumns({a: F.last(a, ignorenulls=True).over(so_far) for a in self.carried})
        hashes = {f"__h_{n}": hash_diff(own) for n, own in self.satellites.items()}
        new = new.withColumns({h: F.when(F.col("__old"), F.col(h)).otherwise(x) if h in new.columns else x for h, x in hashes.items()})
        came = F.coalesce(F.lag(at).over(w) != F.col(at) - 1, F.lit(True)) | ~F.coalesce(F.lag("__here").over(w), F.lit(False))
        left = F.col("__here") & (F.coalesce(F.lead(at).over(w), F.lit(last + 2)) != F.col(at) + 1) & (F.col(at) < last)
        new = new.withColumns({"__came": came, "__left": left, **{f"__n_{n}": came | (F.col(f"__h_{n}") != F.lag(f"__h_{n}").over(w)) for n in self.satellites}})
        # what is appended; rows of the state only say who left
        changes = written(new.filter("__left OR NOT __old AND (" + " OR ".join(["__came", *[f"__n_{n}" for n in self.satellites]]) + ")"), "changes")
        fresh = changes.filter(~F.col("__old"))
        for name, own in self.satellites.items():
            fresh.filter(f"__n_{name}").select(e, at, F.col(f"__h_{name}").alias("hash_diff"), *own).write.mode("append").parquet(os.path.join(self.path, name))
        gone = changes.filter("__left").select(e, (F.col(at) + 1).cast(self.schema[at].dataType).alias(at), F.lit(False).alias("here"))
        fresh.filter("__came").select(e, at, F.lit(True).alias("here")).unionByName(gone).write.mode("append").parquet(os.path.join(self.path, "presence"))
        self.last = last
        discard(rows)
        discard(changes)

    def versions(self) -> DataFrame:
        """The lead-based view: (entity, from_at, to_at, attributes), one row per version, inclusive ends.

        A version starts where any satellite has a row and ends before the entity's next row, where the entity is
        gone, or with the last snapshot loaded.
        """
        e, at = self.entity, self.at
        kind = {a: self.schema[a].dataType.simpleString() for a in self.attributes}
        if self.last is None:
            return self.spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in [(e, self.schema[e].dataType.simpleString()), *[(c, self.schema[at].dataType.simpleString()) for c in ("from_at", "to_at")], *kind.items()]))
        points = self.table("presence").filter("NOT here").select(e, at, F.lit(True).alias("__end"))
        for name, own in self.satellites.items():
            s = self.table(name).select(e, at, F.lit(False).alias("__end"), *[F.struct(F.col(a)).alias(f"__{a}") for a in own])
            points = points.unionByName(s, allowMissingColumns=True)
        # one change point per (entity, at): a row outweighs an end at the same point
        points = points.groupBy(e, at).agg(F.min("__end").alias("__end"), *[F.max(f"__{a}").alias(f"__{a}") for a in self.attributes])
        w = W.partitionBy(e).orderBy(at)
        so_far = w.rowsBetween(W.unboundedPreceding, 0)
        until = F.coalesce(F.lead(at).over(w) - 1, F.lit(self.last)).cast(self.schema[at].dataType)
        filled = points.select(e, F.col(at).alias("from_at"), until.alias("to_at"), "__end", *[F.last(f"__{a}", ignorenulls=True).over(so_far)[a].alias(a) for a in self.attributes])
        return filled.filter(~F.col("__end")).drop("__end")


def new_store(spark: SparkSession, entity: str, at: str, satellites: Mapping[str, Sequence[str]], carried: Sequence[str] = ()) -> HistoryStore:
    """A store in the shared folder that goes when the application ends."""
    path = os.path.join(shared_dir(spark), f"history-{uuid.uuid4().hex}")
    delete_on_exit(spark, path)
    return HistoryStore(spark, path, entity, at, satellites, carried)


def build_history(snapshots: DataFrame, entity: str, at: str, satellites: Mapping[str, Sequence[str]], carried: Sequence[str] = ()) -> DataFrame:
    """History of periodic full listings, loaded at once.

    NULL attributes are values of their own, except those in ``carried``, which keep the entity's
    latest earlier value. Rows without entity or ``at`` are left out; repeated rows count once; rows
    of one (entity, at) that differ give the greatest non-NULL value of each field. An empty table
    gives no rows; further columns are ignored.
    """
    store = new_store(snapshots.sparkSession, entity, at, satellites, carried)
    store.load(snapshots)
    return store.versions()
