"""What changed between full snapshots.

Snapshots are kept range-partitioned by key and sorted by (key, period): all snapshots share the same
ranges, so consecutive snapshots of a key lie next to each other and a difference is a streaming
two-pointer merge within each range, which compares columns and emits typed changes. The merge runs
over Arrow batches: the cursor on the earlier snapshot is the row before the cursor on the later one,
or there is none. Between batches only the last key is carried over. A log of recorded changes may be
merged along, sorted by the same key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterloom.session import ship


def _differs(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """NULL-safe inequality; NaN equals NaN."""
    ne = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    nulls = np.asarray(a.is_null()) != np.asarray(b.is_null())
    if pa.types.is_floating(a.type):
        ne &= ~(np.asarray(pc.fill_null(pc.is_nan(a), False)) & np.asarray(pc.fill_null(pc.is_nan(b), False)))
    return ne | nulls


def _starts(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether a row begins a key."""
    new = np.ones(t.num_rows, bool)
    if t.num_rows > 1:
        new[1:] = False
        for k in keys:
            new[1:] |= _differs(t[k].slice(1), t[k].slice(0, t.num_rows - 1))
    return new


def _merge(t: pa.Table, keys: Sequence[str], compare: Sequence[str], schema: pa.Schema) -> pa.Table:
    """The typed changes of complete keys; ``t`` is sorted by (keys, __p, __side)."""
    key_id = np.cumsum(_starts(t, keys))
    p = t["__p"].to_numpy().astype(np.int64)
    side = t["__side"].to_numpy()
    pos = np.flatnonzero(side == 0)
    rec = np.flatnonzero(side == 1)
    kid, pp = key_id[pos], p[pos]
    follows = np.zeros(len(pos), bool)  # the row before is the same key in the snapshot before
    if len(pos) > 1:
        follows[1:] = (kid[1:] == kid[:-1]) & (pp[1:] == pp[:-1] + 1)
    followed = np.append(follows[1:], False)
    at = t.take(pa.array(pos))
    cols = {c: at[c] for c in compare}
    diff = np.zeros((len(compare), len(pos)), bool)
    if len(pos) > 1:
        for i, c in enumerate(compare):
            diff[i, 1:] = _differs(cols[c].slice(1), cols[c].slice(0, len(pos) - 1))
    changed = np.flatnonzero(follows & diff.any(axis=0))
    added, removed = np.flatnonzero(~follows), np.flatnonzero(~followed)

    kinds = np.concatenate([np.zeros(len(changed), np.int8), np.ones(len(added), np.int8), np.full(len(removed), 2, np.int8)])
    new_row = np.concatenate([changed, added, removed])  # of the later snapshot; for removed rows only its key
    period = pp[new_row] + (kinds == 2)
    old_row = np.where(kinds == 0, new_row - 1, np.where(kinds == 2, new_row, -1))
    out = {k: at[k].take(pa.array(new_row)) for k in keys}
    out["__p"] = pa.array(period.astype(np.int32))
    out["diff_kind"] = pa.array(np.array(["changed", "added", "removed"], dtype=object)[kinds], pa.string())
    old_idx, new_idx = pa.array(old_row, mask=old_row < 0), pa.array(new_row, mask=kinds == 2)
    for c in compare:
        out[f"old_{c}"], out[f"new_{c}"] = cols[c].take(old_idx), cols[c].take(new_idx)
    flags = np.where((kinds == 0)[None, :], diff[:, new_row], False) if len(compare) else np.zeros((0, len(new_row)), bool)
    lengths = flags.sum(axis=0)
    names = np.array(list(compare), dtype=object)[np.nonzero(flags.T)[1]] if len(compare) else []
    out["changed_columns"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(names, pa.string()))
    if "recorded_as" in schema.names:
        out["recorded_as"] = pa.array(_recorded(t, rec, key_id, p, kid[new_row], period, out, compare[0]), pa.string())
    out["__need"] = pa.array(np.where(kinds == 1, period - 1, period).astype(np.int32))
    return pa.table([out[f.name].cast(f.type) if out[f.name].type != f.type else out[f.name] for f in schema], schema=schema)


def _recorded(t: pa.Table, rec: np.ndarray, key_id: np.ndarray, p: np.ndarray, kid: np.ndarray, period: np.ndarray, out: dict, column: str) -> np.ndarray:
    """'same', 'differs' or 'absent': the cursor on the log moves with the key and the period."""
    low = int(p.min()) - 2 if len(p) else 0
    code = key_id[rec] * 100_000 + (p[rec] - low)
    want = kid * 100_000 + (period - low)
    left, right = np.searchsorted(code, want, "left"), np.searchsorted(code, want, "right")
    number = lambda a: pc.fill_null(a, 0).to_numpy().astype(np.int64)
    delta = number(out[f"new_{column}"]) - number(out[f"old_{column}"])
    known = t["__r"].take(pa.array(rec))
    values, valid = number(known), ~np.asarray(known.is_null())
    same = np.zeros(len(want), bool)
    for j in range(int((right - left).max()) if len(want) else 0):
        i = np.minimum(left + j, max(len(rec) - 1, 0))
        same |= (left + j < right) & valid[i] & (values[i] == delta)
    return np.where(same, "same", np.where(right > left, "differs", "absent")).astype(object)


def snapshot_diff(
    snapshots: DataFrame,
    keys: Sequence[str],
    period: str,
    compare: Sequence[str],
    owner: Sequence[str] | None = None,
    listed: DataFrame | None = None,
    recorded: DataFrame | None = None,
    recorded_change: str | None = None,
) -> DataFrame:
    """Typed changes between the snapshots of consecutive periods (integers, step 1).

    Columns: keys, ``period`` (of the later snapshot), diff_kind ('added', 'removed', 'changed'),
    old_*, new_* and ``changed_columns``. With ``owner`` (some of the keys) each owner delivers its
    own snapshots, listed in ``listed`` (owner, period; default: the periods of its rows); a
    difference needs both. Without ``owner`` the periods are common to all. With ``recorded`` (keys,
    ``period``, ``recorded_change``) also ``recorded_as``: whether a recorded change of the first
    compared column, a whole number, is the 'same', 'differs' (or is NULL) or is 'absent'.

    Keys must be unique within a snapshot (aggregate first); exact copies are dropped here. Rows with
    a NULL period are left out; NULL keys equal each other; NULLs and NaN compare as values. An
    empty table gives no rows; other columns are ignored.
    """
    ship(snapshots.sparkSession)
    base = snapshots.filter(F.col(period).isNotNull()).select(*keys, F.col(period).cast("int").alias("__p"), *compare)
    owner = list(owner or [])
    if listed is None:
        listed = base.select(*owner, "__p").distinct()
    else:
        listed = listed.select(*owner, F.col(period).cast("int").alias("__p")).distinct()
    rows = base.dropDuplicates().withColumn("__side", F.lit(0).cast("tinyint"))
    sort = [*keys, "__p", "__side"]
    fields = [base.schema[k] for k in keys] + [T.StructField("__p", T.IntegerType())] + [T.StructField("diff_kind", T.StringType())]
    fields += [T.StructField(f"{w}_{c}", base.schema[c].dataType) for c in compare for w in ("old", "new")]
    fields += [T.StructField("changed_columns", T.ArrayType(T.StringType()))]
    if recorded is not None:
        log = recorded.filter(F.col(period).isNotNull()).select(*keys, F.col(period).cast("int").alias("__p"), F.col(recorded_change).cast("bigint").alias("__r")).distinct()
        rows = rows.withColumn("__r", F.lit(None).cast("bigint")).unionByName(log.withColumn("__side", F.lit(1).cast("tinyint")), allowMissingColumns=True)
        fields += [T.StructField("recorded_as", T.StringType())]
    fields += [T.StructField("__need", T.IntegerType())]
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])

    keys, compare = list(keys), list(compare)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rest = to_arrow_schema(out), None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            if not t.num_rows:
                continue
            cut = int(np.flatnonzero(_starts(t, keys))[-1])  # the next batch may go on with the last key
            if cut:
                yield from _merge(t.slice(0, cut).combine_chunks(), keys, compare, schema).to_batches()
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from _merge(rest.combine_chunks(), keys, compare, schema).to_batches()

    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*sort)
    changes = ranged.mapInArrow(merge, out)
    # a difference counts only where the owner delivered the snapshot that lacks the key
    on = F.col("__need") == F.col("__lp")
    for o in owner:
        on = on & F.col(o).eqNullSafe(F.col(f"__l_{o}"))
    listed = listed.select(F.col("__p").alias("__lp"), *[F.col(o).alias(f"__l_{o}") for o in owner])
    return changes.join(listed, on, "left_semi").drop("__need").withColumnRenamed("__p", period)
