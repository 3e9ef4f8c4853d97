"""Per-key results when a handful of keys own most rows.

Value-frequency compression: rows are first grouped by (key, value), which combines on the map side
and spreads a heavy key over as many tasks as it has values; only the weighted values are then
grouped by key. Counts, totals, exact distinct counts and modes come out of the second aggregation.
Exact percentiles need the values of a key in order: the weighted values are range-partitioned by
(key, value), each block's weight is summed, and a value's rank is its block's carry-in plus the
running weight within the block, so no task ever holds one key's values as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quarterloom.session import written


def compress(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, freq): every distinct value of every key with its number of rows."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("freq"))


def key_profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key: n_rows, n_values (rows with a value), n_distinct, total, mode, mode_freq.

    NULL keys form a key of their own. NULL (and for doubles NaN) values count in n_rows only; a key
    without values has n_distinct 0 and NULL total and mode. Equally frequent modes: the smallest.
    total is NULL for values that are no numbers. An empty table gives no rows. Other columns, of
    whatever name, are ignored.
    """
    kind = df.schema[value].dataType
    v = F.col(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        v = F.when(~F.isnan(v), v)
    freq = compress(df.select(*keys, v.alias("__v")), keys, "__v")
    numeric = isinstance(kind, T.NumericType)
    total = F.sum(F.col("__v") * F.col("freq")) if numeric else F.lit(None).cast("double")
    # mode: the least pair (minus frequency, value)
    best = freq.groupBy(*keys).agg(
        F.sum("freq").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("freq"))), F.lit(0)).alias("n_values"),
        F.count("__v").alias("n_distinct"),
        total.alias("total"),
        F.min(F.when(F.col("__v").isNotNull(), F.struct((-F.col("freq")).alias("f"), F.col("__v").alias("v")))).alias("m"),
    )
    return best.select(*keys, "n_rows", "n_values", "n_distinct", "total", F.col("m.v").alias("mode"), (-F.col("m.f")).alias("mode_freq"))


def running_sums(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], descending: bool = False) -> DataFrame:
    """``df``, which has each (keys, order) once, with v_upto and v_all of every value v: its sum over the key's rows up
    to this one in ``order``, and over all.

    The rows are range-partitioned by (keys, order); a block's sums are carried into the blocks behind it, so that no task
    orders one key's rows as a whole, even if there is only one key or, with no ``keys``, none.
    """
    rows = written(df.repartitionByRange(*keys, order).withColumn("__block", F.spark_partition_id()), "blocks")  # fixes the block of every row
    blocks = rows.groupBy(*keys, "__block").agg(F.min(order).alias("__lo"), *[F.sum(v).alias(v) for v in values])
    # one row per key and block: at most the number of range partitions for any key
    w = W.partitionBy(*keys).orderBy(F.desc("__lo") if descending else F.asc("__lo"))
    blocks = blocks.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"),
        *[(F.sum(v).over(w) - F.col(v)).alias(f"__before_{v}") for v in values], *[F.sum(v).over(W.partitionBy(*keys)).alias(f"{v}_all") for v in values],
    )
    on = F.col("__block") == F.col("__b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    own = W.partitionBy(*keys, "__block").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(W.unboundedPreceding, 0)
    upto = {f"{v}_upto": F.col(f"__before_{v}") + F.sum(v).over(own) for v in values}
    return rows.join(blocks, on).withColumns(upto).select(*df.columns, *upto, *[f"{v}_all" for v in values])


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row, ``median``: the mean of the two middle values of all rows; NULL and NaN are left out, and an empty table gives NULL."""
    v = F.col(value).cast("double")
    freq = compress(df.select(F.when(~F.isnan(v), v).alias("__v")).filter(F.col("__v").isNotNull()), [], "__v")
    n, upto = F.col("freq_all"), F.col("freq_upto")
    middle = [F.min(F.when(upto >= at, F.col("__v"))) for at in (F.floor((n + 1) / 2), F.floor(n / 2) + 1)]
    return running_sums(freq, [], "__v", ["freq"]).agg(((middle[0] + middle[1]) / 2).alias("median"))


def key_percentiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """Exact discrete percentiles per key: the smallest value whose share of the key's rows reaches p.

    Columns: keys and ``percentiles``, an array in the order of ``at``. NULL and NaN values are left
    out; keys without values give no row, nor does an empty table. Keys may be NULL.
    """
    kind = df.schema[value].dataType
    v = F.col(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        v = F.when(~F.isnan(v), v)
    rows = df.select(*keys, v.alias("__v")).filter(F.col("__v").isNotNull())
    ranked = running_sums(compress(rows, keys, "__v"), keys, "__v", ["freq"])
    picks = []
    for p in at:
        rank = F.greatest(F.ceil(F.round(F.col("freq_all") * F.lit(float(p)), 9)), F.lit(1))
        picks.append(F.min(F.when(F.col("freq_upto") >= rank, F.col("__v"))))
    return ranked.groupBy(*keys).agg(F.array(*picks).alias("percentiles"))


def heavy_keys(df: DataFrame, scope: str, key: str, value: str, share: float) -> DataFrame:
    """(scope, key, n_rows, share): keys that own at least ``share`` of all rows of their scope.

    Rows with a NULL key count in the scope's total but are no key. An empty table gives no rows.
    """
    freq = compress(df.select(scope, key, value), [scope, key], value)
    rows = written(freq.groupBy(scope, key).agg(F.sum("freq").alias("n_rows")), "keys")  # one row per key, read twice
    totals = rows.groupBy(F.col(scope).alias("__scope")).agg(F.sum("n_rows").alias("__all"))
    return (
        rows.join(totals, F.col(scope).eqNullSafe(F.col("__scope")))
        .filter(F.col(key).isNotNull() & (F.col("n_rows") >= F.col("__all") * F.lit(share)))
        .select(scope, key, "n_rows", (F.col("n_rows") / F.col("__all")).alias("share"))
    )
