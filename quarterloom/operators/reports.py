"""Aggregates behind the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterloom.operators.metrics import pearson
from quarterloom.operators.skew import exact_median


def describe(rows: DataFrame, c: str, thresholds: Sequence[float] = ()) -> DataFrame:
    """Extremes, mean, median, sd, population skewness and excess kurtosis, shares at thresholds.

    The moments are centred on the mean, which a first pass finds.
    """
    mean = rows.agg(F.avg(c)).scalar()
    x = rows.filter(F.col(c).isNotNull()).withColumn("__d", F.col(c) - mean)
    m = lambda k: F.avg(F.pow("__d", F.lit(float(k))))
    middle = exact_median(rows, c).scalar()
    return x.withColumn("__m", middle).agg(
        F.count(F.lit(1)).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.first("__m").alias("median"), F.stddev_samp(c).alias("std"),
        (m(3) / F.pow(m(2), F.lit(1.5))).alias("skew"), (m(4) / F.pow(m(2), F.lit(2.0)) - 3).alias("kurtosis"),
        *[F.avg((F.col(c) >= t).cast("int")).alias(f"share_{str(t).replace('.', '_')}") for t in thresholds],
    )


def buckets(c: Column, edges: Sequence[float]) -> Column:
    """Right-closed classes; values outside (and the lowest edge itself) are NULL."""
    out = None
    for lo, hi in zip(edges, edges[1:]):
        here = (c > lo) & (c <= hi)
        label = F.lit(f"({lo}, {hi}]")
        out = F.when(here, label) if out is None else out.when(here, label)
    return out


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) of all pairs of columns, over rows without missing values, in one pass."""
    full = rows.na.drop(subset=list(columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = full.agg(*[pearson(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("s")).select("s.*")


def top_entities(rows: DataFrame, key: str, score: str, n: int = 15) -> DataFrame:
    """A top-n report: the keys with the most rows, their mean score and share of high scores."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("avg_score"), F.avg((F.col(score) >= 0.9).cast("int")).alias("share_high"))
    return g.orderBy(F.desc("n"), key).limit(n)
