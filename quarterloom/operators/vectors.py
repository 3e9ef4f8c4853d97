"""Similarity of embedding vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarterloom.session import ship

#: Queries are compared with all rows in blocks of this many.
BLOCK = 256


def nearest(df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, item, cosine): the k rows most similar to each query, itself left out; ties by key.

    Each query block meets each partition of the rows once: a task keeps only its own k best per query,
    which are then ranked over all tasks. Query blocks reach the tasks by a join on the block number.
    """
    ship(df.sparkSession)
    q = queries.select(F.col(key).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    packed = q.withColumn("blk", F.floor(F.col("q") / BLOCK)).groupBy("blk").agg(F.sort_array(F.collect_list(F.struct("q", "v"))).alias("qs"))
    rows = df.select(F.col(key).cast("bigint").alias("i"), F.col(vector).cast("array<double>").alias("v")).withColumn("part", F.spark_partition_id())
    tiles = rows.withColumn("tile", F.floor(F.col("i") / (BLOCK * 16))).groupBy("part", "tile").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("rs"))
    # all tiles x all query blocks: the stated query set against all rows, in blocks
    work = tiles.join(packed, F.lit(True))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        for b in batches:
            for rs, qs in zip(b.column(0), b.column(1)):
                ri, rv = np.array(rs.values.field("i")), unit(np.array(rs.values.field("v").to_pylist()))
                qi, qv = np.array(qs.values.field("q")), unit(np.array(qs.values.field("v").to_pylist()))
                s = qv @ rv.T
                s[qi[:, None] == ri[None, :]] = -np.inf
                for row, one in zip(qi, s):
                    take = np.lexsort((ri, -one))[:k]
                    take = take[np.isfinite(one[take])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), row)), pa.array(ri[take]), pa.array(one[take])], ["query", "item", "cosine"])

    few = work.select("rs", "qs").mapInArrow(best, "query long, item long, cosine double")
    r = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "item"))
    return few.withColumn("__r", r).filter(F.col("__r") <= k).drop("__r")


def mean_score(left: DataFrame, right: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(item, score): mean over the left rows of the logistic of the dot product, for each right row.

    Both sides are packed into blocks of 256 vectors. Every left block is sent to every right block, each pair is one
    matrix product, and only sums per item leave the task: the arithmetic is that of all pairs by definition, the rows
    moved are those of the blocks.
    """
    ship(left.sparkSession)

    def packed(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v")).withColumn("b", F.floor(F.col("k") / BLOCK))
        return one.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias(name)).drop("b")

    work = packed(right, "rs").join(packed(left, "ls"), F.lit(True))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rs, ls in zip(batch.column(0), batch.column(1)):
                r, l = (np.array(x.values.field("v").to_pylist()) for x in (rs, ls))
                s = (1 / (1 + np.exp(-(r @ l.T)))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([rs.values.field("k").cast(pa.int64()), pa.array(s), pa.array(np.full(len(s), len(l)))], ["item", "s", "n"])

    got = work.select("rs", "ls").mapInArrow(score, "item long, s double, n long")
    return got.groupBy("item").agg((F.sum("s") / F.sum("n")).alias("score"))
