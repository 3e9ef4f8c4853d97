"""Ranking and classification metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarterloom.operators.skew import running_sums


def _levels(rows: DataFrame, *by: str) -> DataFrame:
    """Positives and negatives per distinct score: all further metrics only need these."""
    return rows.groupBy(*by, "score").agg(F.sum(F.col("label")).alias("pos"), F.sum(1 - F.col("label")).alias("neg"))


def auc(rows: DataFrame, *by: str) -> DataFrame:
    """Area under the ROC curve; equal scores count half. NULL without both classes."""
    lv = running_sums(_levels(rows, *by), by, "score", ["neg"])
    lv = lv.withColumn("won", F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return lv.groupBy(*by).agg(F.try_divide(F.sum("won"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def _curve(rows: DataFrame, *by: str) -> DataFrame:
    """Precision and recall at every distinct threshold."""
    lv = running_sums(_levels(rows, *by), by, "score", ["pos", "neg"], descending=True)
    c = lv.select(*by, "score", "pos", F.col("pos_upto").alias("tp"), (F.col("pos_upto") + F.col("neg_upto")).alias("n"), F.col("pos_all").alias("all"))
    return c.withColumns({"precision": F.col("tp") / F.col("n"), "recall": F.try_divide(F.col("tp"), F.col("all"))})


def average_precision(rows: DataFrame, *by: str) -> DataFrame:
    c = _curve(rows, *by)
    return c.groupBy(*by).agg(F.sum(F.try_divide(F.col("pos"), F.col("all")) * F.col("precision")).alias("ap"))


def best_f1(rows: DataFrame, *by: str) -> DataFrame:
    """The greatest F1 over all thresholds and the lowest threshold that reaches it."""
    c = _curve(rows, *by).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    best = c.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("score")).alias("s"), "precision", "recall")).alias("b"))
    return best.select(*by, F.col("b.f1").alias("f1"), (-F.col("b.s")).alias("threshold"), F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"))


def at_threshold(rows: DataFrame, threshold: float, *by: str) -> DataFrame:
    hit = F.col("score") >= threshold
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    tp, fp, fn = n(hit & (F.col("label") == 1)), n(hit & (F.col("label") == 0)), n(~hit & (F.col("label") == 1))
    return rows.groupBy(*by).agg(F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def hit_ndcg(rows: DataFrame, group: str, item: str, ks: Sequence[int], *by: Column) -> DataFrame:
    """Hit and NDCG at each k, averaged over the groups with a positive; ties by item.
    ``by``: expressions of the group to average by.

    Items of a group are first cut to the best max(k) within salted parts, so a heavy group's order is
    never made over all of its rows at once.
    """
    top = max(ks)
    n = rows.groupBy(group).agg(F.sum("label").alias("npos")).filter("npos > 0")
    order = [F.desc("score"), F.col(item)]
    few = rows.withColumn("__r", F.row_number().over(W.partitionBy(group, F.pmod(F.xxhash64(item), F.lit(32))).orderBy(*order))).filter(F.col("__r") <= top)
    r = few.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("__r") <= top)
    gain = F.when(F.col("label") == 1, 1 / F.log2(F.col("__r") + 1)).otherwise(0.0)
    per = r.groupBy(group).agg(*[x for k in ks for x in (F.max(F.when((F.col("__r") <= k) & (F.col("label") == 1), 1.0).otherwise(0.0)).alias(f"hit_{k}"), F.sum(F.when(F.col("__r") <= k, gain).otherwise(0.0)).alias(f"dcg_{k}"))])
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("npos").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    j = per.join(n, group)
    return j.groupBy(*by).agg(*[x for k in ks for x in (F.avg(f"hit_{k}").alias(f"hit_{k}"), F.avg(F.col(f"dcg_{k}") / ideal(k)).alias(f"ndcg_{k}"))], F.count(F.lit(1)).alias("groups"))


def average_rank(rows: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    """Adds the ascending rank, equal values sharing their mean, from counts per distinct value."""
    c = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    w = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    c = c.withColumn(name, F.sum("__c").over(w) - F.col("__c") + (F.col("__c") + 1) / 2).drop("__c")
    return rows.join(c, [*by, value])


def pearson(x: Column, y: Column) -> Column:
    """From sums, so that it needs no correlation aggregate of the engine."""
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    num = F.sum(x * y) - sx * sy / n
    return F.try_divide(num, F.sqrt((F.sum(x * x) - sx * sx / n) * (F.sum(y * y) - sy * sy / n)))


def spearman(rows: DataFrame, x: str, y: str, *by: str, least: int = 5) -> DataFrame:
    r = average_rank(average_rank(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "__rx", *by), y, "__ry", *by)
    got = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("__rx"), F.col("__ry")).alias("spearman"))
    return got.withColumn("spearman", F.when(F.col("n") >= least, F.col("spearman")))


def kendall(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Kendall's tau-b per group without forming pairs.

    Two cells whose y ranks differ share all bits above the highest differing one, so they are compared
    once: at that bit, in the group of cells with the same higher bits. There a running sum in the order
    of x counts, for every cell, the weights of smaller x with the other bit. n cells become n log n rows.
    """
    c = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    ys = c.select(*by, "y").distinct().withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("y")) - 1)
    cells = c.join(ys, [*by, "y"])
    top = ys.groupBy(*by).agg(F.max("r").alias("top"))
    bits = cells.join(top, list(by)).filter("top > 0").withColumn("bit", F.explode(F.sequence(F.lit(0), F.length(F.bin("top")) - 1)))
    one = F.expr("shiftright(r, bit)").bitwiseAND(F.lit(1))
    bits = bits.select(*by, "x", "bit", F.expr("shiftright(r, bit + 1)").alias("high"), F.when(one == 1, F.col("c")).otherwise(0).alias("ones"), F.when(one == 0, F.col("c")).otherwise(0).alias("zeros"))
    at = bits.groupBy(*by, "bit", "high", "x").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    w = W.partitionBy(*by, "bit", "high").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    before = lambda v: F.coalesce(F.sum(v).over(w), F.lit(0))
    won = at.select(*by, (F.col("ones") * before("zeros") - F.col("zeros") * before("ones")).cast("double").alias("s"))
    s = won.groupBy(*by).agg(F.sum("s").alias("s"))
    tie = lambda v, n: c.groupBy(*by, v).agg(F.sum("c").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(n))
    j = c.groupBy(*by).agg(F.sum("c").alias("n")).join(tie("x", "tx"), list(by)).join(tie("y", "ty"), list(by)).join(s, list(by), "left")
    n0 = F.col("n") * (F.col("n") - 1) / 2
    return j.select(*by, "n", F.try_divide(F.coalesce("s", F.lit(0.0)), F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty")))).alias("tau"))


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n) of the cells that occur."""
    return rows.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))


def macro_f1(rows: DataFrame, truth: str, guess: str, classes: Sequence[int]) -> DataFrame:
    """Accuracy and the mean F1 of the classes, in one pass."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t, g = F.col(truth), F.col(guess)
    f = [F.coalesce(F.try_divide(2 * n((t == k) & (g == k)), n(t == k) + n(g == k)), F.lit(0.0)) for k in classes]
    return rows.agg((n(t == g) / F.count(F.lit(1))).alias("accuracy"), (sum(f[1:], f[0]) / len(classes)).alias("macro_f1"))


def paired_t(rows: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(b) - F.col(a)
    return rows.agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d))).alias("t"))


def softmax(rows: DataFrame, score: str, *by: str) -> DataFrame:
    """Adds ``probability``: exp(score) over the sum in its group, from the group's maximum so that nothing overflows."""
    top = rows.groupBy(*by).agg(F.max(score).alias("__top"))
    x = rows.join(top, list(by)).withColumn("__x", F.exp(F.col(score) - F.col("__top")))
    total = x.groupBy(*by).agg(F.sum("__x").alias("__sum"))
    return x.join(total, list(by)).withColumn("probability", F.col("__x") / F.col("__sum")).drop("__top", "__x", "__sum")
