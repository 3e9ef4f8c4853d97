"""Windows, test sets and scores of link prediction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarterloom.session import written


def windows(quarters: DataFrame, k: int, offset: int = 1) -> DataFrame:
    """(window, p, role): k train quarters and the test quarter of every sliding window."""
    q = quarters.select("p").distinct().withColumn("i", F.row_number().over(W.orderBy("p")) - 1)  # one row per quarter
    n = q.agg(F.max("i").alias("n")).scalar()
    test = q.withColumn("window", F.col("i") - (k + offset - 1)).select("window", "p", F.lit("test").alias("role"))
    train = q.withColumn("window", F.explode(F.sequence(F.col("i") - (k - 1), F.col("i")))).select("window", "p", F.lit("train").alias("role"))
    return test.unionByName(train).filter((F.col("window") >= 0) & (F.col("window") <= n - (k + offset - 1)))


def shared(e: DataFrame, other: DataFrame) -> DataFrame:
    """Edges whose two ends both occur in the other graph."""
    return e.join(other.select("cik").distinct(), "cik", "left_semi").join(other.select("cusip").distinct(), "cusip", "left_semi")


def new_edges(test: DataFrame, train: DataFrame) -> DataFrame:
    return test.join(train, ["cik", "cusip"], "left_anti")


def hash_order(seed: int, *numbers: Column) -> Column:
    """An arithmetic order any engine can compute."""
    h = F.lit(seed)
    for i, x in enumerate(numbers):
        h = h + x * F.lit((31, 17, 101)[i])
    return F.pmod(h * F.lit(7919), F.lit(1_000_003))


def negatives(nodes_a: DataFrame, nodes_b: DataFrame, known: DataFrame, per_node: int, seed: int, per: str | None = None) -> DataFrame:
    """Candidate non-edges: every a-node proposes ``per_node`` partners by hashed position in the numbered
    b-side (ids 0 to n-1), so no cross product is formed; known edges are taken out.

    nodes_a: (cik, a), nodes_b: (cusip, b) with dense ids; with ``per`` both have that column, their ids
    are dense in it, and nodes_b has the number n of its ids.
    """
    if per:
        tries = nodes_a.join(nodes_b.groupBy(per).agg(F.max("n").alias("n")), per).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))))
        tries = tries.withColumn("b", F.pmod(hash_order(seed, F.col("a"), F.col("t")), F.col("n"))).drop("n")
        return tries.join(nodes_b.drop("n"), [per, "b"]).select("cik", "cusip").distinct().join(known, ["cik", "cusip"], "left_anti")
    n = nodes_b.agg(F.count(F.lit(1)).alias("n")).scalar()
    tries = nodes_a.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))))
    pick = F.pmod(hash_order(seed, F.col("a"), F.col("t")), n)
    return tries.withColumn("b", pick).join(nodes_b, "b").select("cik", "cusip").distinct().join(known, ["cik", "cusip"], "left_anti")


def balanced_negatives(positives: DataFrame, nodes_b: DataFrame, known: DataFrame, seed: int, per: str, tries: int = 8) -> DataFrame:
    """(cik, cusip): about one non-edge for every positive pair, of the same filer, so that a test set is balanced per filer.

    Every positive proposes ``tries`` partners by hashed positions in the numbered b-side (cusip, ``per``, b, n) and takes the first
    that is no known edge. A filer that holds nearly everything may find fewer; no cross product is formed. Equal proposals of
    a filer are one.
    """
    own = nodes_b.select("cusip", per, F.col("b").alias("own"), "n")
    p = positives.select("cik", "cusip").join(own, "cusip").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    number = F.pmod(F.xxhash64("cik"), F.lit(1_000_003))
    p = p.withColumn("b", F.pmod(hash_order(seed, number, F.col("own"), F.col("t")), F.col("n"))).select("cik", F.col("cusip").alias("for"), per, "b", "t")
    open_ = p.join(nodes_b.select("cusip", per, "b"), [per, "b"]).join(known, ["cik", "cusip"], "left_anti")
    return open_.groupBy("cik", "for").agg(F.min_by("cusip", "t").alias("cusip")).select("cik", "cusip").distinct()


def unseen_by_degree(e: DataFrame, group: str, item: str, k: int, per: Callable[[str], Column]) -> DataFrame:
    """(group, item, score, rank): for every node of ``group`` its ``k`` best items among all that it has no edge with, by
    preferential attachment, ties by item; ``per`` gives, of a column of names, the graph they belong to.

    Items are ranked by degree once a graph. A node with d edges finds its k best within the first d + k of them, so not all
    pairs are looked at but as many as there are edges, and k for every node.
    """
    items = e.groupBy(item).agg(F.count(F.lit(1)).alias("__i")).withColumn("__per", per(item))
    order = W.partitionBy("__per").orderBy(F.desc("__i"), item)  # one row per item of a graph
    items = written(items.withColumn("__at", F.row_number().over(order)), "ranked-items")
    nodes = e.groupBy(group).agg(F.count(F.lit(1)).alias("__d")).withColumn("__per", per(group))
    tries = nodes.withColumn("__at", F.explode(F.sequence(F.lit(1), (F.col("__d") + k).cast("int"))))
    fresh = tries.join(items, ["__per", "__at"]).join(e, [group, item], "left_anti")
    rank = F.row_number().over(W.partitionBy(group).orderBy("__at")).cast("bigint")  # up to d + k rows of a node
    got = fresh.withColumn("rank", rank).filter(F.col("rank") <= k)
    return got.select(group, item, (F.col("__d") * F.col("__i")).cast("double").alias("score"), "rank")


def split(rows: DataFrame, order: Column, train: float = 0.8, val: float = 0.1, per: Column | None = None) -> DataFrame:
    """Adds ``part`` by a deterministic order of the rows (floors; the remainder is test); with ``per``, an expression
    of the row, in each of its groups.

    The order is counted by value first, so positions come from a window over the distinct order values
    of coarse blocks, not over all rows.
    """
    block = F.floor(F.col("__o") / 1000)
    r = rows.withColumns({"__o": order, "__per": F.lit(0) if per is None else per}).withColumn("__bl", block)
    counts = r.groupBy("__per", "__bl").agg(F.count(F.lit(1)).alias("__c"))
    group = W.partitionBy("__per")  # at most a thousand blocks
    upto = counts.select("__per", "__bl", (F.sum("__c").over(group.orderBy("__bl")) - F.col("__c")).alias("__before"), F.sum("__c").over(group).alias("__n"))
    r = r.join(upto, ["__per", "__bl"])
    i = F.col("__before") + F.row_number().over(W.partitionBy("__per", "__bl").orderBy("__o", *rows.columns)) - 1
    cut1, cut2 = F.floor(F.col("__n") * train), F.floor(F.col("__n") * train) + F.floor(F.col("__n") * val)
    part = F.when(F.col("__i") < cut1, "train").when(F.col("__i") < cut2, "val").otherwise("test")
    return r.withColumn("__i", i).withColumn("part", part).select(*rows.columns, "part")


def top_k(scored: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The ``k`` best-scored items of every group with their ``rank``; ties by item. Salted parts of a group are cut down first."""
    order = [F.desc("score"), F.col(item)]
    few = scored.withColumn("__r", F.row_number().over(W.partitionBy(group, F.pmod(F.xxhash64(item), F.lit(32))).orderBy(*order))).filter(F.col("__r") <= k)
    return few.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("bigint")).filter(F.col("rank") <= k).drop("__r")


def repair_split(parts: DataFrame) -> DataFrame:
    """Validation and test edges with an end unseen in training move to training."""
    t = parts.filter("part = 'train'")
    a, b = t.select("cik").distinct().withColumn("__a", F.lit(1)), t.select("cusip").distinct().withColumn("__b", F.lit(1))
    got = parts.join(a, "cik", "left").join(b, "cusip", "left")
    return got.withColumn("part", F.when(F.col("__a").isNull() | F.col("__b").isNull(), "train").otherwise(F.col("part"))).drop("__a", "__b")


def _scaled(scored: DataFrame, per: Column | None = None) -> DataFrame:
    """By the maximum, or by that of each group ``per``, an expression of the pair. The scores are written once, as
    they are read for the maximum and for the result."""
    scored = written(scored, "scores").withColumn("__per", F.lit(0) if per is None else per)
    scored = scored.join(scored.groupBy("__per").agg(F.max("raw").alias("__top")), "__per")
    return scored.withColumn("score", F.when(F.col("__top") > 0, F.col("raw") / F.col("__top")).otherwise(F.col("raw"))).drop("__per", "__top")


def _co_holders(pairs: DataFrame, e: DataFrame) -> DataFrame:
    """(cik, cusip, other, a, b): other holders of the pair's security; a and b are the two filers in order."""
    got = pairs.select("cik", "cusip").join(e.select(F.col("cik").alias("other"), "cusip"), "cusip").filter("cik <> other")
    return got.withColumns({"a": F.least("cik", "other"), "b": F.greatest("cik", "other")})


def _common(pairs: DataFrame, e: DataFrame) -> DataFrame:
    """(a, b, common), a < b, of filers of which one at least occurs in the pairs: each two are counted once for both."""
    mine = pairs.select("cik").distinct().withColumn("m", F.lit(1))
    side = e.join(mine, "cik", "left").select("cusip", "cik", F.col("m").isNotNull().alias("m"))
    x, y = side.select("cusip", F.col("cik").alias("a"), F.col("m").alias("ma")), side.select("cusip", F.col("cik").alias("b"), F.col("m").alias("mb"))
    return x.join(y, "cusip").filter("a < b AND (ma OR mb)").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))


def adamic_adar(pairs: DataFrame, e: DataFrame, per: Column | None = None) -> DataFrame:
    """Sum over the other holders of the security of common holdings / ln(degree), scaled by the maximum.

    Common holdings are counted only for filers that occur in the pairs.
    """
    deg = e.groupBy("cik").agg(F.count(F.lit(1)).alias("d"))
    w = deg.select(F.col("cik").alias("other"), F.when(F.col("d") > 1, 1 / F.ln("d")).otherwise(0.0).alias("w"))
    hit = _co_holders(pairs, e).join(w, "other").join(_common(pairs, e), ["a", "b"])
    s = hit.groupBy("cik", "cusip").agg(F.sum(F.col("common") * F.col("w")).alias("raw"))
    return _scaled(pairs.select("cik", "cusip").join(s, ["cik", "cusip"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0))), per)


def jaccard(pairs: DataFrame, e: DataFrame, per: Column | None = None) -> DataFrame:
    """Mean Jaccard similarity with all other holders of the security, scaled by the maximum."""
    deg = e.groupBy("cik").agg(F.count(F.lit(1)).alias("d"))
    j = _common(pairs, e).join(deg.select(F.col("cik").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("cik").alias("b"), F.col("d").alias("db")), "b")
    j = j.select("a", "b", (F.col("common") / (F.col("da") + F.col("db") - F.col("common"))).alias("j"))
    hit = _co_holders(pairs, e).join(j, ["a", "b"])  # they share this security
    s = hit.groupBy("cik", "cusip").agg(F.sum("j").alias("j"))
    n = e.groupBy("cusip").agg(F.count(F.lit(1)).alias("n"))
    own = e.withColumn("__own", F.lit(1))
    got = pairs.select("cik", "cusip").join(s, ["cik", "cusip"], "left").join(n, "cusip", "left").join(own, ["cik", "cusip"], "left")
    others = F.col("n") - F.coalesce("__own", F.lit(0))
    return _scaled(got.select("cik", "cusip", F.coalesce(F.try_divide("j", others.cast("double")), F.lit(0.0)).alias("raw")), per)


def preferential(pairs: DataFrame, e: DataFrame, per: Column | None = None) -> DataFrame:
    a = e.groupBy("cik").agg(F.count(F.lit(1)).alias("a"))
    b = e.groupBy("cusip").agg(F.count(F.lit(1)).alias("b"))
    s = pairs.select("cik", "cusip").join(a, "cik", "left").join(b, "cusip", "left")
    return _scaled(s.select("cik", "cusip", (F.coalesce("a", F.lit(0)) * F.coalesce("b", F.lit(0))).cast("double").alias("raw")), per)


def persistence(pairs: DataFrame, last: DataFrame) -> DataFrame:
    return pairs.select("cik", "cusip").join(last.select("cik", "cusip").distinct().withColumn("__y", F.lit(1.0)), ["cik", "cusip"], "left").select("cik", "cusip", F.coalesce("__y", F.lit(0.0)).alias("score"))


def popularity(rows: DataFrame) -> DataFrame:
    """Degrees of securities summed over quarters, as a share of the largest, and whether in the top tenth."""
    d = rows.select("p", "cik", "cusip").distinct().groupBy("cusip").agg(F.count(F.lit(1)).alias("n"))
    cut = d.agg(F.struct(F.percentile("n", F.lit(0.9)).alias("c"), F.max("n").alias("m")).alias("s")).scalar()
    return d.withColumn("s", cut).select("cusip", "n", (F.col("n") / F.col("s.m")).alias("prob"), (F.col("n") >= F.col("s.c")).alias("popular"))
