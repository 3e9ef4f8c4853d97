"""Embeddings of filers and securities, trained by pairwise ranking on the bipartite graph.

A node's embedding is a row of ``dim`` double columns. An epoch smooths the embeddings over the graph (sums with
symmetric degree normalisation and self-loops, averaged over the layers), draws for every edge a security that the
filer does not hold, by a hash of the epoch, and takes one step down the gradient of the pairwise loss
-ln sigmoid(score of the edge - score of the other pair) with a quadratic penalty. The smoothing is a symmetric linear
map, so the gradient of the stored embeddings is the smoothed gradient of the smoothed ones. All of it is joins and
aggregations on edges; per epoch one number, the loss on held-out edges, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterloom.session import discard, written


def _columns(dim: int, name: str = "e") -> list[str]:
    return [f"{name}{i}" for i in range(dim)]


def _links(e: DataFrame) -> DataFrame:
    """(a, b, n): both directions and self-loops with the weights of the symmetric normalisation."""
    one = e.select(F.concat(F.lit("f:"), "cik").alias("a"), F.concat(F.lit("s:"), "cusip").alias("b"))
    both = one.union(one.select("b", "a"))
    both = both.union(both.select("a", F.col("a").alias("b")).distinct())
    d = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    both = both.join(d, "a").join(d.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    return written(both.select("a", "b", (1 / F.sqrt(F.col("d") * F.col("db"))).alias("n")), "links")


def _smooth(links: DataFrame, x: DataFrame, layers: int, dim: int) -> DataFrame:
    """(node, e...): the mean of ``x`` and its ``layers`` further neighbour sums."""
    total = layer = x
    for _ in range(layers):
        layer = links.join(layer, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in _columns(dim)])
        total = total.unionByName(layer)
    return total.groupBy("node").agg(*[(F.sum(c) / (layers + 1)).alias(c) for c in _columns(dim)]) if layers else x


def _pairs(z: DataFrame, pairs: DataFrame, dim: int) -> DataFrame:
    """Pairs (cik, cusip, other) with the embeddings of the three as u..., v..., w..."""
    side = lambda key, prefix, name: z.filter(F.col("node").startswith(prefix)).select(F.expr("substring(node, 3)").alias(key), *[F.col(c).alias(f"{name}{i}") for i, c in enumerate(_columns(dim))])
    return pairs.join(side("cik", "f:", "u"), "cik").join(side("cusip", "s:", "v"), "cusip").join(side("other", "s:", "w"), "other")


def _dot(a: str, b: str, dim: int) -> Column:
    return sum((F.col(f"{a}{i}") * F.col(f"{b}{i}") for i in range(1, dim)), F.col(f"{a}0") * F.col(f"{b}0"))


def _others(e: DataFrame, known: DataFrame, numbered: DataFrame, epoch: int, per: Callable[[str], Column]) -> DataFrame:
    """(cik, cusip, other): for every edge a security by a hashed number within its graph; known edges fall away."""
    n = numbered.groupBy("per").agg(F.max("n").alias("n"))
    t = e.select("cik", "cusip", per("cik").alias("per")).join(n, "per").withColumn("b", F.pmod(F.xxhash64("cik", "cusip", F.lit(epoch)), F.col("n")))
    t = t.join(numbered.select("per", "b", F.col("cusip").alias("other")), ["per", "b"]).select("cik", "cusip", "other")
    return t.join(known.select("cik", F.col("cusip").alias("other")), ["cik", "other"], "left_anti")


def train(e: DataFrame, numbered: DataFrame, per: Callable[[str], Column], dim: int = 8, layers: int = 1, epochs: int = 10, rate: float = 4.0, penalty: float = 1e-3, patience: int = 2, seed: int = 7) -> DataFrame:
    """(node, e0...): smoothed embeddings of all nodes, named 'f:…' and 's:…', of the edges (cik, cusip).

    ``numbered``: (cusip, per, b, n), the securities with dense ids in their graph. A tenth of the edges, by hash, is held out; when its
    loss has not fallen for ``patience`` epochs, training ends with the embeddings of the least loss. The steps of a node are
    averaged over its pairs.
    """
    e = written(e.select("cik", "cusip").distinct(), "edges")
    part = F.pmod(F.xxhash64("cik", "cusip", F.lit(seed)), F.lit(10))
    fit, held = written(e.filter(part > 0), "fit"), written(e.filter(part == 0), "held")
    numbered, links = written(numbered, "numbers"), _links(fit.unionByName(held))
    start = [((F.pmod(F.xxhash64("node", F.lit(seed + i)), F.lit(2_000_001)) - 1_000_000) / 1e7).alias(c) for i, c in enumerate(_columns(dim))]
    x = written(links.select(F.col("a").alias("node")).distinct().select("node", *start), "embeddings")
    check = written(_others(held, e, numbered, -1, per), "check")
    best, best_loss, since = None, None, 0
    for epoch in range(epochs):
        z = written(_smooth(links, x, layers, dim), "smoothed")
        loss = _pairs(z, check, dim).agg(F.avg(F.log1p(F.exp(-(_dot("u", "v", dim) - _dot("u", "w", dim)))))).first()[0]
        better = best_loss is None or (loss is not None and loss < best_loss - 1e-6)
        if better:
            if best is not None:
                discard(best)
            best, best_loss = z, loss
        since = 0 if better else since + 1
        if since >= patience:
            break
        p = _pairs(z, _others(fit, e, numbered, epoch, per), dim)
        p = p.withColumn("g", 1 / (1 + F.exp(_dot("u", "v", dim) - _dot("u", "w", dim))))
        one = lambda key, prefix, value: p.select(F.concat(F.lit(prefix), key).alias("node"), *[(F.col("g") * value(i)).alias(c) for i, c in enumerate(_columns(dim))])
        down = one("cik", "f:", lambda i: F.col(f"v{i}") - F.col(f"w{i}")).unionByName(one("cusip", "s:", lambda i: F.col(f"u{i}"))).unionByName(one("other", "s:", lambda i: -F.col(f"u{i}")))
        down = down.groupBy("node").agg(*[F.avg(c).alias(c) for c in _columns(dim)])
        step = _smooth(links, down, layers, dim).select("node", *[F.col(c).alias(f"d_{c}") for c in _columns(dim)])
        old, x = x, written(x.join(step, "node", "left").select("node", *[(F.col(c) * (1 - rate * penalty) + rate * F.coalesce(f"d_{c}", F.lit(0.0))).alias(c) for c in _columns(dim)]), "embeddings")
        discard(old)
        if not better:
            discard(z)
    return best


def score(z: DataFrame, pairs: DataFrame, dim: int = 8) -> DataFrame:
    """``pairs`` with ``score``, the inner product of their embeddings."""
    return _pairs(z, pairs.withColumn("other", F.col("cusip")), dim).select(*pairs.columns, _dot("u", "v", dim).alias("score"))
