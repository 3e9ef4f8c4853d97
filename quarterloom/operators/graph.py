"""The bipartite graph of filers and securities as edge frames.

Iterative operators keep their static edges in a written table and cut the lineage of the changing
side every few rounds with a written table in the shared folder, so a lost executor repeats at most
those rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarterloom.operators.hops import BLOCK as SOURCES
from quarterloom.operators.hops import Lists, hop_sums, largest_component
from quarterloom.session import discard, ship, written

CUT_EVERY = 3
#: Nodes of one row of the bits that degree centrality counts, in words of 64.
BLOCK = 256
#: Nodes x edges that one task of closeness takes (a few seconds), and the most tasks of one graph.
PART_COST, MAX_PARTS = 4e9, 16


def edges(rows: DataFrame, left: str = "cik", right: str = "cusip") -> DataFrame:
    return rows.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, right).distinct()


def latest_edges(rows: DataFrame, value: str, at: str = "p") -> DataFrame:
    """Union of several quarters; an edge keeps the value of its latest quarter, of several the greatest."""
    return rows.groupBy("cik", "cusip").agg(F.max(F.struct(at, value))[value].alias(value))


def degrees(e: DataFrame, side: str, *by: str) -> DataFrame:
    return e.groupBy(*by, side).agg(F.count(F.lit(1)).alias("degree"))


def degree_frequency(e: DataFrame, side: str) -> DataFrame:
    return degrees(e, side).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def degree_shares(e: DataFrame, side: str, per: Column | None = None) -> DataFrame:
    """(per, avg_degree, above_avg, above_twice): the average degree, and the share of nodes above it and above twice of it,
    from the frequency table; with ``per``, an expression of the node, for each of its values."""
    f = degrees(e, side).groupBy((F.lit(0) if per is None else per).alias("per"), "degree").agg(F.count(F.lit(1)).alias("n"))
    t = f.groupBy("per").agg((F.sum(F.col("degree") * F.col("n")) / F.sum("n")).alias("a"))
    above = lambda k: F.sum(F.when(F.col("degree") > k * F.col("a"), F.col("n")).otherwise(0)) / F.sum("n")
    return f.join(t, "per").groupBy("per").agg(F.max("a").alias("avg_degree"), above(1).alias("above_avg"), above(2).alias("above_twice"))


def log_histogram(rows: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """(bin, n) of log10 |value|, zeros left out, equal widths between the extremes."""
    x = rows.filter(F.col(value) != 0).select(F.log10(F.abs(value)).alias("x"))
    ends = x.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("e")).scalar()
    x = x.withColumn("e", ends)
    b = F.least(F.floor((F.col("x") - F.col("e.lo")) / ((F.col("e.hi") - F.col("e.lo")) / bins)), F.lit(bins - 1))
    return x.groupBy(b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def projection(e: DataFrame, node: str = "cik", via: str = "cusip") -> DataFrame:
    """(a, b, common), a < b: number of shared neighbours of two nodes.

    The pairs are the operator's result; a node on the other side with n neighbours makes n * (n - 1) / 2
    of them, summed up on the map side. Whatever only needs sums over the pairs works on the edges instead.
    """
    a = e.select(F.col(via).alias("__v"), F.col(node).alias("a"))
    b = e.select(F.col(via).alias("__v"), F.col(node).alias("b"))
    return a.join(b, "__v").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))


def _bipartite(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges (f, s), and of every node f that shares a neighbour with another (f, d, t): its degree and the sum of its
    weights in the projection, which is B * B^T without its diagonal: the sum of its neighbours' degrees less one."""
    e = written(e.select(F.col("cik").alias("f"), F.col("cusip").alias("s")).distinct(), "edges")
    deg = e.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    t = e.join(deg, "s").groupBy("f").agg(F.count(F.lit(1)).alias("d"), F.sum(F.col("n") - 1).alias("t")).filter("t > 0")
    return e, written(t, "nodes")


def _round_trip(e: DataFrame, value: DataFrame) -> DataFrame:
    """(f, x): B * (B^T * x) for (f, x), by two joins on the edges."""
    there = e.join(value, "f").groupBy("s").agg(F.sum("x").alias("x"))
    return e.join(there, "s").groupBy("f").agg(F.sum("x").alias("x"))


def pagerank(e: DataFrame, rounds: int = 20, alpha: float = 0.85, tolerance: float | None = None, per: Column | None = None) -> DataFrame:
    """(node, rank) on the projection of the edges (cik, cusip), weighted by shared neighbours, without forming it.

    Nodes without a shared neighbour have no row. With ``per``, an expression of ``node``, every such group of nodes
    is a graph of its own. With a ``tolerance`` it ends once the changes sum up to less than it times the nodes.
    """
    e, nodes = _bipartite(e)
    nodes = nodes.withColumn("node", F.col("f")).withColumn("per", F.lit(0) if per is None else per).drop("node")
    n = nodes.groupBy("per").agg(F.count(F.lit(1)).alias("n"))
    rank = written(nodes.join(n, "per").select("f", "d", "t", "n", (1.0 / F.col("n")).alias("rank")), "rank")
    count = rank.count() if tolerance else 0
    for i in range(rounds):
        share = F.col("rank") / F.col("t")
        into = _round_trip(e, rank.select("f", share.alias("x")))
        new = (1 - alpha) / F.col("n") + alpha * (F.col("x") - F.col("d") * share)
        nxt = rank.join(into, "f").select("f", "d", "t", "n", new.alias("new"), "rank")
        if tolerance or i % CUT_EVERY == CUT_EVERY - 1:
            old, nxt = rank, written(nxt, "rank")
            moved = nxt.agg(F.sum(F.abs(F.col("new") - F.col("rank")))).first()[0] or 0.0 if tolerance else None
            if tolerance:
                discard(old)
            if tolerance and moved < tolerance * count:
                rank = nxt.drop("rank").withColumnRenamed("new", "rank")
                break
        rank = nxt.drop("rank").withColumnRenamed("new", "rank")
    return rank.select(F.col("f").alias("node"), "rank")


def hits(e: DataFrame, rounds: int = 20, tolerance: float | None = None, per: Column | None = None) -> DataFrame:
    """(node, hub) by power iteration on the projection of the edges (hub equals authority), sum 1, without
    forming it; with ``per`` for every group of nodes. With a ``tolerance`` it ends once the hubs' changes sum up to less."""
    e, nodes = _bipartite(e)
    score = nodes.select("f", "d", F.lit(1.0).alias("hub")).withColumn("node", F.col("f")).withColumn("per", F.lit(0) if per is None else per).drop("node")
    for i in range(rounds):
        raw = score.join(_round_trip(e, score.select("f", F.col("hub").alias("x"))), "f").select("f", "d", "per", (F.col("x") - F.col("d") * F.col("hub")).alias("h"), "hub")
        raw = written(raw, "hits") if tolerance or i % CUT_EVERY == CUT_EVERY - 1 else raw
        total = raw.groupBy("per").agg(F.sum("h").alias("t"))
        new = raw.join(total, "per").select("f", "d", "per", (F.col("h") / F.col("t")).alias("new"), "hub")
        moved = new.agg(F.sum(F.abs(F.col("new") - F.col("hub")))).first()[0] or 0.0 if tolerance else None
        score = new.drop("hub").withColumnRenamed("new", "hub")
        if tolerance and moved < tolerance:
            break
    return score.select(F.col("f").alias("node"), "hub")


def components(e: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the least node name reachable, by labels that travel along edges and then
    jump to their own label, so that long chains take logarithmically many rounds."""
    both = e.select(F.concat(F.lit("f:"), "cik").alias("a"), F.concat(F.lit("s:"), "cusip").alias("b"))
    links = written(both.union(both.select("b", "a")), "links")
    label = links.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(max_rounds):
        near = links.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("l"))
        step = label.join(near, F.col("node") == F.col("n"), "left").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        up = step.select(F.col("node").alias("m"), F.col("label").alias("up"))
        label = written(step.join(up, F.col("label") == F.col("m"), "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        if label.filter("old <> label").isEmpty():
            break
        label = label.select("node", "label")
    return label.select("node", F.col("label").alias("component"))


def communities(e: DataFrame, rounds: int = 5, until_stable: bool = False) -> DataFrame:
    """(node, community): label propagation on the projection of the edges, by the heaviest label among
    neighbours, the least on ties. An approximation of modularity communities. ``until_stable``: ends once no label
    changes; labels may also alternate for ever, so ``rounds`` remains the bound.

    A node's votes are its securities' counts of labels, less its own: no pairs are stored.
    """
    e, nodes = _bipartite(e)
    label = nodes.select("f", "d", F.col("f").alias("c"))
    for i in range(rounds):
        there = e.join(label, "f").groupBy("s", "c").agg(F.count(F.lit(1)).alias("w"))
        votes = e.join(there, "s").groupBy("f", "c").agg(F.sum("w").alias("w"))
        own = label.select("f", "d", F.col("c").alias("old"))
        votes = votes.join(own, "f").withColumn("w", F.col("w") - F.when(F.col("c") == F.col("old"), F.col("d")).otherwise(0)).filter("w > 0")
        label = votes.groupBy("f").agg(F.first("d").alias("d"), F.min(F.struct((-F.col("w")).alias("w"), "c"))["c"].alias("c"), F.first("old").alias("old"))
        label = written(label, "labels") if until_stable or i % CUT_EVERY == CUT_EVERY - 1 else label
        if until_stable and label.filter("c <> old").isEmpty():
            break
        label = label.select("f", "d", "c")
    return label.select(F.col("f").alias("node"), F.col("c").alias("community"))


def modularity(e: DataFrame, labels: DataFrame, per: Column | None = None) -> DataFrame:
    """(per, modularity) of the labels (node, community) on the projection of the edges: the weight within
    communities less what their totals let expect, as shares; from counts per security and community."""
    e, nodes = _bipartite(e)
    label = labels.withColumn("per", F.lit(0) if per is None else per).select(F.col("node").alias("f"), F.col("community").alias("c"), "per")
    k = F.col("k")
    within = e.join(label, "f").groupBy("per", "s", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("per", "c").agg(F.sum(k * (k - 1)).alias("w"))
    total = nodes.join(label, "f").groupBy("per", "c").agg(F.sum("t").alias("t"))
    per_label = total.join(within, ["per", "c"])
    m = per_label.groupBy("per").agg(F.sum("t").alias("m"))
    q = F.col("w") / F.col("m") - (F.col("t") / F.col("m")) * (F.col("t") / F.col("m"))
    return per_label.join(m, "per").groupBy("per").agg(F.sum(q).alias("modularity"))


_WORDS = range(BLOCK // 64)


def _sources(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges (f, s) by number of f, the numbers of the nodes, and for every node its own bit: (f, block, b0...)."""
    ids = written(number_nodes(e.select(F.col("cik").alias("node")), "node"), "ids")
    links = written(e.select("cik", "cusip").distinct().join(ids, F.col("cik") == F.col("node")).select(F.col("id").alias("f"), F.col("cusip").alias("s")), "links")
    none = F.lit(0).cast("long")
    bits = [F.when(F.floor(F.col("id") % BLOCK / 64) == i, F.expr("shiftleft(1L, CAST(id % 64 AS INT))")).otherwise(none).alias(f"b{i}") for i in _WORDS]
    return links, ids, ids.select(F.col("id").alias("f"), F.floor(F.col("id") / BLOCK).alias("block"), *bits)


def _spread(links: DataFrame, front: DataFrame) -> DataFrame:
    """The bits of a node's neighbours in the projection (and its own), by a bitwise OR over each security and back."""
    either = [F.bit_or(f"b{i}").alias(f"b{i}") for i in _WORDS]
    there = links.join(front, "f").groupBy("s", "block").agg(*either)
    return links.join(there, "s").groupBy("f", "block").agg(*either)


def degree_centrality(e: DataFrame, per: Column | None = None) -> DataFrame:
    """(node, centrality): a node's neighbours in the projection over the number of other nodes (with ``per``, an
    expression of ``node``, of its group). Neighbours are counted as bits in blocks of 256 nodes, so no pairs are formed."""
    links, ids, own = _sources(e)
    d = _spread(links, own).groupBy("f").agg((F.sum(sum((F.bit_count(f"b{i}") for i in _WORDS), F.lit(0))) - 1).alias("d"))
    nodes = ids.withColumn("per", F.lit(0) if per is None else per)
    n = nodes.groupBy("per").agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(n, "per").join(d, F.col("id") == F.col("f")).select("node", F.try_divide(F.col("d"), F.col("n") - 1).alias("centrality"))


def _hop_sums_of_part(key: tuple[pa.Scalar, ...], lists: pa.Table) -> pa.Table:
    """(node, n, d) of the largest component of the lists: its size and each node's hops to the sources of this part."""
    part, parts = key[1].as_py(), key[2].as_py()
    filers = lists.column("filers").combine_chunks()
    code = filers.flatten().dictionary_encode()
    order = pc.sort_indices(code.dictionary).to_numpy()  # by bytes, as Spark compares names
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    every = Lists(rank[code.indices.to_numpy()], pc.list_value_length(filers).to_numpy().astype(np.int64))
    member = np.zeros(len(order), bool)
    member[largest := largest_component(every, len(order))] = True
    own = every.pick(np.flatnonzero(every.any(member)))
    d = hop_sums(Lists((np.cumsum(member) - 1)[own.values], own.sizes), len(largest), part, parts)
    return pa.table({"node": code.dictionary.take(pa.array(order[largest])).cast(pa.string()), "n": np.full(len(d), len(d)), "d": d})


def closeness(e: DataFrame, per: Column | None = None) -> DataFrame:
    """(node, closeness) of all nodes cik of the edges, in their projection: (n - 1) / sum of hops within the
    largest component of n nodes (the one with the least node on ties), 0 for the others.
    With ``per``, an expression of ``node``, each such group of nodes is a graph of its own.

    A security is the list of its filers. A task has the lists of one graph and every so many-th block of
    512 sources, one bit each, and goes level by level over the lists and back (``hops``). So nothing quadratic is
    stored or shuffled: a graph's lists go to as many tasks as its arithmetic (nodes x edges) asks for, at most
    MAX_PARTS. As neighbours are mutual, the bits of a node also count what it reaches itself.
    """
    ship(e.sparkSession)
    of_node = (F.lit(0) if per is None else per).alias("__per")
    rows = e.select(F.col("cik").alias("node"), "cusip").filter("node IS NOT NULL AND cusip IS NOT NULL")
    nodes = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("edges")).select("node", of_node, "edges"), "nodes")
    lists = rows.select(of_node, "node", "cusip").groupBy("__per", "cusip").agg(F.collect_set("node").alias("filers")).filter(F.size("filers") > 1)
    cost = F.count(F.lit(1)).cast("double") * F.sum("edges")
    parts = nodes.groupBy("__per").agg(F.least(F.ceil(cost / PART_COST), F.ceil(F.count(F.lit(1)) / SOURCES), F.lit(MAX_PARTS)).cast("int").alias("parts"))
    sent = lists.join(parts, lists["__per"].eqNullSafe(parts["__per"])).select(parts["__per"], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", "filers")
    sums = sent.groupBy("__per", "part", "parts").applyInArrow(_hop_sums_of_part, "node string, n long, d long").groupBy("node").agg(F.max("n").alias("n"), F.sum("d").alias("d"))
    return nodes.select("node").join(sums, "node", "left").select("node", F.coalesce(F.try_divide(F.col("n") - 1, F.col("d")), F.lit(0.0)).alias("closeness"))


def rev2(e: DataFrame, rounds: int = 100, g1: float = 1.0, g2: float = 1.0, tolerance: float = 1e-6, aum: DataFrame | None = None, per: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Fairness of filers and goodness of securities on edges (cik, cusip, w) with w in [-1, 1].

    Every round computes the edges' reliability from the old fairness and goodness, then both anew. Fairness starts at
    0.5 or, with ``aum`` (cik, total), at the logistic of the standardised logarithm of the assets (with ``per``, an
    expression of ``cik``, standardised in its group); filers without assets at 0.5.
    """
    e = written(e.select("cik", "cusip", F.greatest(F.least("w", F.lit(1.0)), F.lit(-1.0)).alias("w")), "edges")
    fair = e.select("cik").distinct().withColumn("f", F.lit(0.5))
    if aum is not None:
        x = fair.join(aum.filter("total > 0").select("cik", F.ln("total").alias("x")), "cik", "left").withColumn("per", F.lit(0) if per is None else per)
        s = x.groupBy("per").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
        z = F.coalesce(F.try_divide(F.col("x") - F.col("m"), F.col("s")), F.lit(0.0))
        fair = x.join(s, "per").select("cik", (1 / (1 + F.exp(-z))).alias("f"))
    good = e.select("cusip").distinct().withColumn("g", F.lit(0.0))
    for i in range(rounds):
        rel = (g1 * F.col("f") + g2 * (1 - F.abs(F.col("w") - F.col("g")) / 2)) / (g1 + g2)
        r = e.join(fair, "cik").join(good, "cusip").select("cik", "cusip", "w", rel.alias("r"), "f", "g")
        f2 = r.groupBy("cik").agg(F.avg("r").alias("f"), F.max("f").alias("f_old"))
        g2_ = r.groupBy("cusip").agg(F.avg(F.col("r") * F.col("w")).alias("g"), F.max("g").alias("g_old"))
        before = (fair, good)
        f2, g2_ = written(f2, "fair"), written(g2_, "good")
        fair, good = f2.select("cik", "f"), g2_.select("cusip", "g")
        if i:
            discard(before[0])
            discard(before[1])
        if tolerance:
            moved = max(f2.agg(F.max(F.abs(F.col("f") - F.col("f_old")))).first()[0] or 0.0, g2_.agg(F.max(F.abs(F.col("g") - F.col("g_old")))).first()[0] or 0.0)
            if moved < tolerance:
                break
    return fair, good


def propagate(e: DataFrame, features: DataFrame, layers: int = 3, weight: str | None = None, self_loops: bool = True, activation: bool = False, last: bool = False) -> DataFrame:
    """Neighbour sums with symmetric degree normalisation, averaged over the layers.

    ``features``: (node, x) with nodes named 'f:…' and 's:…'. With ``self_loops`` a node counts as its own neighbour,
    with weight 1. ``activation``: negative values become 0 after every layer but the last; ``last``: only the last
    layer's values. A layer is one join and one aggregation.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    one = e.select(F.concat(F.lit("f:"), "cik").alias("a"), F.concat(F.lit("s:"), "cusip").alias("b"), w.alias("w"))
    links = one.union(one.select("b", "a", "w"))
    if self_loops:
        links = links.union(links.select("a", F.col("a").alias("b"), F.lit(1.0).alias("w")).distinct())
    deg = links.groupBy("a").agg(F.sum("w").alias("d"))
    links = links.join(deg, "a").join(deg.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    links = written(links.select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("db"))).alias("n")), "links")
    x = features.select("node", "x")
    total = x.withColumn("layer", F.lit(0))
    for i in range(layers):
        x = links.join(x, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.sum(F.col("n") * F.col("x")).alias("x"))
        x = x.withColumn("x", F.greatest("x", F.lit(0.0))) if activation and i < layers - 1 else x
        x = written(x, "layer")
        total = total.unionByName(x.withColumn("layer", F.lit(i + 1)))
    return x if last else total.groupBy("node").agg((F.sum("x") / (layers + 1)).alias("x"))


def sage_mean(e: DataFrame, features: DataFrame, key: str, other: str, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Mean of the neighbours' features (the aggregation of a SAGE layer), weighted by the edges' absolute
    ``weight`` if one is named."""
    both = e.join(features, other)
    if weight is None:
        return both.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])
    w = F.abs(F.col(weight))
    return both.groupBy(key).agg(*[F.try_divide(F.sum(w * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in columns])


def sample_two_hops(e: DataFrame, seeds: DataFrame, first: int, second: int, order: Column, order_back: Column) -> DataFrame:
    """(seed, cusip, cik): for every seed security up to ``first`` of its filers and for each of these up to ``second`` securities."""
    near = sample_neighbours(e.join(seeds.select("cusip").distinct(), "cusip", "left_semi"), "cusip", "cik", first, order)
    far = sample_neighbours(e.join(near.select("cik").distinct(), "cik", "left_semi"), "cik", "cusip", second, order_back)
    return near.select(F.col("cusip").alias("seed"), "cik").join(far, "cik").select("seed", "cik", "cusip")


def sample_neighbours(e: DataFrame, key: str, other: str, fan_out: int, order: Column) -> DataFrame:
    """At most ``fan_out`` neighbours per node, the first by a deterministic order.

    Two steps so that a heavy node is cut down within each of its salted parts first.
    """
    o = e.withColumn("__o", order)
    parts = W.partitionBy(key, F.pmod(F.xxhash64(other), F.lit(64))).orderBy("__o", other)
    few = o.withColumn("__r", F.row_number().over(parts)).filter(F.col("__r") <= fan_out)
    return few.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("__o", other))).filter(F.col("__r") <= fan_out).drop("__r", "__o")


def zscores(rows: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """(x - mean) / sample sd, missing values as the column's median first; 0 where the sd is 0.

    Medians, then mean and sd: two rows of statistics over the whole table, joined as scalars;
    with ``by`` such rows for each of its values.
    """
    clean = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in columns}
    rows = rows.withColumns(clean)
    medians = [F.median(c).alias(c) for c in columns]
    if by:
        rows = rows.join(rows.groupBy(by).agg(*medians).select(by, F.struct(*columns).alias("__m")), by)
    else:
        rows = rows.withColumn("__m", rows.agg(*medians).select(F.struct("*").alias("m")).scalar())
    filled = rows.withColumns({c: F.coalesce(F.col(c), F.col(f"__m.{c}")) for c in columns})
    moments = [x for c in columns for x in (F.avg(c).alias(f"{c}_a"), F.stddev_samp(c).alias(f"{c}_s"))]
    if by:
        names = [f"{c}_{x}" for c in columns for x in "as"]
        filled = filled.join(filled.groupBy(by).agg(*moments).select(by, F.struct(*names).alias("__s")), by)
    else:
        filled = filled.withColumn("__s", filled.agg(*moments).select(F.struct("*").alias("s")).scalar())
    z = {c: F.when(F.coalesce(F.col(f"__s.{c}_s"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"__s.{c}_a")) / F.col(f"__s.{c}_s")) for c in columns}
    return filled.withColumns(z).drop("__m", "__s")


def profitability(w: DataFrame, ret: DataFrame) -> DataFrame:
    """(cik, p, profit): weights of a quarter times the log returns of the next."""
    nxt = ret.select("cusip", (F.col("p") - 1).alias("p"), "log_return")
    return w.join(nxt, ["cusip", "p"]).groupBy("cik", "p").agg(F.sum(F.col("weight") * F.col("log_return")).alias("profit"))


def number_nodes(nodes: DataFrame, key: str) -> DataFrame:
    """Dense ids from 0 in the order of the names, without one task seeing all: ranges are counted, then
    each adds the sizes of the ranges before it."""
    r = written(nodes.select(key).distinct().repartitionByRange(key).withColumn("__b", F.spark_partition_id()), "ranges")
    sizes = r.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"), F.min(key).alias("__lo"))
    before = sizes.select("__b", (F.sum("__n").over(W.orderBy("__lo")) - F.col("__n")).alias("__before"))  # one row per range
    return r.join(before, "__b").select(key, (F.col("__before") + F.row_number().over(W.partitionBy("__b").orderBy(key)) - 1).alias("id"))
