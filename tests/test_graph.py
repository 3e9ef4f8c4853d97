import math
import random
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterloom.operators import graph as G
from quarterloom.operators.hops import Lists, hop_sums, largest_component


def edges(spark, pairs):
    """A security for every pair, so that the projection has these pairs."""
    rows = [(n, f"s{i:05d}") for i, p in enumerate(pairs) for n in p]
    return spark.createDataFrame(rows, "cik string, cusip string")


def brute(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    hops, parts = {}, []
    for n in sorted(near):
        d, q = {n: 0}, deque([n])
        while q:
            x = q.popleft()
            for y in near[x] - d.keys():
                d[y] = d[x] + 1
                q.append(y)
        hops[n] = d
    for n in sorted(near):
        if not any(n in p for p in parts):
            parts.append(set(hops[n]))
    top = max(parts, key=len) if parts else set()  # the first of equal size has the least node
    return near, {n: (len(top) - 1) / sum(hops[n].values()) if n in top else 0.0 for n in near}


def check(spark, pairs, alone=()):
    near, want = brute(pairs)
    want |= {n: 0.0 for n in alone}
    e = edges(spark, [*pairs, *[(n, n) for n in alone]])
    got = {r["node"]: r["closeness"] for r in G.closeness(e).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in want)
    got = {r["node"]: r["centrality"] for r in G.degree_centrality(e).collect()}
    assert all(got[n] == pytest.approx(len(near.get(n, ())) / (len(want) - 1)) for n in want)


def test_long_chain_small_parts_and_blocks(spark):
    chain = [f"c{i:02d}" for i in range(14)]  # further than ten hops
    check(spark, [*zip(chain, chain[1:]), ("x", "y")], ["alone"])
    check(spark, [("a", "b"), ("c", "d")])  # equal sizes
    check(spark, [("h0", f"n{i:04d}") for i in range(350)] + [("h1", f"n{i:04d}") for i in range(349, 700)])  # more than one block


def test_closeness_stores_no_sources_by_nodes(spark, monkeypatch):
    """Nothing that it writes has more rows than the graph has nodes and edges, also with several blocks and tasks."""
    sizes, write = [], G.written

    def counted(df, name="step"):
        got = write(df, name)
        sizes.append(got.count())
        return got

    monkeypatch.setattr(G, "written", counted)
    monkeypatch.setattr(G, "PART_COST", 1.0, raising=False)  # as many tasks as there are blocks
    pairs = [("h0", f"n{i:04d}") for i in range(600)] + [("h1", f"n{i:04d}") for i in range(599, 1300)]
    _, want = brute(pairs)
    got = {r["node"]: r["closeness"] for r in G.closeness(edges(spark, pairs)).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in want)
    assert sum(sizes) <= len(want) + 2 * len(pairs)


def test_closeness_of_groups(spark):
    """Each group has its largest component; repeated edges count once, and missing names connect nothing."""
    parts = {"a": [("a1", "a2"), ("a2", "a3"), ("a4", "a5")], "b": [("b1", "b2"), ("b3", "b4")]}
    rows = [r for p in parts.values() for r in edges(spark, p).withColumn("cusip", F.concat(F.lit(p[0][0][0]), "cusip")).collect()]
    e = spark.createDataFrame([*rows, *rows[:3], ("a1", None), ("b9", None)], "cik string, cusip string")
    got = {r["node"]: r["closeness"] for r in G.closeness(e, F.substring("node", 1, 1)).collect()}
    want = {n: v for p in parts.values() for n, v in brute(p)[1].items()}
    assert {n: v for n, v in got.items() if n != "b9"} == pytest.approx(want) and want["b1"] == 1.0 and want["b3"] == 0.0


@pytest.mark.parametrize("seed", range(3))
def test_hop_sums_of_random_lists(seed):
    rng = random.Random(seed)
    lists = [sorted({rng.randrange(900) for _ in range(rng.randrange(2, 5))}) for _ in range(700)]
    number = {x: i for i, x in enumerate(sorted({x for v in lists for x in v}))}
    lists = [[number[x] for x in v] for v in lists]
    _, want = brute([(a, b) for v in lists for a in v for b in v if a != b] + [(v[0], v[0]) for v in lists])
    every = Lists(np.concatenate(lists), np.array([len(v) for v in lists]))
    top = largest_component(every, len(number))
    assert top.tolist() == sorted(n for n in want if want[n] > 0)
    inside = np.isin(np.arange(len(number)), top)
    own = every.pick(np.flatnonzero(every.any(inside)))
    own = Lists((np.cumsum(inside) - 1)[own.values], own.sizes)
    sums = sum(hop_sums(own, len(top), part, 2) for part in range(2))
    assert [(len(top) - 1) / d for d in sums.tolist()] == pytest.approx([want[n] for n in top.tolist()])


def matrix(rows):
    """The projection's weights by brute force."""
    f, s = sorted({a for a, _ in rows}), sorted({b for _, b in rows})
    b = np.zeros((len(f), len(s)))
    for x, y in rows:
        b[f.index(x), s.index(y)] = 1
    w = b @ b.T
    np.fill_diagonal(w, 0)
    some = w.sum(axis=1) > 0
    return [n for n, k in zip(f, some) if k], w[some][:, some]


def some_edges(seed=2):
    rng = random.Random(seed)
    return sorted({(f"f{rng.randrange(25):02d}", f"s{rng.randrange(12):02d}") for _ in range(70)} | {("lonely", "s99")})


def test_ranks_against_matrices(spark):
    rows = some_edges()
    e = spark.createDataFrame(rows, "cik string, cusip string")
    names, w = matrix(rows)
    p = w / w.sum(axis=1, keepdims=True)
    r = np.full(len(names), 1 / len(names))
    h = np.ones(len(names))
    for i in range(60):
        r = 0.15 / len(names) + 0.85 * (r @ p)
        h = w @ h / (w @ h).sum()
        if i == 4:
            early, hub = r, h
    close = lambda df, c, want: {x["node"]: x[c] for x in df.collect()} == pytest.approx(dict(zip(names, want)), abs=1e-6)
    assert close(G.pagerank(e, rounds=5), "rank", early) and close(G.hits(e, rounds=5), "hub", hub)
    assert close(G.pagerank(e, rounds=100, tolerance=1e-9), "rank", r)
    assert close(G.hits(e, rounds=100, tolerance=1e-8), "hub", h)


def test_communities_and_modularity_against_matrices(spark):
    rows = some_edges(5)
    e = spark.createDataFrame(rows, "cik string, cusip string")
    names, w = matrix(rows)
    label = dict(zip(names, names))
    for _ in range(5):
        new = {}
        for i, n in enumerate(names):
            votes = Counter()
            for j, m in enumerate(names):
                if w[i, j]:
                    votes[label[m]] += w[i, j]
            new[n] = min(votes, key=lambda c: (-votes[c], c))
        label = new
    got = {r["node"]: r["community"] for r in G.communities(e).collect()}
    assert got == label
    m = w.sum()
    q = sum(w[i, j] / m - w[i].sum() * w[j].sum() / m / m for i, a in enumerate(names) for j, b in enumerate(names) if label[a] == label[b])
    assert G.modularity(e, G.communities(e)).first()["modularity"] == pytest.approx(q)


def test_communities_run_until_stable(spark):
    e = edges(spark, [*[("a", "b")] * 4, *[("a", "c")] * 4, *[("b", "c")] * 4, ("c", "d"), *[("d", "e")] * 4, *[("d", "f")] * 4, *[("e", "f")] * 4])
    c = {r["node"]: r["community"] for r in G.communities(e, 30, until_stable=True).collect()}
    assert len({c[n] for n in "abc"}) == 1 and len({c[n] for n in "def"}) == 1


def test_rev2_from_assets_until_converged(spark):
    rng = random.Random(3)
    rows = sorted({(f"f{rng.randrange(8)}", f"s{rng.randrange(6)}"): rng.uniform(-1, 1) for _ in range(30)}.items())
    aum = {f"f{i}": 10.0 ** (i + 1) for i in range(7)}
    fs = sorted({f for (f, _), _ in rows})
    x = [math.log(aum[f]) for f in fs if f in aum]
    fair = {f: 1 / (1 + math.exp(-(math.log(aum[f]) - np.mean(x)) / np.std(x))) if f in aum else 0.5 for f in fs}
    good = {s: 0.0 for (_, s), _ in rows}
    for _ in range(200):
        rel = {k: (fair[k[0]] + 1 - abs(w - good[k[1]]) / 2) / 2 for k, w in rows}
        fair = {f: np.mean([rel[k] for k, _ in rows if k[0] == f]) for f in fair}
        good = {s: np.mean([rel[k] * w for k, w in rows if k[1] == s]) for s in good}
    e = spark.createDataFrame([(*k, w) for k, w in rows], "cik string, cusip string, w double")
    f, g = G.rev2(e, aum=spark.createDataFrame(list(aum.items()), "cik string, total double"))
    assert {r["cusip"]: r["g"] for r in g.collect()} == pytest.approx(good, abs=1e-4)
    assert {r["cik"]: r["f"] for r in f.collect()} == pytest.approx(fair, abs=1e-4)


def test_propagation_with_self_loops_against_a_matrix(spark):
    rows = some_edges(7)
    e = spark.createDataFrame(rows, "cik string, cusip string")
    nodes = sorted({f"f:{a}" for a, _ in rows} | {f"s:{b}" for _, b in rows})
    a = np.eye(len(nodes))
    for x, y in rows:
        i, j = nodes.index(f"f:{x}"), nodes.index(f"s:{y}")
        a[i, j] = a[j, i] = 1
    d = a.sum(axis=1)
    n = a / np.sqrt(np.outer(d, d))
    x = np.linspace(-1, 1, len(nodes))
    f = spark.createDataFrame([(k, float(v)) for k, v in zip(nodes, x)], "node string, x double")
    got = {r["node"]: r["x"] for r in G.propagate(e, f, layers=2).collect()}
    assert got == pytest.approx(dict(zip(nodes, (x + n @ x + n @ n @ x) / 3)))
    got = {r["node"]: r["x"] for r in G.propagate(e, f, layers=2, activation=True, last=True).collect()}
    assert got == pytest.approx(dict(zip(nodes, n @ np.maximum(n @ x, 0))))


def test_balanced_negatives(spark):
    from pyspark.sql import functions as F

    from quarterloom.operators import linkpred as L

    rng = random.Random(1)
    rows = sorted({(f"f{rng.randrange(40):02d}", f"s{rng.randrange(60):02d}") for _ in range(500)})
    e = spark.createDataFrame(rows, "cik string, cusip string")
    names = sorted({s for _, s in rows})
    b = spark.createDataFrame([(s, i, len(names), 0) for i, s in enumerate(names)], "cusip string, b long, n long, w int")
    pos = e.filter(F.col("cusip") < "s30")
    neg = [tuple(r) for r in L.balanced_negatives(pos, b, e, 7, "w").collect()]
    n = Counter(c for c, _ in pos.select("cik", "cusip").collect())
    m = Counter(c for c, _ in neg)
    assert len(set(neg)) == len(neg) and not set(neg) & set(rows)
    assert all(m[c] <= n[c] for c in m) and sum(m.values()) > 0.85 * sum(n.values())
    assert neg != [] and sorted(neg) == sorted(tuple(r) for r in L.balanced_negatives(pos, b, e, 7, "w").collect())


def test_unseen_by_degree_against_all_pairs(spark):
    from quarterloom.operators import linkpred as L
    from pyspark.sql import functions as F

    rows = some_edges(9)
    e = spark.createDataFrame(rows, "cik string, cusip string")
    d, n = Counter(s for _, s in rows), Counter(f for f, _ in rows)
    got = {}
    for r in L.unseen_by_degree(e, "cik", "cusip", 4, lambda c: F.lit(0)).collect():
        got.setdefault(r["cik"], []).append((r["rank"], r["cusip"], r["score"]))
    for f in n:
        best = sorted((s for s in d if (f, s) not in set(rows)), key=lambda s: (-d[s], s))[:4]
        assert sorted(got[f]) == [(i + 1, s, float(n[f] * d[s])) for i, s in enumerate(best)]
