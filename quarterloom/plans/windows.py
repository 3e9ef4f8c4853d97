"""The graph, link prediction and feature queries over all sliding windows and all quarters.

A window has three train quarters and the next as test quarter. Node names carry their window (or quarter), so
that the operators see one graph whose windows have no edge in common; what an operator takes over a whole graph
(maxima, numbers of nodes, sums) is taken per window. The SQL is written for one window, with its quarters as
numbers, and repeated for every window that the data can have.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarterloom.operators import embed as V
from quarterloom.operators import graph as G
from quarterloom.operators import linkpred as L
from quarterloom.operators import metrics as M
from quarterloom.plans.base import RATIOS, SQL, Base, big, ctes, rnd
from quarterloom.plans.registry import query
from quarterloom.session import written

WIDTH = 5
#: The numbers of the quarters in the SQL of one window: the first and last train quarter, and the test quarter.
FIRST, LASTQ, TEST = 8088, 8090, 8091
#: Quarters that the tables can have, 2018Q1 to 2025Q4.
SPAN = range(2018 * 4, 2026 * 4)
ED = f"ed AS MATERIALIZED (SELECT DISTINCT cik, cusip FROM buys WHERE p BETWEEN {FIRST} AND {LASTQ}), te AS MATERIALIZED (SELECT DISTINCT cik, cusip FROM buys WHERE p = {TEST})"
#: SQL of one window or quarter by query.
ONE: dict[str, str] = {}


def _over(name: str, windows: bool) -> str:
    """The SQL of one window for all of them: the quarters' numbers are moved along, rows get the window or quarter."""
    one = ONE[name].lstrip()
    used = [n for n in SQL if re.search(rf"(?:FROM|JOIN)\s+{n}\b", one)]
    inner = one if one.startswith("SELECT") else "WITH " + one.lstrip(", ")
    parts = []
    for at in SPAN:
        moved = re.sub(r"\b80(?:8[89]|9[01])\b", lambda m: str(int(m[0]) - (FIRST if windows else TEST) + at), inner)
        win = f"CAST((SELECT count(*) FROM bq WHERE p < {at}) AS BIGINT) AS win" if windows else f"CAST({at} AS BIGINT) AS p"
        full = f" WHERE (SELECT count(*) FROM bq WHERE p BETWEEN {at} AND {at + 3}) = 4" if windows else ""
        parts.append(f"SELECT {win}, x.* FROM ({moved}) x{full}")
    return ctes(*used, "buys") + ", bq AS MATERIALIZED (SELECT DISTINCT p FROM buys)\n" + "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- SQL of one window


ONE["combined_graph"] = f"SELECT cik, cusip, round(arg_max(dw, (p, dw)), 9) AS dw FROM buys WHERE p BETWEEN {FIRST} AND {LASTQ} GROUP BY 1, 2"


ONE["degree_distribution"] = f", {ED} SELECT degree, count(*) AS n FROM (SELECT cik, count(*) AS degree FROM ed, (SELECT 1 FROM buys LIMIT 1) GROUP BY 1) GROUP BY 1"


ONE["degree_shares"] = f", {ED}, dg AS (SELECT cusip, count(*) AS degree FROM ed GROUP BY 1), a AS (SELECT avg(degree) AS a FROM dg, (SELECT 1 FROM buys LIMIT 1)) SELECT round(max(a), 6) AS avg_degree, round(avg((degree > a)::INT), 6) AS above_avg, round(avg((degree > 2 * a)::INT), 6) AS above_twice FROM dg, a"


PAIRS = "pr AS MATERIALIZED (SELECT x.cik AS a, y.cik AS b, count(*) AS common FROM ed x JOIN ed y ON x.cusip = y.cusip AND x.cik <> y.cik GROUP BY 1, 2)"
ANY = "(SELECT 1 FROM buys LIMIT 1)"


ONE["fund_projection"] = f", {ED}, {PAIRS} SELECT a, b, common FROM pr, {ANY} WHERE a < b"


ONE["degree_centrality"] = f", {ED}, {PAIRS}, n AS (SELECT DISTINCT cik FROM ed, {ANY}) SELECT n.cik, round((SELECT count(*) FROM pr WHERE a = n.cik) / ((SELECT count(*) FROM n) - 1), 6) AS centrality FROM n"


def _rank_sql(rounds: int) -> str:
    parts = [f"{ED}, {PAIRS}, o AS (SELECT a, sum(common) AS t FROM pr GROUP BY 1), l AS MATERIALIZED (SELECT pr.a, b, common / t AS w FROM pr JOIN o ON o.a = pr.a), c AS (SELECT count(*) AS n FROM o), r0 AS (SELECT a AS node, 1.0 / n AS r FROM o, c)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT o.a AS node, 0.15 / n + 0.85 * coalesce(s.s, 0) AS r FROM o CROSS JOIN c LEFT JOIN (SELECT b, sum(w * r) AS s FROM l JOIN r{i} ON r{i}.node = l.a GROUP BY 1) s ON s.b = o.a)")
    return ", " + ", ".join(parts) + f" SELECT node, round(r, 9) AS rank FROM r{rounds}, {ANY}"


ONE["pagerank"] = _rank_sql(5)


def _hits_sql(rounds: int) -> str:
    parts = [f"{ED}, {PAIRS}, h0 AS (SELECT DISTINCT a AS node, 1.0 AS h FROM pr)"]
    for i in range(rounds):
        parts.append(f"g{i + 1} AS MATERIALIZED (SELECT a, sum(common * h) AS h FROM pr JOIN h{i} ON node = b GROUP BY 1), h{i + 1} AS MATERIALIZED (SELECT a AS node, h / (SELECT sum(h) FROM g{i + 1}) AS h FROM g{i + 1})")
    return ", " + ", ".join(parts) + f" SELECT node, round(h, 9) AS hub FROM h{rounds}, {ANY}"


ONE["hits"] = _hits_sql(5)


def _community_sql(rounds: int, last: str) -> str:
    parts = [f"{ED}, {PAIRS}, c0 AS (SELECT DISTINCT a AS node, a AS c FROM pr)"]
    for i in range(rounds):
        parts.append(f"v{i} AS (SELECT a, c, sum(common) AS w FROM pr JOIN c{i} ON node = b GROUP BY 1, 2), c{i + 1} AS MATERIALIZED (SELECT a AS node, arg_min(c, (-w, c)) AS c FROM v{i} GROUP BY 1)")
    return ", " + ", ".join(parts) + last.replace("{last}", f"c{rounds}")


ONE["communities"] = _community_sql(5, f" SELECT node, c AS community FROM {{last}}, {ANY}")
ONE["modularity"] = _community_sql(5, f""", t AS (SELECT a, sum(common) AS t FROM pr GROUP BY 1), k AS (SELECT c, sum(t) AS t FROM {{last}} JOIN t ON a = node GROUP BY 1),
i AS (SELECT x.c, sum(common) AS w FROM pr JOIN {{last}} x ON x.node = a JOIN {{last}} y ON y.node = b AND y.c = x.c GROUP BY 1), m AS (SELECT sum(t) AS m FROM t)
SELECT round(sum(coalesce(w, 0) / m - (t / m) * (t / m)), 6) AS modularity FROM k LEFT JOIN i ON i.c = k.c, m, {ANY}""")


def _component_sql(rounds: int) -> str:
    parts = [f"{ED}, k AS (SELECT 'f:' || cik AS a, 's:' || cusip AS b FROM ed), l AS MATERIALIZED (SELECT a, b FROM k UNION SELECT b, a FROM k), c0 AS (SELECT DISTINCT a AS node, a AS c FROM l)"]
    for i in range(rounds):
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT x.node, least(x.c, min(y.c)) AS c FROM c{i} x JOIN l ON l.a = x.node JOIN c{i} y ON y.node = l.b GROUP BY x.node, x.c)")
    return ", " + ", ".join(parts) + f" SELECT node, c AS component FROM c{rounds}, {ANY}"


ONE["components"] = _component_sql(12)


def _closeness_sql(hops: int) -> str:
    """Hops from every filer to every other by at most so many rounds, then the largest component."""
    parts = [f"{ED}, {PAIRS}, n0 AS (SELECT DISTINCT cik AS node FROM ed), h0 AS MATERIALIZED (SELECT node AS x, node AS y, 0 AS h FROM n0)"]
    for i in range(hops):
        parts.append(f"h{i + 1} AS MATERIALIZED (SELECT x, y, min(h) AS h FROM (SELECT x, y, h FROM h{i} UNION ALL SELECT x, b, {i + 1} FROM h{i} JOIN pr ON a = y WHERE h = {i}) GROUP BY 1, 2)")
    return ", " + ", ".join(parts) + f""", z AS MATERIALIZED (SELECT x, count(*) AS n, sum(h) AS d, min(y) AS c FROM h{hops} GROUP BY 1), best AS (SELECT n, c FROM z WHERE n > 1 ORDER BY n DESC, c LIMIT 1)
SELECT z.x AS node, round(CASE WHEN best.n IS NOT NULL THEN (z.n - 1) / z.d ELSE 0 END, 9) AS closeness FROM z LEFT JOIN best ON best.n = z.n AND best.c = z.c, {ANY}"""


ONE["closeness"] = _closeness_sql(8)


def _rev2_sql(rounds: int) -> str:
    parts = [f"e AS MATERIALIZED (SELECT cik, cusip, greatest(least(avg(dw), 1), -1) AS w FROM ch WHERE dw IS NOT NULL AND p = {TEST} GROUP BY 1, 2), f0 AS (SELECT DISTINCT cik, 0.5 AS f FROM e), g0 AS (SELECT DISTINCT cusip, 0.0 AS g FROM e)"]
    for i in range(rounds):
        parts.append(f"r{i} AS MATERIALIZED (SELECT e.*, (f + (1 - abs(w - g) / 2)) / 2 AS r FROM e JOIN f{i} USING (cik) JOIN g{i} USING (cusip)), f{i + 1} AS (SELECT cik, avg(r) AS f FROM r{i} GROUP BY 1), g{i + 1} AS (SELECT cusip, avg(r * w) AS g FROM r{i} GROUP BY 1)")
    return ", " + ", ".join(parts) + f" SELECT cusip, round(g, 9) + 0.0 AS goodness FROM g{rounds}, (SELECT 1 FROM ch LIMIT 1)"


ONE["rev2_goodness"] = _rev2_sql(4)


ONE["goodness_baseline"] = f"SELECT cusip, round(avg(dw), 9) + 0.0 AS g FROM ch WHERE dw IS NOT NULL AND p = {TEST} GROUP BY 1"


def _z_sql(cols: list[str], source: str) -> str:
    med = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in cols)
    fill = ", ".join(f"coalesce(s.{c}, m.{c}) AS {c}" for c in cols)
    st = ", ".join(f"avg({c}) AS {c}_a, stddev_samp({c}) AS {c}_s" for c in cols)
    z = ", ".join(f"round(CASE WHEN coalesce({c}_s, 0) = 0 THEN 0 ELSE ({c} - {c}_a) / {c}_s END, 6) + 0.0 AS {c}" for c in cols)
    return f"src AS ({source}), m AS (SELECT {med} FROM src), fl AS (SELECT s.cusip, {fill} FROM src s, m), st AS (SELECT {st} FROM fl), zs AS (SELECT cusip, {z} FROM fl, st)"


ONE["zscore_features"] = ", " + _z_sql(RATIOS, f"SELECT * FROM fd WHERE p = {TEST}") + " SELECT * FROM zs"


FUND = f"""SELECT coalesce(a.cik, n.cik) AS cusip, ln(greatest(coalesce(a.total, (SELECT quantile_cont(total, 0.5) FROM aum WHERE p = {TEST})), 1)) AS log_aum, coalesce(n.n, 0) AS n_holdings, coalesce(f.profit, 0) AS profit
  FROM (SELECT * FROM aum WHERE p = {TEST}) a FULL JOIN (SELECT cik, count(*) AS n FROM te GROUP BY 1) n ON n.cik = a.cik
  LEFT JOIN (SELECT nh.cik, sum(weight * log_return) AS profit FROM nh JOIN ret ON ret.cusip = nh.cusip AND ret.p = nh.p + 1 WHERE nh.p = {TEST - 1} GROUP BY 1) f ON f.cik = coalesce(a.cik, n.cik)"""


ONE["node_features"] = f", {ED}, " + _z_sql(["log_aum", "n_holdings", "profit"], FUND) + f" SELECT e.cik, coalesce(log_aum, 0) AS log_aum, coalesce(n_holdings, 0) AS n_holdings, coalesce(profit, 0) AS profit FROM (SELECT DISTINCT cik FROM te) e LEFT JOIN zs ON zs.cusip = e.cik, {ANY}"


ONE["edge_attr"] = f""", {ED}, x AS (SELECT b.cik, b.cusip, b.dw * ln(greatest(a.total, 1)) AS x FROM (SELECT cik, cusip, max(dw) AS dw FROM buys WHERE p = {TEST} GROUP BY 1, 2) b JOIN aum a ON a.cik = b.cik AND a.p = {TEST}),
s AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM x) SELECT cik, cusip, round((x - m) / s, 6) + 0.0 AS attr FROM x, s"""


ONE["temporal_stack"] = f"SELECT cusip, count(DISTINCT CASE WHEN p = {FIRST} THEN cik END) AS slot_0, count(DISTINCT CASE WHEN p = {FIRST + 1} THEN cik END) AS slot_1, count(DISTINCT CASE WHEN p = {FIRST + 2} THEN cik END) AS slot_2 FROM buys WHERE p BETWEEN {FIRST} AND {LASTQ} GROUP BY 1"


ONE["propagate_two_layers"] = f""", {ED}, k AS (SELECT 'f:' || cik AS a, 's:' || cusip AS b FROM ed), l0 AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
x0 AS (SELECT a AS node, CAST(count(*) AS DOUBLE) AS x FROM l0 GROUP BY 1), l1 AS (SELECT a, b FROM l0 UNION ALL SELECT node, node FROM x0), dg AS (SELECT a, count(*) AS d FROM l1 GROUP BY 1),
l AS MATERIALIZED (SELECT l1.a, l1.b, 1 / sqrt(x.d * y.d) AS n FROM l1 JOIN dg x ON x.a = l1.a JOIN dg y ON y.a = l1.b),
x1 AS (SELECT a AS node, sum(n * x) AS x FROM l JOIN x0 ON node = b GROUP BY 1), x2 AS (SELECT a AS node, sum(n * x) AS x FROM l JOIN x1 ON node = b GROUP BY 1)
SELECT node, round((x0.x + x1.x + x2.x) / 3, 6) AS x FROM x0 JOIN x1 USING (node) JOIN x2 USING (node), {ANY}"""


ONE["sage_aggregate"] = f""", w AS (SELECT cik, cusip, arg_max(dw, (p, dw)) AS dw FROM buys WHERE p BETWEEN {FIRST} AND {LASTQ} GROUP BY 1, 2)
SELECT w.cik, round(avg(price), 9) AS price, round(sum(dw * price) / sum(dw), 9) AS weighted_price FROM w JOIN px ON px.cusip = w.cusip AND px.p = {LASTQ}, {ANY} GROUP BY 1"""


HASH = "((({0}) * 7919) % 1000003)"
NUM = "CAST(right(cik, 7) AS BIGINT)"
LETTERS = " + ".join(f"ascii(substr(cusip, {i}, 1)) * {7 * i + 1}" for i in range(1, 10))  # a number of any cusip


ONE["neighbour_sample"] = f", {ED} SELECT cik, cusip FROM (SELECT cik, cusip, row_number() OVER (PARTITION BY cusip ORDER BY {HASH.format(f'{NUM} * 31 + 5')}, cik) AS rn FROM ed, {ANY}) WHERE rn <= 10"


ONE["two_hop_sample"] = f""", {ED}, hop1 AS (SELECT cik, cusip FROM (SELECT cik, cusip, row_number() OVER (PARTITION BY cusip ORDER BY {HASH.format(f'{NUM} * 31 + 5')}, cik) AS rn FROM ed) WHERE rn <= 20),
hop2 AS (SELECT cik, cusip FROM (SELECT cik, cusip, row_number() OVER (PARTITION BY cik ORDER BY {HASH.format(f'CAST(({LETTERS}) AS BIGINT) * 31 + 5')}, cusip) AS rn FROM ed) WHERE rn <= 10)
SELECT hop1.cusip AS seed, count(DISTINCT hop1.cik) AS filers, count(*) AS edges, count(DISTINCT hop2.cusip) AS securities FROM hop1 JOIN hop2 ON hop2.cik = hop1.cik, {ANY} GROUP BY 1"""


ONE["node_numbers"] = f", {ED} SELECT cik, row_number() OVER (ORDER BY cik) - 1 AS id FROM (SELECT DISTINCT cik FROM ed, {ANY})"


SHARED = "sh AS MATERIALIZED (SELECT * FROM te WHERE cik IN (SELECT cik FROM ed) AND cusip IN (SELECT cusip FROM ed))"


ONE["shared_universe"] = f", {ED}, {SHARED} SELECT count(DISTINCT cik) AS funds, count(DISTINCT cusip) AS stocks, count(*) AS edges FROM sh, {ANY}"


ONE["target_pairs"] = f", {ED}, {SHARED} SELECT cik, cusip FROM sh, {ANY}"


ONE["new_edges"] = f", {ED}, {SHARED} SELECT cik, cusip FROM sh, {ANY} WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.cik = sh.cik AND ed.cusip = sh.cusip)"


NEG = f"""na AS (SELECT cik, row_number() OVER (ORDER BY cik) - 1 AS a FROM (SELECT DISTINCT cik FROM ed)), nb AS MATERIALIZED (SELECT cusip, row_number() OVER (ORDER BY cusip) - 1 AS b FROM (SELECT DISTINCT cusip FROM ed)),
cand AS (SELECT DISTINCT cik, {HASH.format('a * 31 + t * 17 + 7')} % (SELECT count(*) FROM nb) AS b FROM na, (SELECT unnest(range(4)) AS t)),
ng AS MATERIALIZED (SELECT cik, cusip FROM cand JOIN nb USING (b) WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.cik = cand.cik AND ed.cusip = nb.cusip) AND NOT EXISTS (SELECT 1 FROM te WHERE te.cik = cand.cik AND te.cusip = nb.cusip))"""


ONE["negatives"] = f", {ED}, {NEG} SELECT cik, cusip FROM ng, {ANY}"


SPLIT = f"""o AS (SELECT cik, cusip, row_number() OVER (ORDER BY {HASH.format(NUM + " * 31 + (" + LETTERS + ") * 17 + 3")}, cik, cusip) - 1 AS i FROM ed),
n AS (SELECT count(*) AS n FROM o), sp AS MATERIALIZED (SELECT cik, cusip, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS part FROM o, n)"""


ONE["split_80_10_10"] = f", {ED}, {SPLIT} SELECT cik, cusip, part FROM sp, {ANY}"


ONE["split_repair"] = f", {ED}, {SPLIT} SELECT cik, cusip, CASE WHEN cik IN (SELECT cik FROM sp WHERE part = 'train') AND cusip IN (SELECT cusip FROM sp WHERE part = 'train') THEN part ELSE 'train' END AS part FROM sp, {ANY}"


EVAL = f"{ED}, {SHARED}, {NEG}, ev AS MATERIALIZED (SELECT cik, cusip, 1 AS label FROM sh UNION ALL SELECT cik, cusip, 0 FROM ng)"
DEG = "df AS (SELECT cik, count(*) AS d FROM ed GROUP BY 1), ds AS (SELECT cusip, count(*) AS d FROM ed GROUP BY 1)"


AA = f"""{EVAL}, {PAIRS}, {DEG}, aw AS (SELECT cik, CASE WHEN d > 1 THEN 1 / ln(d) ELSE 0 END AS w FROM df),
raw AS MATERIALIZED (SELECT ev.cik, ev.cusip, ev.label, coalesce(sum(common * w), 0) AS raw FROM ev LEFT JOIN ed x ON x.cusip = ev.cusip AND x.cik <> ev.cik LEFT JOIN pr ON pr.a = ev.cik AND pr.b = x.cik LEFT JOIN aw ON aw.cik = x.cik GROUP BY 1, 2, 3)"""
JC = f"""{EVAL}, {PAIRS}, {DEG}, j AS (SELECT a, b, common / (x.d + y.d - common) AS j FROM pr JOIN df x ON x.cik = a JOIN df y ON y.cik = b),
raw AS MATERIALIZED (SELECT ev.cik, ev.cusip, ev.label, CASE WHEN count(x.cik) = 0 THEN 0 ELSE coalesce(sum(j), 0) / count(x.cik) END AS raw FROM ev LEFT JOIN ed x ON x.cusip = ev.cusip AND x.cik <> ev.cik LEFT JOIN j ON j.a = ev.cik AND j.b = x.cik GROUP BY 1, 2, 3)"""
PA = f"{EVAL}, {DEG}, raw AS MATERIALIZED (SELECT ev.cik, ev.cusip, ev.label, CAST(coalesce(df.d, 0) * coalesce(ds.d, 0) AS DOUBLE) AS raw FROM ev LEFT JOIN df ON df.cik = ev.cik LEFT JOIN ds ON ds.cusip = ev.cusip)"
SCORE = f" SELECT cik, cusip, round(raw / (SELECT max(raw) FROM raw), 6) AS score FROM raw, {ANY}"


ONE["adamic_adar"] = f", {AA}{SCORE}"


ONE["jaccard_link"] = f", {JC}{SCORE}"


ONE["pref_attachment"] = f", {PA}{SCORE}"


ONE["persistence"] = f", {EVAL} SELECT cik, cusip, CAST(EXISTS (SELECT 1 FROM buys WHERE buys.cik = ev.cik AND buys.cusip = ev.cusip AND p = {LASTQ}) AS DOUBLE) AS score FROM ev"


ONE["popularity"] = f", n AS (SELECT cusip, count(*) AS n FROM (SELECT DISTINCT p, cik, cusip FROM buys WHERE p BETWEEN {FIRST} AND {LASTQ}) GROUP BY 1) SELECT cusip, n, round(n / (SELECT max(n) FROM n), 6) AS prob, n >= (SELECT quantile_cont(n, 0.9) FROM n) AS popular FROM n"


SC = f"{PA}, sc AS MATERIALIZED (SELECT cik, cusip, label, raw / (SELECT max(raw) FROM raw) AS score FROM raw)"


ONE["auc"] = f", {SC}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM sc) SELECT round((sum(rk * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS auc FROM r, {ANY}"


CURVE = f"{SC}, lv AS (SELECT score, sum(label) AS pos, count(*) AS c FROM sc, {ANY} GROUP BY 1), cv AS (SELECT score, pos, sum(pos) OVER w / sum(c) OVER w AS pre, sum(pos) OVER w / (SELECT sum(pos) FROM lv) AS rec FROM lv WINDOW w AS (ORDER BY score DESC))"


ONE["avg_precision"] = f", {CURVE} SELECT round(sum(pre * pos) / sum(pos), 6) AS ap FROM cv"


ONE["best_f1"] = f", {CURVE}, f AS (SELECT score, round(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END, 12) AS f1, pre, rec FROM cv) SELECT round(f1, 6) AS f1, round(score, 9) AS threshold, round(pre, 6) AS precision, round(rec, 6) AS recall FROM f ORDER BY f.f1 DESC, f.score LIMIT 1"


ONE["precision_recall_at"] = f", {SC} SELECT round(sum(CASE WHEN score >= 0.05 THEN label ELSE 0 END) / sum(CASE WHEN score >= 0.05 THEN 1 ELSE 0 END), 6) AS precision, round(sum(CASE WHEN score >= 0.05 THEN label ELSE 0 END) / sum(label), 6) AS recall FROM sc, {ANY}"


def _ndcg_sql(ks: tuple[int, ...]) -> str:
    per = ", ".join(f"max(CASE WHEN rn <= {k} AND label = 1 THEN 1.0 ELSE 0 END) AS h{k}, sum(CASE WHEN rn <= {k} AND label = 1 THEN 1 / log2(rn + 1) ELSE 0 END) / list_sum(list_transform(range(1, least({k}, max(np)) + 1), lambda x: 1 / log2(x + 1))) AS n{k}" for k in ks)
    out = ", ".join(f"round(avg(h{k}), 6) AS hit_{k}, round(avg(n{k}), 6) AS ndcg_{k}" for k in ks)
    return f", {SC}, rr AS (SELECT cik, label, row_number() OVER (PARTITION BY cik ORDER BY score DESC, cusip) AS rn, CAST(sum(label) OVER (PARTITION BY cik) AS BIGINT) AS np FROM sc), pg AS (SELECT cik, {per} FROM rr WHERE np > 0 GROUP BY 1) SELECT {out}, count(*) AS groups FROM pg, {ANY}"


ONE["hit_ndcg"] = _ndcg_sql((5, 10))


ONE["top_k_per_fund"] = f", {SC} SELECT cik, cusip, rn AS rank FROM (SELECT cik, cusip, row_number() OVER (PARTITION BY cik ORDER BY score DESC, cusip) AS rn FROM sc, {ANY}) WHERE rn <= 3"


def _unseen_sql(group: str, item: str, k: int) -> str:
    return f""", {ED}, {DEG}, a AS (SELECT df.cik, ds.cusip, df.d * ds.d AS s, row_number() OVER (PARTITION BY {group} ORDER BY df.d * ds.d DESC, {item}) AS rank FROM df, ds, {ANY} WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.cik = df.cik AND ed.cusip = ds.cusip))
SELECT cik, cusip, CAST(s AS DOUBLE) AS score, rank FROM a WHERE rank <= {k}"""


ONE["unseen_per_fund"] = _unseen_sql("df.cik", "ds.cusip", 10)
ONE["unseen_per_stock"] = _unseen_sql("ds.cusip", "df.cik", 5)
ONE["hit_unseen"] = _unseen_sql("df.cik", "ds.cusip", 10).replace("SELECT cik, cusip, CAST(s AS DOUBLE)", ", top AS (SELECT cik, cusip, CAST(s AS DOUBLE)").rstrip() + f"""), {SHARED},
nw AS (SELECT cik, cusip FROM sh WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.cik = sh.cik AND ed.cusip = sh.cusip)), np AS (SELECT cik, count(*) AS np FROM nw GROUP BY 1),
pg AS (SELECT np.cik, np.np, max(CASE WHEN nw.cusip IS NOT NULL THEN 1.0 ELSE 0 END) AS h, sum(CASE WHEN nw.cusip IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(10, np.np) + 1), lambda x: 1 / log2(x + 1))) AS n
  FROM np LEFT JOIN top ON top.cik = np.cik LEFT JOIN nw ON nw.cik = top.cik AND nw.cusip = top.cusip GROUP BY 1, 2)
SELECT round(avg(h), 6) AS hit_10, round(avg(n), 6) AS ndcg_10, count(*) AS groups FROM pg HAVING count(*) > 0"""


# ---------------------------------------------------------------- plans of all windows


def _name(key: str, win: str) -> Column:
    return F.concat(F.lpad(F.col(win).cast("string"), WIDTH, "0"), F.lit("|"), F.col(key)).alias(key)


def _win(key: str) -> Column:
    return F.substring(key, 1, WIDTH).cast("bigint")


def _bare(key: str) -> Column:
    return F.expr(f"substring({key}, {WIDTH + 2})")


def _plain(df: DataFrame, *keys: str, win: str = "win") -> DataFrame:
    """The window as a column, the names as they were."""
    rest = [c for c in df.columns if c not in keys and c != win]
    return df.select(_win(keys[0]).alias(win), *[_bare(k).alias(k) for k in keys], *rest)


def _number() -> Column:
    """A number of a filer that any engine can compute."""
    return F.substring("cik", WIDTH + 5, 7).cast("bigint")


def _spelt() -> Column:
    """The same of a security."""
    return F.expr(re.sub(r"substr\(cusip, (\d)", lambda m: f"substr(cusip, {int(m[1]) + WIDTH + 1}", LETTERS)).cast("bigint")


class Windows:
    def __init__(self, spark: SparkSession, d: str, k: int = 3) -> None:
        self.base = Base(spark, d)
        buys = self.base.buys()
        w = written(L.windows(buys.select("p"), k), "windows")
        last = w.filter("role = 'train'").groupBy("window").agg(F.max("p").alias("last"))
        slot = F.row_number().over(W.partitionBy("window").orderBy("p")) - 1  # a few rows per window
        self.quarters = w.withColumn("slot", slot).join(last, "window")
        both = buys.join(F.broadcast(self.quarters), "p")  # a few rows per quarter
        self.rows = written(both.select(_name("cik", "window"), _name("cusip", "window"), "p", "dw", "role", "slot", (F.col("p") == F.col("last")).alias("last")), "window-rows")
        self.train, self.test = self.rows.filter("role = 'train'"), G.edges(self.rows.filter("role = 'test'"))
        self._e: DataFrame | None = None
        self._pairs: DataFrame | None = None

    @property
    def e(self) -> DataFrame:
        if self._e is None:
            self._e = written(G.edges(self.train), "window-edges")
        return self._e

    def numbered(self, key: str, name: str) -> DataFrame:
        n = written(G.number_nodes(self.e, key).withColumn("w", _win(key)), "numbers")
        return n.join(n.groupBy("w").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n")), "w").select(key, "w", (F.col("id") - F.col("lo")).alias(name), "n")

    def negatives(self) -> DataFrame:
        return L.negatives(self.numbered("cik", "a").drop("n"), self.numbered("cusip", "b"), self.e.union(self.test).distinct(), 4, 7, "w")

    def targets(self) -> DataFrame:
        return L.shared(self.test, self.e).select("cik", "cusip")

    def pairs(self) -> DataFrame:
        if self._pairs is None:
            self._pairs = written(self.targets().withColumn("label", F.lit(1)).unionByName(self.negatives().select("cik", "cusip").withColumn("label", F.lit(0))), "pairs")
        return self._pairs

    def scored(self) -> DataFrame:
        ev = self.pairs()
        return ev.join(L.preferential(ev, self.e, _win("cik")), ["cik", "cusip"]).withColumn("win", _win("cik"))

    def split(self) -> DataFrame:
        return L.split(self.e, L.hash_order(3, _number(), _spelt()), per=_win("cik"))


def _of_windows(name: str, make, value=None, keys: tuple[str, ...] = ("cik", "cusip")) -> None:
    """Registers ``name``_windows; ``value`` gives its further columns."""
    query(f"{name}_windows", _over(name, True))(lambda spark, d: _plain(make(Windows(spark, d)), *keys).select("win", *keys, *(value() if value else [])))


_of_windows("target_pairs", lambda w: w.targets())
_of_windows("new_edges", lambda w: L.new_edges(w.targets(), w.e))
_of_windows("negatives", lambda w: w.negatives())
_of_windows("combined_graph", lambda w: G.latest_edges(w.train, "dw"), lambda: [*rnd("dw", digits=9)])
_of_windows("fund_projection", lambda w: G.projection(w.e), lambda: ["common"], keys=("a", "b"))
_of_windows("adamic_adar", lambda w: L.adamic_adar(w.pairs(), w.e, _win("cik")), lambda: [*rnd("score")])
_of_windows("jaccard_link", lambda w: L.jaccard(w.pairs(), w.e, _win("cik")), lambda: [*rnd("score")])
_of_windows("pref_attachment", lambda w: L.preferential(w.pairs(), w.e, _win("cik")), lambda: [*rnd("score")])
_of_windows("persistence", lambda w: L.persistence(w.pairs(), w.train.filter("last")), lambda: ["score"])
_of_windows("pagerank", lambda w: G.pagerank(w.e, rounds=5, per=_win("node")), lambda: [*rnd("rank", digits=9)], keys=("node",))
_of_windows("hits", lambda w: G.hits(w.e, rounds=5, per=_win("node")), lambda: [*rnd("hub", digits=9)], keys=("node",))
_of_windows("communities", lambda w: G.communities(w.e), lambda: [_bare("community").alias("community")], keys=("node",))
_of_windows("closeness", lambda w: G.closeness(w.e, _win("node")), lambda: [*rnd("closeness", digits=9)], keys=("node",))
_of_windows("degree_centrality", lambda w: G.degree_centrality(w.e, _win("node")).withColumnRenamed("node", "cik"), lambda: [*rnd("centrality")], keys=("cik",))
_of_windows("node_numbers", lambda w: w.numbered("cik", "id"), lambda: big("id"), keys=("cik",))
_of_windows("neighbour_sample", lambda w: G.sample_neighbours(w.e, "cusip", "cik", 10, L.hash_order(5, _number())))
_of_windows("split_80_10_10", lambda w: w.split(), lambda: ["part"])
_of_windows("split_repair", lambda w: L.repair_split(w.split()), lambda: ["part"])


_of_windows("unseen_per_fund", lambda w: L.unseen_by_degree(w.e, "cik", "cusip", 10, _win), lambda: ["score", "rank"])
_of_windows("unseen_per_stock", lambda w: L.unseen_by_degree(w.e, "cusip", "cik", 5, _win), lambda: ["score", "rank"])


@query("hit_unseen_windows", _over("hit_unseen", True))
def hit_unseen(spark: SparkSession, d: str) -> DataFrame:
    """New edges among the ten best of all securities that a filer had no edge with, averaged over the filers with new edges."""
    w = Windows(spark, d)
    new = written(L.new_edges(w.targets(), w.e).withColumn("label", F.lit(1)), "new")
    top = L.unseen_by_degree(w.e, "cik", "cusip", 10, _win).join(new, ["cik", "cusip"], "left")
    gain = top.groupBy("cik").agg(F.max(F.coalesce(F.col("label"), F.lit(0)).cast("double")).alias("h"), F.sum(F.when(F.col("label") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    n = new.groupBy("cik").agg(F.count(F.lit(1)).alias("np"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("np").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    per = n.join(gain, "cik", "left").fillna(0.0, ["h", "dcg"])
    return per.groupBy(_win("cik").alias("win")).agg(F.round(F.avg("h"), 6).alias("hit_10"), F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg_10"), F.count(F.lit(1)).alias("groups"))


def _balanced(name: str, positives) -> None:
    @query(f"{name}_windows")
    def plan(spark: SparkSession, d: str) -> DataFrame:
        w = Windows(spark, d)
        pos = written(positives(w), "positives")
        neg = L.balanced_negatives(pos, w.numbered("cusip", "b"), w.e.union(w.test).distinct(), 7, "w")
        both = pos.select("cik", "cusip", F.lit(1).alias("label")).unionByName(neg.withColumn("label", F.lit(0)))
        return _plain(both, "cik", "cusip").select("win", "cik", "cusip", "label")


# positives: all test edges of the shared universe; the new ones of them
_balanced("test_set_all", lambda w: w.targets())
_balanced("test_set_new", lambda w: L.new_edges(w.targets(), w.e))


@query("degree_distribution_windows", _over("degree_distribution", True))
def degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(Windows(spark, d).e, "cik").groupBy(_win("cik").alias("win"), "degree").agg(F.count(F.lit(1)).alias("n"))


@query("degree_shares_windows", _over("degree_shares", True))
def degree_shares(spark: SparkSession, d: str) -> DataFrame:
    return G.degree_shares(Windows(spark, d).e, "cusip", _win("cusip")).select(F.col("per").alias("win"), *rnd("avg_degree", "above_avg", "above_twice"))


def _sides(df: DataFrame, *columns: str) -> DataFrame:
    """Names such as f:00003|x with the window as a column."""
    at = columns[0]
    cut = {c: F.concat(F.substring(c, 1, 2), F.expr(f"substring({c}, {WIDTH + 4})")) for c in columns}
    return df.withColumn("win", F.substring(at, 3, WIDTH).cast("bigint")).withColumns(cut)


@query("components_windows", _over("components", True))
def components(spark: SparkSession, d: str) -> DataFrame:
    return _sides(G.components(Windows(spark, d).e), "node", "component").select("win", "node", "component")


@query("modularity_windows", _over("modularity", True))
def modularity(spark: SparkSession, d: str) -> DataFrame:
    e = Windows(spark, d).e
    return G.modularity(e, G.communities(e), _win("node")).select(F.col("per").alias("win"), *rnd("modularity"))


@query("propagate_two_layers_windows", _over("propagate_two_layers", True))
def propagate_two_layers(spark: SparkSession, d: str) -> DataFrame:
    e = Windows(spark, d).e
    f = e.select(F.concat(F.lit("f:"), "cik").alias("node")).union(e.select(F.concat(F.lit("s:"), "cusip"))).groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("x"))
    return _sides(G.propagate(e, f, layers=2), "node").select("win", "node", *rnd("x"))


@query("sage_aggregate_windows", _over("sage_aggregate", True))
def sage_aggregate(spark: SparkSession, d: str) -> DataFrame:
    w = Windows(spark, d)
    last = w.quarters.filter("role = 'train' AND p = last").select("window", "p")
    price = w.base.px().join(F.broadcast(last), "p").select(_name("cusip", "window"), "price", F.col("price").alias("weighted_price"))
    e = G.latest_edges(w.train, "dw")
    plain, weighted = G.sage_mean(e, price, "cik", "cusip", ["price"]), G.sage_mean(e, price, "cik", "cusip", ["weighted_price"], "dw")
    return _plain(plain.join(weighted, "cik"), "cik").select("win", "cik", *rnd("price", "weighted_price", digits=9))


@query("two_hop_sample_windows", _over("two_hop_sample", True))
def two_hop_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fan-out 20, then 10, from every security; its sample's size."""
    e = Windows(spark, d).e
    got = G.sample_two_hops(e, e, 20, 10, L.hash_order(5, _number()), L.hash_order(5, _spelt()))
    n = got.groupBy("seed").agg(F.count_distinct("cik").alias("filers"), F.count(F.lit(1)).alias("edges"), F.count_distinct("cusip").alias("securities"))
    return _plain(n, "seed")


@query("temporal_stack_windows", _over("temporal_stack", True))
def temporal_stack(spark: SparkSession, d: str) -> DataFrame:
    e = Windows(spark, d).train.select("cusip", "cik", F.concat(F.lit("slot_"), "slot").alias("slot")).distinct()
    return _plain(e.groupBy("cusip").pivot("slot", ["slot_0", "slot_1", "slot_2"]).agg(F.count(F.lit(1))).fillna(0), "cusip")


@query("shared_universe_windows", _over("shared_universe", True))
def shared_universe(spark: SparkSession, d: str) -> DataFrame:
    t = Windows(spark, d).targets()
    side = lambda k, n: t.select(k).distinct().groupBy(_win(k).alias("win")).agg(F.count(F.lit(1)).alias(n))
    return side("cik", "funds").join(side("cusip", "stocks"), "win").join(t.groupBy(_win("cik").alias("win")).agg(F.count(F.lit(1)).alias("edges")), "win")


@query("popularity_windows", _over("popularity", True))
def popularity(spark: SparkSession, d: str) -> DataFrame:
    n = _plain(Windows(spark, d).train.select("p", "cik", "cusip").distinct().groupBy("cusip").agg(F.count(F.lit(1)).alias("n")), "cusip")
    s = n.groupBy("win").agg(F.percentile("n", F.lit(0.9)).alias("c"), F.max("n").alias("m"))
    return n.join(s, "win").select("win", "cusip", "n", F.round(F.col("n") / F.col("m"), 6).alias("prob"), (F.col("n") >= F.col("c")).alias("popular"))


# ---------------------------------------------------------------- metrics of the scores


@query("auc_windows", _over("auc", True))
def auc(spark: SparkSession, d: str) -> DataFrame:
    return M.auc(Windows(spark, d).scored(), "win").select("win", *rnd("auc"))


@query("avg_precision_windows", _over("avg_precision", True))
def avg_precision(spark: SparkSession, d: str) -> DataFrame:
    return M.average_precision(Windows(spark, d).scored(), "win").select("win", *rnd("ap"))


@query("best_f1_windows", _over("best_f1", True))
def best_f1(spark: SparkSession, d: str) -> DataFrame:
    return M.best_f1(Windows(spark, d).scored(), "win").select("win", *rnd("f1"), *rnd("threshold", digits=9), *rnd("precision", "recall"))


@query("precision_recall_at_windows", _over("precision_recall_at", True))
def precision_recall_at(spark: SparkSession, d: str) -> DataFrame:
    return M.at_threshold(Windows(spark, d).scored(), 0.05, "win").select("win", *rnd("precision", "recall"))


@query("hit_ndcg_windows", _over("hit_ndcg", True))
def hit_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return M.hit_ndcg(Windows(spark, d).scored(), "cik", "cusip", [5, 10], _win("cik").alias("win")).select("win", *rnd("hit_5", "ndcg_5", "hit_10", "ndcg_10"), "groups")


@query("top_k_per_fund_windows", _over("top_k_per_fund", True))
def top_k_per_fund(spark: SparkSession, d: str) -> DataFrame:
    return _plain(L.top_k(Windows(spark, d).scored(), "cik", "cusip", 3), "cik", "cusip").select("win", "cik", "cusip", "rank")


@query("learned_baselines_windows")
def learned_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve of the classifiers on held-out pairs of each window, with degrees and three scores as features."""
    from quarterloom.operators.baselines import fit_and_score

    w = Windows(spark, d)
    f = w.pairs()
    for n, s in (("aa", L.adamic_adar(f, w.e, _win("cik"))), ("jc", L.jaccard(f, w.e, _win("cik"))), ("pa", L.preferential(f, w.e, _win("cik")))):
        f = f.join(s.select("cik", "cusip", F.col("score").alias(n)), ["cik", "cusip"])
    f = written(f.withColumns({"part": F.pmod(F.xxhash64("cik", "cusip"), F.lit(5)), "win": _win("cik")}), "features")
    got = None
    for kind in ("logistic", "boosted", "perceptron"):
        scored = fit_and_score(f.filter("part > 0"), f.filter("part = 0"), ["aa", "jc", "pa"], kind)
        one = M.auc(scored, "win").select(F.lit(kind).alias("model"), "win", *rnd("auc"))
        got = one if got is None else got.unionByName(one)
    return got


@query("ranking_embeddings_windows")
def ranking_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings trained by pairwise ranking on the train quarters; area under the curve on the new edges of the test quarter."""
    w = Windows(spark, d)
    new = written(L.new_edges(w.targets(), w.e), "new")
    z = V.train(w.e, w.numbered("cusip", "b").withColumn("per", F.col("w")), _win)
    neg = L.balanced_negatives(new, w.numbered("cusip", "b"), w.e.union(w.test).distinct(), 7, "w")
    both = new.select("cik", "cusip", F.lit(1).alias("label")).unionByName(neg.withColumn("label", F.lit(0)))
    return M.auc(V.score(z, both).withColumn("win", _win("cik")), "win").select("win", *rnd("auc"))


# ---------------------------------------------------------------- every quarter


@query("rev2_goodness_quarters", _over("rev2_goodness", False))
def rev2_goodness(spark: SparkSession, d: str) -> DataFrame:
    e = Base(spark, d).ch().filter("dw IS NOT NULL").groupBy(_name("cik", "p"), _name("cusip", "p")).agg(F.avg("dw").alias("w"))
    got = _plain(G.rev2(e, rounds=4, tolerance=0)[1], "cusip", win="p")
    return got.select("p", "cusip", (F.round("g", 9) + 0.0).alias("goodness"))


@query("rev2_converged_quarters")
def rev2_converged(spark: SparkSession, d: str) -> DataFrame:
    """From the assets of the filers, until no value moves by a millionth."""
    b = Base(spark, d)
    e = b.ch().filter("dw IS NOT NULL").groupBy(_name("cik", "p"), _name("cusip", "p")).agg(F.avg("dw").alias("w"))
    aum = b.aum().select(_name("cik", "p"), "total")
    return _plain(G.rev2(e, aum=aum, per=_win("cik"))[1], "cusip", win="p").select("p", "cusip", F.round("g", 5).alias("goodness"))


@query("pagerank_converged_windows")
def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    return _plain(G.pagerank(Windows(spark, d).e, rounds=100, tolerance=1e-6, per=_win("node")), "node").select("win", "node", *rnd("rank"))


@query("goodness_baseline_quarters", _over("goodness_baseline", False))
def goodness_baseline(spark: SparkSession, d: str) -> DataFrame:
    return Base(spark, d).ch().filter("dw IS NOT NULL").groupBy(*big("p"), "cusip").agg((F.round(F.avg("dw"), 9) + 0.0).alias("g"))


@query("edge_attr_quarters", _over("edge_attr", False))
def edge_attr(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    e = b.buys().groupBy("p", "cik", "cusip").agg(F.max("dw").alias("dw"))
    x = written(e.join(b.aum(), ["cik", "p"]).select("p", "cik", "cusip", (F.col("dw") * F.ln(F.greatest("total", F.lit(1.0)))).alias("x")), "attributes")
    s = x.groupBy("p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return x.join(s, "p").select(*big("p"), "cik", "cusip", (F.round(F.try_divide(F.col("x") - F.col("m"), F.col("s")), 6) + 0.0).alias("attr"))


@query("zscore_features_quarters", _over("zscore_features", False))
def zscore_features(spark: SparkSession, d: str) -> DataFrame:
    return G.zscores(Base(spark, d).fd(), RATIOS, "p").select(*big("p"), "cusip", *rnd(*RATIOS))


@query("node_features_quarters", _over("node_features", False))
def node_features(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d).kept()
    te = b.buys().select("cik", "cusip", "p").distinct()
    aum = b.aum()
    med = aum.groupBy("p").agg(F.median("total").alias("med"))
    n = te.groupBy("cik", "p").agg(F.count(F.lit(1)).alias("n"))
    prof = G.profitability(b.nh(), b.ret()).select("cik", (F.col("p") + 1).alias("p"), "profit")
    f = aum.join(n, ["cik", "p"], "full_outer").join(med, "p", "left").join(prof, ["cik", "p"], "left")
    f = f.select("cik", "p", F.ln(F.greatest(F.coalesce("total", "med"), F.lit(1.0))).alias("log_aum"), F.coalesce("n", F.lit(0)).cast("double").alias("n_holdings"), F.coalesce("profit", F.lit(0.0)).alias("profit"))
    cols = ["log_aum", "n_holdings", "profit"]
    z = G.zscores(f, cols, "p").select("cik", "p", *rnd(*cols))
    return te.select("cik", "p").distinct().join(z, ["cik", "p"], "left").select(*big("p"), "cik", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])
