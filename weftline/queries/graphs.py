"""Significance (S), graphs (G), evaluation (E), rules (R) and joins of edge sets (J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import metrics as M
from weftline.operators import contingency as X
from weftline.operators import evaluate as V
from weftline.operators import graph as G
from weftline.operators import significance as S
from weftline.operators import spectral as L
from weftline.operators.lineage import cut
from weftline.plans import networks as P
from weftline.plans import rules as U

from .base import INC, TWO_BY_TWO, Registry, incidence, table
from .pairs import pairs
from .tables import _CLASS, classes

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
TAU = 0.0825
NAN = float("nan")
PAIR = ["network_id", "left_item", "right_item"]


def scored(spark, sf):
    return pairs(spark, sf).withColumnRenamed("stratum", "network_id").withColumn("similarity", F.round(M.jaccard(), 6))


def nodes(spark, sf):
    return incidence(spark, sf).select(F.col("stratum").alias("network_id"), F.col("item").alias("node")).distinct()


def graph(spark, sf):
    return G.threshold(scored(spark, sf), TAU).select(*PAIR, "similarity")


_SCORED = TWO_BY_TWO + ", sc AS (SELECT stratum AS network_id, left_item, right_item, a, b, c, d, fl, fr, n, round(a / (a + b + c), 6) AS similarity FROM t)"
_GRAPH = _SCORED + f""", e AS (SELECT network_id, left_item, right_item, similarity FROM sc WHERE similarity >= {TAU}), nd AS (SELECT DISTINCT stratum AS network_id, item AS node FROM inc),
mir AS (SELECT network_id, left_item AS u, right_item AS v, similarity AS w FROM e UNION ALL SELECT network_id, right_item, left_item, similarity FROM e),
deg AS (SELECT nd.network_id, node, count(u) AS degree, coalesce(sum(w), 0) AS strength FROM nd LEFT JOIN mir ON mir.network_id = nd.network_id AND u = node GROUP BY ALL)"""

_G2 = "2 * (" + " + ".join(f"({o} + .5) * ln(({o} + .5) * (n + 2.) / (({x} + 1.) * ({y} + 1.)))" for o, x, y in (("a", "a + b", "a + c"), ("b", "a + b", "b + d"), ("c", "c + d", "a + c"), ("d", "c + d", "b + d"))) + ")"


@R.add("s1_g_statistic", f"WITH {TWO_BY_TWO} SELECT stratum, left_item, right_item, round(greatest(0., {_G2}), 5) AS g FROM t")
def s1(spark, sf):
    return pairs(spark, sf).select("stratum", "left_item", "right_item", F.round(S.g_statistic(), 5).alias("g"))


def erfc_sql(x: str) -> str:
    """The complementary error function of a non-negative SQL expression: a series, and a continued product far out."""
    near = f"1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda k: (CASE WHEN k % 2 = 0 THEN 1. ELSE -1. END) * exp((2 * k + 1) * ln(greatest({x}, 1e-300)) - lgamma(k + 1)) / (2 * k + 1)))"
    far = f"exp(-({x}) * ({x})) / (({x}) * sqrt(pi())) * (1 - 1 / (2 * pow({x}, 2)) + 3 / (4 * pow({x}, 4)) - 15 / (8 * pow({x}, 6)) + 105 / (16 * pow({x}, 8)))"
    return f"CASE WHEN {x} < 3.5 THEN {near} ELSE {far} END"


@R.add("s1_g_test", f"WITH {TWO_BY_TWO}, g AS (SELECT *, sqrt(greatest(0., {_G2}) / 2) AS x FROM t), h AS (SELECT *, {erfc_sql('x')} AS p FROM g) SELECT stratum, left_item, right_item, round(CASE WHEN a * d > b * c THEN p / 2 ELSE 1 - p / 2 END, 7) AS p_value FROM h")
def s1p(spark, sf):
    return pairs(spark, sf).select("stratum", "left_item", "right_item", F.round(S.g_test_p("greater"), 7).alias("p_value"))


_LP = "(lgamma(fl + 1) - lgamma({k} + 1) - lgamma(fl - {k} + 1) + lgamma(n - fl + 1) - lgamma(fr - {k} + 1) - lgamma(n - fl - fr + {k} + 1) - lgamma(n + 1) + lgamma(fr + 1) + lgamma(n - fr + 1))"
_FISHER = TWO_BY_TWO + f""", k AS (SELECT t.*, unnest(range(greatest(0, fl + fr - n), least(fl, fr) + 1)) AS k FROM t),
fp AS (SELECT stratum, left_item, right_item, a, b, c, d, fl, fr, n, least(1., sum(exp({_LP.format(k='k')})) FILTER ({_LP.format(k='k')} <= {_LP.format(k='a')} + 1e-7)) AS p, least(1., sum(exp({_LP.format(k='k')})) FILTER (k >= a)) AS pg FROM k GROUP BY ALL)"""


@R.add("s2_fisher", f"WITH {_FISHER} SELECT stratum, left_item, right_item, round(p, 6) AS p_value FROM fp")
def s2(spark, sf):
    return pairs(spark, sf).select("stratum", "left_item", "right_item", F.round(S.fisher(), 6).alias("p_value"))


@R.add("s3_hypergeometric", f"WITH {_FISHER} SELECT stratum, left_item, right_item, round(pg, 6) AS p_value FROM fp")
def s3(spark, sf):
    return pairs(spark, sf).select("stratum", "left_item", "right_item", F.round(S.hypergeometric_sf(), 6).alias("p_value"))


_QSQL = """, r AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS m, row_number() OVER (PARTITION BY stratum ORDER BY p) AS i FROM fp),
q AS (SELECT *, least(1., min(p * m / i{f}) OVER (PARTITION BY stratum ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q_value FROM r)"""


@R.add("s4_benjamini_hochberg", f"WITH {_FISHER}{_QSQL.format(f='')} SELECT stratum, left_item, right_item, round(q_value, 5) AS q_value FROM q")
def s4(spark, sf):
    return S.adjusted(pairs(spark, sf).withColumn("p_value", S.fisher()), ["stratum"]).select("stratum", "left_item", "right_item", F.round("q_value", 5).alias("q_value"))


@R.add("s5_benjamini_yekutieli", f"WITH {_FISHER}{_QSQL.format(f=' * list_sum(list_transform(range(1, m + 1), lambda x: 1. / x))')} SELECT stratum, left_item, right_item, round(q_value, 5) AS q_value FROM q")
def s5(spark, sf):
    return S.adjusted(pairs(spark, sf).withColumn("p_value", S.fisher()), ["stratum"], method="by").select("stratum", "left_item", "right_item", F.round("q_value", 5).alias("q_value"))


@R.add("s6_bonferroni", f"WITH {_FISHER} SELECT stratum, left_item, right_item, round(least(1., p * count(*) OVER (PARTITION BY stratum)), 5) AS q_value FROM fp")
def s6(spark, sf):
    return S.adjusted(pairs(spark, sf).withColumn("p_value", S.fisher()), ["stratum"], method="bonferroni").select("stratum", "left_item", "right_item", F.round("q_value", 5).alias("q_value"))


@R.add("s7_metric_fdr", f"WITH {_FISHER}{_QSQL.format(f='')} SELECT stratum, left_item, right_item, round(CASE WHEN q_value <= .9 THEN a / (a + b + c) * (1 - q_value / .9) ELSE 0 END, 5) AS similarity_pruned FROM q")
def s7(spark, sf):
    edges = pairs(spark, sf).withColumn("similarity", M.jaccard())
    return S.fdr(edges, ["stratum"], S.fisher(), alpha=0.9, mode="soft").select("stratum", "left_item", "right_item", F.round("similarity_pruned", 5).alias("similarity_pruned"))


_PRUNED = _FISHER + f""", tst AS (SELECT *, a / (a + b + c) AS similarity, n >= 20 AND a >= 3 AND round(a / (a + b + c), 6) >= {TAU} AS ok FROM fp),
r AS (SELECT *, count(*) OVER (PARTITION BY stratum, ok) AS m, row_number() OVER (PARTITION BY stratum, ok ORDER BY p) AS i FROM tst),
q AS (SELECT *, CASE WHEN ok THEN least(1., min(p * m / i) OVER (PARTITION BY stratum, ok ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) END AS q_value FROM r)"""


@R.add("s8_pruned_edges", f"WITH {_PRUNED} SELECT stratum AS network_id, left_item, right_item, round(CASE WHEN ok THEN p END, 6) AS p_value, round(q_value, 5) AS q_value, coalesce(q_value <= .5, false) AS keep FROM q")
def s8(spark, sf):
    out = S.prune(scored(spark, sf), ["network_id"], alpha=0.5, tau=TAU)
    return out.select(*PAIR, F.round("p_value", 6).alias("p_value"), F.round("q_value", 5).alias("q_value"), "keep")


@R.add("s10_backbone")
def s10(spark, sf):
    return S.backbone(scored(spark, sf), ["network_id"], alpha=0.5).select(*PAIR, F.round("log_odds", 6).alias("log_odds"), F.round("q_value", 6).alias("q_value"), "gate", F.round("weight", 6).alias("weight"))


@R.add("s11_retention", f"WITH {_PRUNED} SELECT stratum AS network_id, count(*) AS n_edges, count(q_value) AS n_testable, count(*) FILTER (q_value <= .5) AS n_significant, round(count(*) FILTER (q_value <= .5) / count(q_value), 6) AS retention FROM q WHERE round(similarity, 6) >= {TAU} GROUP BY ALL")
def s11(spark, sf):
    return S.retention(S.prune(scored(spark, sf), ["network_id"], alpha=0.5, tau=TAU), ["network_id"], TAU).withColumn("retention", F.round("retention", 6))


@R.add("s12_raw_and_pruned", f"WITH {_PRUNED} SELECT stratum AS network_id, count(*) FILTER (round(similarity, 6) >= {TAU}) AS raw_edges, count(*) FILTER (q_value <= .5) AS pruned_edges FROM q GROUP BY ALL")
def s12(spark, sf):
    return P.raw_and_pruned(scored(spark, sf), TAU, alpha=0.5)


@R.add("g1_threshold_graph", f"WITH {_GRAPH} SELECT * FROM e")
def g1(spark, sf):
    return graph(spark, sf)


@R.add("g2_thinned", f"""WITH {_GRAPH}, k AS (SELECT *, row_number() OVER (PARTITION BY network_id, u ORDER BY w DESC, v) AS k FROM mir)
SELECT network_id, least(u, v) AS left_item, greatest(u, v) AS right_item, max(w) AS similarity FROM k WHERE k <= 3 GROUP BY ALL""")
def g2(spark, sf):
    return G.thin(graph(spark, sf), 3)


_COMMUNITY = "cm AS (SELECT DISTINCT stratum AS network_id, item AS node, substr(item, 1, 7) AS community FROM inc)"


def by_name(spark, sf):
    return nodes(spark, sf).withColumn("community", F.substring("node", 1, 7))


@R.add("g4_modularity", f"""WITH {_GRAPH}, {_COMMUNITY}, x AS (SELECT e.*, l.community AS cl, r.community AS cr FROM e JOIN cm l ON l.network_id = e.network_id AND l.node = left_item JOIN cm r ON r.network_id = e.network_id AND r.node = right_item),
mm AS (SELECT network_id, sum(similarity) AS m FROM x GROUP BY ALL), k AS (SELECT network_id, c, sum(s) AS k FROM (SELECT network_id, cl AS c, similarity AS s FROM x UNION ALL SELECT network_id, cr, similarity FROM x) GROUP BY ALL),
i AS (SELECT network_id, cl AS c, sum(similarity) AS w FROM x WHERE cl = cr GROUP BY ALL)
SELECT k.network_id, round(sum(coalesce(w, 0) / m - pow(k / (2 * m), 2)), 6) AS modularity FROM k JOIN mm USING (network_id) LEFT JOIN i ON i.network_id = k.network_id AND i.c = k.c GROUP BY ALL""")
def g4(spark, sf):
    return G.modularity(graph(spark, sf), by_name(spark, sf)).withColumn("modularity", F.round("modularity", 6))


@R.add("g6_components", f"""WITH RECURSIVE {_GRAPH}, reach AS (SELECT network_id, node, node AS other FROM nd UNION SELECT r.network_id, r.node, m.v FROM reach r JOIN mir m ON m.network_id = r.network_id AND m.u = r.other)
SELECT network_id, node, min(other) AS component FROM reach GROUP BY ALL""")
def g6(spark, sf):
    return G.components(nodes(spark, sf), graph(spark, sf))


@R.add("g7_degrees", f"WITH {_GRAPH} SELECT network_id, node, degree, round(strength, 6) AS strength, round(degree / (count(*) OVER (PARTITION BY network_id) - 1), 6) AS centrality FROM deg")
def g7(spark, sf):
    return G.degrees(nodes(spark, sf), graph(spark, sf)).select("network_id", "node", "degree", F.round("strength", 6).alias("strength"), F.round("centrality", 6).alias("centrality"))


@R.add("g8_clustering", f"""WITH {_GRAPH}, n1 AS (SELECT network_id, left_item, right_item, similarity / max(similarity) OVER (PARTITION BY network_id) AS w FROM e),
tr AS (SELECT p.network_id, p.left_item AS x, p.right_item AS y, q.right_item AS z, cbrt(p.w * q.w * r.w) AS g FROM n1 p JOIN n1 q ON q.network_id = p.network_id AND q.left_item = p.right_item JOIN n1 r ON r.network_id = p.network_id AND r.left_item = p.left_item AND r.right_item = q.right_item),
att AS (SELECT network_id, node, count(*) AS t, sum(g) AS tg FROM (SELECT network_id, unnest([x, y, z]) AS node, g FROM tr) GROUP BY ALL)
SELECT deg.network_id, round(avg(CASE WHEN degree > 1 THEN 2. * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END), 6) AS clustering, round(avg(CASE WHEN degree > 1 THEN 2. * coalesce(tg, 0) / (degree * (degree - 1)) ELSE 0 END), 6) AS weighted_clustering
FROM deg LEFT JOIN att ON att.network_id = deg.network_id AND att.node = deg.node GROUP BY ALL""")
def g8(spark, sf):
    out = G.clustering(nodes(spark, sf), graph(spark, sf))
    return out.select("network_id", F.round("clustering", 6).alias("clustering"), F.round("weighted_clustering", 6).alias("weighted_clustering"))


@R.add("g9_summary", f"""WITH {_GRAPH}, s AS (SELECT network_id, count(*) AS n_nodes, CAST(sum(degree) / 2 AS BIGINT) AS n_edges, round(avg(degree), 6) AS mean_degree, round(avg(strength), 6) AS mean_strength FROM deg GROUP BY ALL),
a AS (SELECT mir.network_id, round(corr(x.degree, y.degree), 6) AS assortativity FROM mir JOIN deg x ON x.network_id = mir.network_id AND x.node = u JOIN deg y ON y.network_id = mir.network_id AND y.node = v GROUP BY ALL)
SELECT s.*, round(2 * n_edges / (n_nodes * (n_nodes - 1)), 6) AS density, assortativity FROM s LEFT JOIN a USING (network_id)""")
def g9(spark, sf):
    out = G.summary(nodes(spark, sf), graph(spark, sf))
    return out.select("network_id", "n_nodes", "n_edges", *[F.round(c, 6).alias(c) for c in ("mean_degree", "mean_strength", "density", "assortativity")])


@R.add("g10_paths", f"""WITH RECURSIVE {_GRAPH}, walk AS (SELECT network_id, u AS s, v AS t, 1 AS hops FROM mir UNION SELECT w.network_id, w.s, m.v, hops + 1 FROM walk w JOIN mir m ON m.network_id = w.network_id AND m.u = w.t WHERE hops < (SELECT count(DISTINCT node) FROM nd) AND m.v <> w.s)
SELECT network_id, round(avg(h), 6) AS mean_hops, max(h) AS diameter, count(*) AS pairs FROM (SELECT network_id, s, t, min(hops) AS h FROM walk GROUP BY ALL) GROUP BY ALL""")
def g10(spark, sf):
    return G.paths(graph(spark, sf)).groupBy("network_id").agg(F.round(F.avg("hops"), 6).alias("mean_hops"), F.max("hops").alias("diameter"), F.count("*").alias("pairs"))


@R.add("g10_betweenness", f"""WITH RECURSIVE {_GRAPH}, walk AS (SELECT network_id, u AS s, v AS t, 1 AS h, CAST(1 AS DOUBLE) AS r FROM mir UNION ALL SELECT b.network_id, b.s, m.v, h + 1, sum(r) FROM walk b JOIN mir m ON m.network_id = b.network_id AND m.u = b.t WHERE m.v <> b.s AND h < (SELECT count(DISTINCT node) FROM nd) GROUP BY b.network_id, b.s, m.v, h),
sp AS (SELECT network_id, s, t, min(h) AS h, arg_min(r, h) AS r FROM walk GROUP BY ALL), th AS (SELECT a.network_id, a.t AS node, sum(a.r * b.r / c.r) AS x FROM sp a JOIN sp b ON b.network_id = a.network_id AND b.s = a.t AND b.t <> a.s JOIN sp c ON c.network_id = a.network_id AND c.s = a.s AND c.t = b.t AND c.h = a.h + b.h GROUP BY ALL),
sz AS (SELECT network_id, count(*) AS n FROM nd GROUP BY ALL) SELECT nd.network_id, nd.node, round(CASE WHEN n > 2 THEN coalesce(x, 0) / ((n - 1) * (n - 2)) ELSE 0 END, 9) AS betweenness FROM nd JOIN sz USING (network_id) LEFT JOIN th ON th.network_id = nd.network_id AND th.node = nd.node""")
def g10b(spark, sf):
    return G.betweenness(nodes(spark, sf), graph(spark, sf)).select("network_id", "node", F.round("betweenness", 9).alias("betweenness"))


@R.add("g10_weighted_paths", f"""WITH RECURSIVE {_GRAPH}, best AS (SELECT network_id, u AS s, v AS t, w AS d, 1 AS k FROM mir UNION ALL SELECT network_id, s, t, min(d), k + 1 FROM (SELECT network_id, s, t, d, k FROM best UNION ALL SELECT b.network_id, b.s, m.v, b.d + m.w, k FROM best b JOIN mir m ON m.network_id = b.network_id AND m.u = b.t WHERE m.v <> b.s) x WHERE k < (SELECT count(DISTINCT node) FROM nd) GROUP BY network_id, s, t, k),
sd AS (SELECT network_id, s, t, min(d) AS d FROM best GROUP BY ALL), re AS (SELECT network_id, s, count(*) + 1 AS size, least(min(t), s) AS root FROM sd GROUP BY network_id, s), lc AS (SELECT network_id, arg_min(root, (-size, root)) AS root, max(size) AS size FROM re GROUP BY ALL)
SELECT sd.network_id, lc.size, round(avg(d), 6) AS mean, round(max(d), 6) AS longest FROM sd JOIN re USING (network_id, s) JOIN lc ON lc.network_id = sd.network_id AND lc.root = re.root GROUP BY ALL""")
def g10w(spark, sf):
    out = G.path_summary(G.weighted_paths(graph(spark, sf)))
    return out.select("network_id", "size", F.round("mean", 6).alias("mean"), F.round("longest", 6).alias("longest"))


@R.add("g10_weighted_betweenness", f"""WITH RECURSIVE {_GRAPH}, best AS (SELECT network_id, u AS s, v AS t, w AS d, 1 AS k FROM mir UNION ALL SELECT network_id, s, t, min(d), k + 1 FROM (SELECT network_id, s, t, d, k FROM best UNION ALL SELECT b.network_id, b.s, m.v, round(b.d + m.w, 9), k FROM best b JOIN mir m ON m.network_id = b.network_id AND m.u = b.t WHERE m.v <> b.s) x WHERE k < (SELECT count(DISTINCT node) FROM nd) GROUP BY network_id, s, t, k),
sd AS MATERIALIZED (SELECT network_id, s, t, min(d) AS d FROM best GROUP BY ALL UNION ALL SELECT DISTINCT network_id, u, u, 0 FROM mir), dag AS MATERIALIZED (SELECT a.network_id, a.s, a.t AS v, b.t AS t FROM sd a JOIN mir m ON m.network_id = a.network_id AND m.u = a.t JOIN sd b ON b.network_id = a.network_id AND b.s = a.s AND b.t = m.v AND round(a.d + m.w, 9) = b.d),
wk AS (SELECT DISTINCT network_id, u AS s, u AS t FROM mir UNION ALL SELECT wk.network_id, wk.s, dag.t FROM wk JOIN dag ON dag.network_id = wk.network_id AND dag.s = wk.s AND dag.v = wk.t), sp AS (SELECT sd.network_id, s, t, d, r FROM sd JOIN (SELECT network_id, s, t, count(*) AS r FROM wk GROUP BY ALL) USING (network_id, s, t) WHERE s <> t),
th AS (SELECT a.network_id, a.t AS node, sum(a.r * b.r / c.r) AS x FROM sp a JOIN sp b ON b.network_id = a.network_id AND b.s = a.t AND b.t <> a.s JOIN sp c ON c.network_id = a.network_id AND c.s = a.s AND c.t = b.t AND abs(c.d - a.d - b.d) < 1e-9 GROUP BY ALL),
sz AS (SELECT network_id, count(*) AS n FROM nd GROUP BY ALL) SELECT nd.network_id, nd.node, round(CASE WHEN n > 2 THEN coalesce(x, 0) / ((n - 1) * (n - 2)) ELSE 0 END, 9) AS betweenness FROM nd JOIN sz USING (network_id) LEFT JOIN th ON th.network_id = nd.network_id AND th.node = nd.node""")
def g10wb(spark, sf):
    out = G.betweenness(nodes(spark, sf), graph(spark, sf), weighted=True)
    return out.select("network_id", "node", F.round("betweenness", 9).alias("betweenness"))


@R.add("g11_homophily", f"""WITH {_GRAPH}, {_CLASS}, x AS (SELECT e.*, coalesce(l.item_group = r.item_group, false) AS same FROM e LEFT JOIN cls l ON l.item = left_item LEFT JOIN cls r ON r.item = right_item)
SELECT network_id, round(avg(similarity) FILTER (same), 6) AS within_weight, round(avg(similarity) FILTER (NOT same), 6) AS across_weight, round(avg(CAST(same AS INTEGER)), 6) AS within_share FROM x GROUP BY ALL""")
def g11(spark, sf):
    out = G.homophily(graph(spark, sf), classes(spark, sf).withColumnRenamed("item_group", "label"))
    return out.select("network_id", *[F.round(c, 6).alias(c) for c in ("within_weight", "across_weight", "within_share")])


@R.add("g12_top_edges", f"WITH {_SCORED} SELECT network_id, left_item, right_item, similarity, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY similarity DESC, left_item, right_item) AS k FROM sc) WHERE k <= 10")
def g12(spark, sf):
    return X.edge_list(scored(spark, sf), F.col("similarity"), ["network_id"], topk=10).select(*PAIR, "similarity", "rank")


_ALIGNED = f"""{_SCORED}, s8 AS (SELECT network_id, left_item, right_item, similarity FROM sc WHERE similarity >= .08), nn AS (SELECT DISTINCT network_id FROM s8), pr AS (SELECT x.network_id AS first, y.network_id AS second FROM nn x JOIN nn y ON x.network_id < y.network_id),
al AS (SELECT first, second, left_item, right_item, coalesce(max(similarity) FILTER (network_id = first), 0) AS x, coalesce(max(similarity) FILTER (network_id = second), 0) AS y FROM pr JOIN s8 ON network_id IN (first, second) GROUP BY ALL)"""


def aligned(spark, sf):
    return G.align_all(G.threshold(scored(spark, sf), 0.08))


@R.add("j6_aligned_edges", f"WITH {_ALIGNED} SELECT * FROM al")
def j6(spark, sf):
    return aligned(spark, sf)


def _compared(out):
    """As SQL has it, a quotient without edges and a correlation without spread are NaN."""
    out = out.withColumn("pearson", F.coalesce("pearson", F.lit(NAN)))
    return out.select("first", "second", *[F.round(c, 6).alias(c) for c in ("edge_jaccard", "pearson", "rmse")])


@R.add("g14_compare_edges", f"WITH {_ALIGNED} SELECT first, second, round(count(*) FILTER (x >= {TAU} AND y >= {TAU}) / count(*) FILTER (x >= {TAU} OR y >= {TAU}), 6) AS edge_jaccard, round(corr(x, y), 6) AS pearson, round(sqrt(avg(pow(x - y, 2))), 6) AS rmse FROM al GROUP BY ALL")
def g14(spark, sf):
    return _compared(G.compare_edges(aligned(spark, sf), TAU, ["first", "second"], empty=NAN))


@R.add("g13_compare_networks", f"""WITH {_SCORED}, ab AS (SELECT x.network_id AS first, y.network_id AS second, x.similarity AS x, y.similarity AS y FROM sc x JOIN sc y ON x.left_item = y.left_item AND x.right_item = y.right_item AND x.network_id < y.network_id)
SELECT first, second, round(count(*) FILTER (x >= {TAU} AND y >= {TAU}) / count(*) FILTER (x >= {TAU} OR y >= {TAU}), 6) AS edge_jaccard, round(corr(x, y), 6) AS pearson, round(sqrt(avg(pow(x - y, 2))), 6) AS rmse FROM ab GROUP BY ALL""")
def g13(spark, sf):
    return _compared(P.compare_all(scored(spark, sf), TAU, empty=NAN))


@R.add("g3_louvain")
def g3(spark, sf):
    runs = nodes(spark, sf).select("network_id").distinct().select("network_id", F.lit(1.0).alias("gamma"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seed"))
    return G.louvain(nodes(spark, sf), graph(spark, sf), runs)


@R.add("g5_power_iteration")
def g5(spark, sf):
    return L.power_iteration(graph(spark, sf), k=4)


@R.add("g5_spectral")
def g5_spectral(spark, sf):
    return L.partition(graph(spark, sf), k=4)


#: Two fixed partitions of the brands: by their first digit, and by the class of their parts.
_PARTS = f"{_CLASS}, pr AS (SELECT cm.network_id, item, community AS x, item_group AS y FROM cm JOIN cls ON item = node)"
_AGREE = """cells AS (SELECT network_id, x, y, count(*) AS c FROM pr GROUP BY ALL), px AS (SELECT network_id, x, sum(c) AS c FROM cells GROUP BY ALL), py AS (SELECT network_id, y, sum(c) AS c FROM cells GROUP BY ALL),
b AS (SELECT network_id, sum(c * (c - 1) / 2) AS p, sum(c) AS n, sum(c * ln(c)) AS l FROM cells GROUP BY ALL), bx AS (SELECT network_id, sum(c * (c - 1) / 2) AS p, sum(c * ln(c)) AS l FROM px GROUP BY ALL), byy AS (SELECT network_id, sum(c * (c - 1) / 2) AS p, sum(c * ln(c)) AS l FROM py GROUP BY ALL),
ag AS (SELECT b.network_id, (b.p - bx.p * byy.p / (n * (n - 1) / 2)) / ((bx.p + byy.p) / 2 - bx.p * byy.p / (n * (n - 1) / 2)) AS ari, ((ln(n) - bx.l / n) + (ln(n) - byy.l / n) - (ln(n) - b.l / n)) / (((ln(n) - bx.l / n) + (ln(n) - byy.l / n)) / 2) AS nmi, n FROM b JOIN bx USING (network_id) JOIN byy USING (network_id))"""


@R.add("e1_rand_index", f"WITH {INC}, {_COMMUNITY}, {_PARTS}, {_AGREE} SELECT network_id, round(ari, 6) AS ari, CAST(n AS BIGINT) AS n_labelled FROM ag")
def e1(spark, sf):
    out = V.against_labels(by_name(spark, sf), classes(spark, sf).withColumnRenamed("item_group", "label"), ["network_id"])
    return out.select("network_id", F.round("ari", 6).alias("ari"), "n_labelled")


@R.add("e2_mutual_information", f"WITH {INC}, {_COMMUNITY}, {_PARTS}, {_AGREE} SELECT network_id, round(nmi, 6) AS nmi FROM ag")
def e2(spark, sf):
    out = V.against_labels(by_name(spark, sf), classes(spark, sf).withColumnRenamed("item_group", "label"), ["network_id"])
    return out.select("network_id", F.round("nmi", 6).alias("nmi"))


_WITH_COM = f"{_SCORED}, {_COMMUNITY}, x AS (SELECT sc.*, l.community = r.community AS same, l.community AS cl, r.community AS cr FROM sc JOIN cm l ON l.network_id = sc.network_id AND l.node = left_item JOIN cm r ON r.network_id = sc.network_id AND r.node = right_item)"


@R.add("e3_cohesion", f"WITH {_WITH_COM} SELECT network_id, round(avg(similarity) FILTER (same), 6) AS within, round(avg(similarity), 6) AS overall, count(*) FILTER (same) AS n_within, count(*) AS n_pairs, round(avg(similarity) FILTER (same) / avg(similarity), 6) AS ics FROM x GROUP BY ALL")
def e3(spark, sf):
    out = V.cohesion(scored(spark, sf), by_name(spark, sf), ["network_id"])
    return out.select("network_id", "n_within", "n_pairs", *[F.round(c, 6).alias(c) for c in ("within", "overall", "ics")])


@R.add("e4_silhouette", f"""WITH {_WITH_COM}, d AS (SELECT network_id, left_item AS node, cl AS own, cr AS other, 1 - similarity AS d FROM x UNION ALL SELECT network_id, right_item, cr, cl, 1 - similarity FROM x),
ds AS (SELECT network_id, node, own, other, avg(d) AS d FROM d GROUP BY ALL), s AS (SELECT network_id, node, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM ds GROUP BY ALL)
SELECT s.network_id, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, (SELECT count(DISTINCT community) FROM cm WHERE cm.network_id = s.network_id) AS n_communities FROM s GROUP BY ALL""")
def e4(spark, sf):
    return V.silhouette(scored(spark, sf), by_name(spark, sf), ["network_id"]).withColumn("silhouette", F.round("silhouette", 6))


_SEEDS = "sd AS (SELECT DISTINCT stratum AS network_id, item AS node, s AS seed, CASE s WHEN 0 THEN substr(item, 1, 7) WHEN 1 THEN CAST(length(item) AS VARCHAR) ELSE substr(item, length(item), 1) END AS community FROM inc, (SELECT unnest([0, 1, 2]) AS s))"


@R.add("e5_stability", f"""WITH {INC}, {_SEEDS}, pr AS (SELECT a.network_id || '|' || a.seed || '|' || b.seed AS network_id, a.node AS item, a.community AS x, b.community AS y FROM sd a JOIN sd b ON a.network_id = b.network_id AND a.node = b.node AND a.seed < b.seed), {_AGREE.replace("(b.p - bx.p", "(CASE WHEN abs((bx.p + byy.p) / 2 - bx.p * byy.p / (n * (n - 1) / 2)) < 1e-12 THEN 1 ELSE 1 END) * (b.p - bx.p")}
SELECT split_part(network_id, '|', 1) AS network_id, round(avg(ari), 6) AS stability, count(*) AS seed_pairs FROM ag GROUP BY ALL""")
def e5(spark, sf):
    return V.stability(seeded(spark, sf), ["network_id"]).withColumn("stability", F.round("stability", 6))


@R.add("e6_hierarchical", f"WITH {INC}, {_COMMUNITY}, {_PARTS}, {_AGREE} SELECT network_id, round((.4 * nmi + .3 * ari) / .7, 6) AS hierarchical FROM ag")
def e6(spark, sf):
    out = V.against_labels(by_name(spark, sf), classes(spark, sf).withColumnRenamed("item_group", "label"), ["network_id"]).withColumn("who", F.lit(None).cast("double"))
    return V.hierarchical(out, {"nmi": 0.4, "ari": 0.3, "who": 0.3}).select("network_id", F.round("hierarchical", 6).alias("hierarchical"))


@R.add("e7_first_group", "SELECT p_brand AS item, min_by(p_type, p_type) AS label FROM part GROUP BY ALL")
def e7(spark, sf):
    groups = table(spark, sf, "part").groupBy(F.concat("p_type", F.lit("List")).alias("label")).agg(F.collect_set("p_brand").alias("items"), F.first("p_type").alias("position"))
    return V.first_group(groups)


#: A grid whose communities SQL knows: two metrics, two thresholds, and three fixed partitions in the place of seeds.
_GRID = f"""{_SCORED}, {_SEEDS}, gm AS (SELECT network_id, left_item, right_item, unnest(['jaccard', 'dice']) AS metric, unnest([round(a / (a + b + c), 6), round(2 * a / (2 * a + b + c), 6)]) AS v FROM sc),
gt AS (SELECT gm.*, tau, CASE WHEN v >= tau THEN v ELSE 0 END AS similarity FROM gm CROSS JOIN (SELECT CAST(unnest([0., .08]) AS DOUBLE) AS tau)),
gs AS (SELECT gt.network_id, metric, tau, l.seed, avg(similarity) FILTER (l.community = r.community) / avg(similarity) AS ics, count(*) FILTER (l.community = r.community AND similarity > 0) AS inner_edges FROM gt JOIN sd l ON l.network_id = gt.network_id AND l.node = left_item JOIN sd r ON r.network_id = gt.network_id AND r.node = right_item AND r.seed = l.seed GROUP BY ALL),
go AS (SELECT network_id, metric, tau, avg(ics) AS ics_mean, stddev_samp(ics) AS ics_std, avg(inner_edges) AS inner_edges_mean, stddev_samp(inner_edges) AS inner_edges_std FROM gs GROUP BY ALL)"""


def seeded(spark, sf):
    n = F.col("node")
    rows = nodes(spark, sf).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rows.withColumn("community", F.when(F.col("seed") == 0, F.substring(n, 1, 7)).when(F.col("seed") == 1, F.length(n).cast("string")).otherwise(F.substring(n, -1, 1)))


def grid_over_seeds(spark, sf):
    """Cohesion and edges within communities for every network, metric and threshold: means and deviations over the partitions."""
    keys = ["network_id", "metric", "tau"]
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(t).alias("tau"), F.round(M.METRICS[m](), 6).alias("v")) for m in ("jaccard", "dice") for t in (0.0, 0.08)])).alias("g")
    full = scored(spark, sf).select("network_id", "left_item", "right_item", values).select(*PAIR, "g.*")
    full = cut(full.select(*keys, "left_item", "right_item", F.when(F.col("v") >= F.col("tau"), F.col("v")).otherwise(0.0).alias("similarity")))
    runs = full.select(*keys).distinct().select(*keys, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seed"))
    communities = cut(runs.join(seeded(spark, sf), ["network_id", "seed"]).select(*keys, "seed", "node", "community"))
    keyed = cut(full.join(runs, keys))
    scores = V.cohesion(keyed, communities, [*keys, "seed"]).select(*keys, "seed", "ics")
    inner = V.cohesion(keyed.filter("similarity > 0"), communities, [*keys, "seed"]).select(*keys, "seed", F.col("n_within").alias("inner_edges"))
    return V.over_seeds(scores.join(inner, [*keys, "seed"]), keys, ["ics", "inner_edges"])


_GRID_COLUMNS = ("ics_mean", "ics_std", "inner_edges_mean", "inner_edges_std")
_GRID_SELECT = ", ".join(f"round({c}, 5) AS {c}" for c in _GRID_COLUMNS)


@R.add("e9_over_seeds", f"WITH {_GRID} SELECT network_id, metric, tau, {_GRID_SELECT} FROM go")
def e9(spark, sf):
    return grid_over_seeds(spark, sf).select("network_id", "metric", "tau", *[F.round(c, 5).alias(c) for c in _GRID_COLUMNS])


@R.add("e10_best_configuration", f"WITH {_GRID} SELECT network_id, metric, tau, round(ics_mean, 5) AS ics_mean, inner_edges_mean FROM go QUALIFY row_number() OVER (PARTITION BY network_id ORDER BY round(ics_mean, 5) DESC, inner_edges_mean DESC, metric, tau) = 1")
def e10(spark, sf):
    grid = grid_over_seeds(spark, sf).select("network_id", "metric", "tau", F.round("ics_mean", 5).alias("ics_mean"), "inner_edges_mean")
    return V.best_configuration(grid, ["network_id"], ["ics_mean", "inner_edges_mean"], ["metric", "tau"])


@R.add("e11_composition", f"WITH {INC}, {_COMMUNITY}, {_CLASS} SELECT network_id, node AS item, community, count(*) OVER (PARTITION BY network_id, community) AS size, count(*) OVER (PARTITION BY network_id) AS total, item_group AS label FROM cm LEFT JOIN cls ON item = node")
def e11(spark, sf):
    return V.composition(by_name(spark, sf), ["network_id"], classes(spark, sf).withColumnRenamed("item_group", "label"))


@R.add("e8_grid")
def e8(spark, sf):
    dims = classes(spark, sf).withColumnRenamed("item_group", "label")
    return P.grid_search(incidence(spark, sf), "stratum", dims, P.Grid())


@R.add("r1_pair_rules", f"""WITH {INC}, n AS (SELECT count(DISTINCT unit) AS n FROM inc), f AS (SELECT item, count(*) AS f FROM inc GROUP BY ALL),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS c FROM inc x JOIN inc y ON x.unit = y.unit AND x.item <> y.item GROUP BY ALL)
SELECT a AS antecedent, b AS consequent, round(c / n, 6) AS support, round(c / fa.f, 6) AS confidence, round(c * n / (fa.f * fb.f), 6) AS lift FROM p, n, f fa, f fb WHERE fa.item = a AND fb.item = b AND c / n >= .01 AND c / fa.f >= .1 AND c * n / (fa.f * fb.f) >= .9""")
def r1(spark, sf):
    out = U.pair_rules(X.pair_counts(incidence(spark, sf), [], complete=False), 0.01, 0.1, 0.9)
    return out.select("antecedent", "consequent", *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


_SETS = """f1 AS (SELECT {k} item AS a, count(*) AS f FROM inc GROUP BY ALL),
f2 AS (SELECT {kx} x.item AS a, y.item AS b, count(*) AS f FROM inc x JOIN inc y ON x.unit = y.unit AND x.item < y.item GROUP BY ALL),
f3 AS (SELECT {kx} x.item AS a, y.item AS b, z.item AS c, count(*) AS f FROM inc x JOIN inc y ON x.unit = y.unit AND x.item < y.item JOIN inc z ON z.unit = y.unit AND y.item < z.item GROUP BY ALL),
fs AS (SELECT {k} [a] AS s, f FROM f1 UNION ALL SELECT {k} [a, b], f FROM f2 UNION ALL SELECT {k} [a, b, c], f FROM f3)"""
#: Rules from itemsets of up to three items: every proper part of a set against the rest.
_RULES = _SETS + """, nn AS (SELECT {k} count(DISTINCT unit) AS n FROM inc GROUP BY ALL), sp AS (SELECT *, unnest(CASE len(s) WHEN 2 THEN [[s[1]], [s[2]]] ELSE [[s[1]], [s[2]], [s[3]], [s[1], s[2]], [s[1], s[3]], [s[2], s[3]]] END) AS p FROM fs WHERE len(s) > 1),
rl AS (SELECT {ks} array_to_string(p, ',') AS antecedent, array_to_string(list_filter(sp.s, lambda x: NOT list_contains(p, x)), ',') AS consequent, sp.f / n AS support, sp.f / fa.f AS confidence, sp.f * n / (fa.f * fc.f) AS lift
  FROM sp JOIN nn ON {jn} JOIN fs fa ON {ja} AND fa.s = p JOIN fs fc ON {jc} AND fc.s = list_filter(sp.s, lambda x: NOT list_contains(p, x)))"""


def _rules(out):
    sides = [F.concat_ws(",", c).alias(c) for c in ("antecedent", "consequent")]
    return out.select(*[c for c in out.columns if c == "stratum"], *sides, "support", "confidence", "lift")


@R.add("r1_itemsets", f"WITH {INC}, n AS (SELECT count(DISTINCT unit) AS n FROM inc), {_SETS.format(k='', kx='')} SELECT array_to_string(s, ',') AS items, f AS freq FROM fs, n WHERE f >= .001 * n")
def r1_sets(spark, sf):
    sets = U.frequent_itemsets(incidence(spark, sf), min_support=0.001, most_items=3)[1]
    return sets.select(F.concat_ws(",", "items").alias("items"), "freq")


@R.add("r1_rules_of_three", f"WITH {INC}, {_RULES.format(k='', kx='', ks='', jn='true', ja='true', jc='true')} SELECT antecedent, consequent, support, confidence, lift FROM rl WHERE support >= .001 AND confidence >= .1 AND lift >= 1")
def r1_three(spark, sf):
    return _rules(U.association_rules(incidence(spark, sf), 0.001, 0.1, 1.0, most_items=3))


@R.add("r2_rules_of_three", f"WITH {INC}, {_RULES.format(k='stratum,', kx='x.stratum,', ks='sp.stratum,', jn='nn.stratum = sp.stratum', ja='fa.stratum = sp.stratum', jc='fc.stratum = sp.stratum')} SELECT stratum, antecedent, consequent, support, confidence, lift FROM rl WHERE support >= .002 AND confidence >= .1 AND lift >= 1")
def r2_three(spark, sf):
    return _rules(U.association_rules(incidence(spark, sf), 0.002, 0.1, 1.0, most_items=3, strata=["stratum"]))


@R.add("r1_rules")
def r1_all(spark, sf):
    return U.association_rules(incidence(spark, sf), min_support=0.01, min_confidence=0.1, min_lift=0.9)


@R.add("r2_stratified_rules")
def r2(spark, sf):
    return U.association_rules(incidence(spark, sf), min_support=0.01, min_confidence=0.1, min_lift=1.0, strata=["stratum"])
