"""Operators against plain loops: names, paths, itemsets, spectra, ranks over ranges, folding, loading, and odd inputs throughout."""

import itertools
import math
import random
import time
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import domain, encode, metrics
from weftline.operators import compare, contingency, coverage, filters, graph, ordered, significance, spectral, temporal, trend
from weftline.plans import networks, rules
from weftline.sources import io


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect()), key=str)


# --- names
NAMES = ["ab", "axb", "acbd", "a", "b", "aa", "aaa", "ba", "penicillin g", "penicilin", "amoxicillin", "amoxycillin", "amox", "cefotaxim", "cefotaxime", "cefoxitin", "x", "xy", "yx", "é1", "e1", "😀a", "a😀b"]


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_names_alike_are_all_found(spark, least):
    rng = random.Random(int(least * 100))
    one = NAMES + ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    other = NAMES + ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    want = {(a, b) for a in one for b in other if SequenceMatcher(None, a, b, autojunk=False).ratio() >= least}
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = {tuple(r) for r in domain.alike_candidates(frame(one), frame(other), least).collect()}
    assert want <= got and len(got) < len(set(one)) * len(set(other)) / 2


def test_enriched_names(spark):
    items = spark.createDataFrame([("axb",), ("Ab!",), (None,), ("??",), ("zz",), ("zz",)], "item string")
    known = spark.createDataFrame([("ab", "L"), ("zy", "M"), ("...", "N")], "name string, label string")
    got = {r["item"]: (r["label"], r["how"]) for r in domain.enrich(items, known).collect()}
    assert got == {"axb": ("L", "similar"), "Ab!": ("L", "exact"), None: ("Not Set", "none"), "??": ("Not Set", "none"), "zz": ("Not Set", "none")}
    assert domain.enrich(items, known, least=0.5).filter("item = 'zz'").first()["label"] == "M"
    with pytest.raises(ValueError):
        domain.enrich(items, known, least=0)
    assert domain.enrich(items.limit(0), known).collect() == [] and domain.enrich(items, known.limit(0)).filter("how <> 'none'").isEmpty()


def test_domain_factors(spark):
    items = spark.createDataFrame([("COL - x",), ("NYS",), ("FUS",), ("new",), ("CIP",)], "item string")
    weights = domain.domain_weights(items)
    groups = {r["item"]: r["groups"] for r in weights.collect()}
    assert groups["NYS"] == "antifungal" and groups["FUS"] == "niche" and groups["new"] == ""
    f = {r["item"]: r["factor"] for r in domain.domain_factors(weights, mask=True).collect()}
    assert f["NYS"] == f["FUS"] == 0 and f["new"] == pytest.approx((1 + 0.2 / 3) * 1.1) and f["COL - x"] == pytest.approx((1 + 0.4 / 3) * 1.3)
    assert {r["factor"] for r in domain.domain_factors(weights).filter("item = 'NYS'").collect()} == {1.0}


# --- paths
def loop_betweenness(nodes, edges, weighted):
    """By all simple paths; of equal lengths those with the fewest edges of weight zero."""
    links = {}
    for a, b, w in edges:
        links.setdefault(a, []).append((b, w))
        links.setdefault(b, []).append((a, w))
    through = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        best, found, stack = None, [], [(s, (s,), 0.0, 0)]
        while stack:
            at, path, d, z = stack.pop()
            if at == t:
                key = (round(d, 9), z) if weighted else (len(path), 0)
                if best is None or key < best:
                    best, found = key, []
                if key == best:
                    found.append(path)
                continue
            stack += [(v, (*path, v), d + w, z + (w == 0)) for v, w in links.get(at, []) if v not in path]
        for path in found:
            for v in path[1:-1]:
                through[v] += 1 / len(found)
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in through.items()}


def networks_of(seed, sizes=(7, 6, 2)):
    rng, nodes, edges = random.Random(seed), {}, {}
    for k, n in enumerate(sizes):
        nodes[f"n{k}"] = [f"v{i}" for i in range(n)]
        edges[f"n{k}"] = [(f"v{i}", f"v{j}", rng.choice((0.0, 0.1, 0.1, 0.2, 0.3, 0.3))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
    return nodes, edges


@pytest.mark.parametrize(("weighted", "batches"), [(False, 1), (True, 2)])
def test_betweenness_equals_all_paths(spark, weighted, batches):
    nodes, edges = networks_of(4)
    got = graph.betweenness(spark.createDataFrame([(k, v) for k, vs in nodes.items() for v in vs], "network_id string, node string"), spark.createDataFrame([(k, *e) for k, es in edges.items() for e in es], "network_id string, left_item string, right_item string, similarity double"), weighted, batches)
    got = {(r.network_id, r.node): r.betweenness for r in got.collect()}
    for k in nodes:
        for v, x in loop_betweenness(nodes[k], edges[k], weighted).items():
            assert got[k, v] == pytest.approx(x, abs=1e-12), (k, v)


def test_betweenness_of_odd_networks(spark):
    nodes = spark.createDataFrame([("a", "x")], "network_id string, node string")
    edges = spark.createDataFrame([], "network_id string, left_item string, right_item string, similarity double")
    assert [tuple(r) for r in graph.betweenness(nodes, edges, weighted=True).collect()] == [("a", "x", 0.0)]
    assert graph.betweenness(nodes.limit(0), edges).collect() == []
    with pytest.raises(ValueError):
        graph.betweenness(nodes, spark.createDataFrame([("a", "x", "y", -1.0)], edges.schema), weighted=True)


def test_a_hub_makes_few_wedges(spark):
    """A star of 300 around a core of 12: by the degrees' order only the core makes pairs of edges."""
    core = [f"c{i:02}" for i in range(12)]
    edges = [("n", a, b, 1.0) for a, b in itertools.combinations(core, 2)] + [("n", "a_hub", c, 1.0) for c in core] + [("n", "a_hub", f"leaf{i}", 1.0) for i in range(300)]
    frame = spark.createDataFrame(edges, "network_id string, left_item string, right_item string, similarity double")
    _, pairs = graph._wedges(frame.withColumnRenamed("similarity", "w"))
    assert pairs.count() == math.comb(13, 3)
    nodes = spark.createDataFrame([("n", v) for v in {x for e in edges for x in e[1:3]}], "network_id string, node string")
    share = 12 + 2 * 66 / (312 * 311)
    got = graph.clustering(nodes, frame).first()
    assert got.clustering == pytest.approx(share / 313) and got.weighted_clustering == pytest.approx(share / 313)


# --- itemsets
def baskets(seed=3, n=400):
    rng, rows = random.Random(seed), []
    for u in range(n):
        stratum = rng.choice(("s", "t", None))
        for i in rng.sample("abcdefgh", rng.randrange(0, 6)):
            if i != "h" or rng.random() < 0.2:
                rows.append((stratum, u, i))
        if u % 3 == 0:
            rows += [(stratum, u, "a"), (stratum, u, "b"), (stratum, u, "a")]
    return rows + [("s", None, "a"), ("s", 9999, None)]


def loop_rules(rows, support, confidence, lift):
    out, sets = {}, {}
    for s, u, i in rows:
        if u is not None and i is not None:
            sets.setdefault(s, {}).setdefault(u, set()).add(i)
    for s, units in sets.items():
        count = lambda x: sum(x <= b for b in units.values())
        n, items = len(units), sorted({i for b in units.values() for i in b})
        frequent = {frozenset(c): count(set(c)) for k in range(1, len(items) + 1) for c in itertools.combinations(items, k) if count(set(c)) >= support * n}
        for z, f in frequent.items():
            for k in range(1, len(z)):
                for a in itertools.combinations(sorted(z), k):
                    c = z - set(a)
                    conf, lf = f / frequent[frozenset(a)], f * n / (frequent[frozenset(a)] * frequent[c])
                    if conf >= confidence and lf >= lift:
                        out[s, a, tuple(sorted(c))] = (f / n, conf, lf)
    return out


@pytest.mark.parametrize("block", [1 << 15, 50])
def test_rules_equal_loops(spark, block, monkeypatch):
    monkeypatch.setattr(rules, "BLOCK", block)
    monkeypatch.setattr(rules, "CANDIDATES", 7)
    rows = baskets()
    frame = spark.createDataFrame(rows, "key string, unit int, item string")
    got = {(r.key, tuple(r.antecedent), tuple(r.consequent)): (r.support, r.confidence, r.lift) for r in rules.association_rules(frame, 0.05, 0.3, 1.0, strata=["key"]).collect()}
    want = loop_rules(rows, 0.05, 0.3, 1.0)
    assert got.keys() == want.keys() and len(want) > 50 and max(len(a) + len(c) for _, a, c in want) > 2
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    pairs = rules.pair_rules(contingency.pair_counts(frame, ["key"], complete=False), 0.05, 0.3, 1.0, ["key"])
    assert {(r.key, (r.antecedent,), (r.consequent,)) for r in pairs.collect()} == {k for k in want if len(k[1]) == len(k[2]) == 1}


def test_rules_of_nothing(spark):
    empty = spark.createDataFrame([], "stratum string, unit int, item string")
    got = rules.association_rules(empty, strata=["stratum"])
    assert got.columns == ["stratum", "antecedent", "consequent", "support", "confidence", "lift"] and got.collect() == []
    with pytest.raises(ValueError):
        rules.frequent_itemsets(empty, min_support=0)


def test_rules_take_as_many_jobs_whatever_the_strata(spark):
    tracker, counts = spark.sparkContext.statusTracker(), []
    for strata in (2, 12):
        frame = spark.createDataFrame([(f"s{k}", u, i) for k in range(strata) for u in range(20) for i in "abc"[: 1 + u % 3]], "stratum string, unit int, item string")
        spark.sparkContext.setJobGroup(f"rules-{strata}", "")
        rules.association_rules(frame, 0.1, 0.1, 0.0, strata=["stratum"]).collect()
        counts.append(len(tracker.getJobIdsForGroup(f"rules-{strata}")))
    spark.sparkContext.setJobGroup("none", "")
    assert counts[1] <= counts[0] + 2


# --- spectra
def test_subspace_equals_a_dense_solver(spark):
    rng = np.random.default_rng(2)
    edges = []
    for name, n in (("p", 10), ("q", 6), ("r", 3)):
        w = rng.random((n, n)) * (rng.random((n, n)) < 0.7)
        edges += [(name, f"v{i:02}", f"v{j:02}", float(w[i, j])) for i in range(n) for j in range(i + 1, n)]
    edges.append(("z", "a", "b", 0.0))
    frame = spark.createDataFrame(edges, "network_id string, left_item string, right_item string, similarity double")
    vectors, values = spectral.subspace(frame, 3, spare=4)
    vectors = {(r.network_id, r.node): r.x for r in vectors.collect()}
    for r in values.collect():
        names = sorted(v for k, v in vectors if k == r.network_id)
        m = np.zeros((len(names),) * 2)
        for k, a, b, w in edges:
            if k == r.network_id and w > 0:
                i, j = names.index(a), names.index(b)
                m[i, j] = m[j, i] = w
        scale = 1 / np.sqrt(m.sum(1))
        m = m * scale[:, None] * scale
        dense, basis = np.linalg.eigh(m)
        assert r.eigenvalues == pytest.approx(dense[::-1][:3].tolist(), abs=1e-6)
        x = np.array([vectors[r.network_id, v] for v in names])
        top = basis[:, ::-1][:, :3]
        assert np.abs(top.T @ x).max() <= 1 + 1e-6 and np.linalg.norm(x - top @ (top.T @ x)) < 1e-3
    assert "z" not in {k for k, _ in vectors}


def planted(spark):
    rng, edges = random.Random(8), []
    for name in ("p", "q"):
        group = {f"v{i:02}": i % 3 if name != "q" else i // 5 for i in range(15)}
        edges += [(name, a, b, 0.9 * rng.random() + 0.1 if group[a] == group[b] else 0.04 * rng.random()) for a, b in itertools.combinations(sorted(group), 2)]
    return spark.createDataFrame([*edges, ("z", "a", "b", 0.0)], "network_id string, left_item string, right_item string, similarity double")


def test_spectral_partition_finds_planted_groups(spark):
    got = {(r.network_id, r.node): r.cluster for r in spectral.partition(planted(spark), 3).collect()}
    for name in ("p", "q"):
        group = {f"v{i:02}": i % 3 if name != "q" else i // 5 for i in range(15)}
        assert all(got[name, v] == group[v] for v in group)
    assert len(got) == 30


def test_power_iteration_keys_networks(spark):
    together = rows_of(spectral.power_iteration(planted(spark), 3))
    alone = rows_of(spectral.power_iteration(planted(spark).filter("network_id = 'q'"), 3))
    assert [r for r in together if r[0] == "q"] == alone and len(alone) == 15
    assert spectral.power_iteration(planted(spark).limit(0), 3).collect() == [] and spectral.partition(planted(spark).limit(0), 2).collect() == []


# --- ranges
def test_running_totals_over_range_borders(spark):
    rng = random.Random(1)
    rows = [(rng.choice(("a", "a", "a", "b", None)), rng.randrange(40), rng.randrange(10)) for _ in range(500)]
    frame = ordered.in_ranges(spark.createDataFrame(rows, "g string, x int, v long").repartition(5), ["g"], "x", 5)
    assert frame.select("_range").distinct().count() > 1
    up = ordered.running(frame, ["g"], "x", F.col("v"), "total")
    least = ordered.running(frame, ["g"], "x", F.col("v"), "least", "min", backwards=True)
    for r in up.collect():
        assert r.total == sum(v for g, x, v in rows if g == r.g and x <= r.x)
    for r in least.collect():
        assert r.least == min(v for g, x, v in rows if g == r.g and x >= r.x)


@pytest.mark.parametrize("method", ["bh", "by", "bonferroni"])
def test_adjusted_p_equal_loops(spark, method):
    rng = random.Random(5)
    rows = [(rng.choice(("f", "f", "g", None)), i, rng.choice((None, 0.01, 0.04, 0.5, rng.random(), rng.random()))) for i in range(300)]
    got = {r.i: r.q_value for r in significance.adjusted(spark.createDataFrame(rows, "family string, i int, p_value double"), ["family"], method=method).collect()}
    assert len(got) == 300
    for family in ("f", "g", None):
        tests = sorted((p, i) for f, i, p in rows if f == family and p is not None)
        m, low = len(tests), 1.0
        factor = sum(1 / k for k in range(1, m + 1)) if method == "by" else 1
        for place in range(m, 0, -1):
            p, i = tests[place - 1]
            low = min(low, p * m / place * factor)
            assert got[i] == pytest.approx(min(1.0, p * m) if method == "bonferroni" else low)
    assert all(got[i] is None for _, i, p in rows if p is None)


def test_rank_plans_have_no_single_partition(spark):
    rows = spark.createDataFrame([(f"g{i % 3}", float(i % 17)) for i in range(200)], "g string, v double")
    for df in (compare.ecdf(rows, "g", "v"), compare.lorenz(rows, "g", "v"), compare.kolmogorov_smirnov(rows, "g", "v"), ordered.anonymised(rows, "g", "v", "L")):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows_of(ordered.anonymised(rows, "g", "v", "L")) == [("g0", "L1"), ("g1", "L2"), ("g2", "L3")]


# --- tied, empty and odd values
@pytest.mark.parametrize("values", [[], [("a", 0.0)], [(None, 1.0), ("a", 2.0), ("b", None), ("b", 2.0)]])
def test_comparisons_of_odd_values(spark, values):
    df = spark.createDataFrame(values, "g string, v double")
    for out in (compare.kruskal(df, "g", "v"), compare.dunn(df, "g", "v"), compare.mann_whitney(df, "g", "v", "a", "b"), compare.welch(df, "g", "v", "a", "b"), compare.lorenz(df, "g", "v"), compare.ecdf(df, "g", "v"), compare.kolmogorov_smirnov(df, "g", "v"), compare.cliffs_delta(df, "g", "v"), compare.describe(df, ["g"], "v"), compare.decisions(df, "g", "v")):
        assert all(x is None or not isinstance(x, float) or math.isfinite(x) for r in out.collect() for x in r)


def test_comparisons_of_ties(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("b", 2.0), ("c", 2.0)], "g string, v double")
    k = compare.kruskal(df, "g", "v").first()
    assert (k.groups, k.n, k.h, k.p_value) == (3, 4, 0.0, 1.0)
    assert {(r.z, r.p_value) for r in compare.dunn(df, "g", "v").collect()} == {(0.0, 1.0)}
    m = compare.mann_whitney(df, "g", "v", "a", "b").first()
    assert (m.u, m.z, m.p_value) == (1.0, 0.0, 1.0)
    assert tuple(compare.welch(df, "g", "v", "a", "b").first()) == (None, None, None)
    zero = spark.createDataFrame([("a", 0.0), ("a", 0.0)], "g string, v double")
    assert [(r.units, r.total) for r in compare.lorenz(zero, "g", "v").collect()] == [(1.0, 1.0)]


def test_networks_without_weight(spark):
    nodes = spark.createDataFrame([("n", v) for v in "abc"], "network_id string, node string")
    edges = spark.createDataFrame([("n", "a", "b", 0.0), ("n", "b", "c", 0.0), ("n", "a", "c", 0.0)], "network_id string, left_item string, right_item string, similarity double")
    c = graph.clustering(nodes, edges).first()
    assert (c.clustering, c.weighted_clustering) == (1.0, 0.0)
    s = graph.summary(nodes, edges).first()
    assert (s.n_edges, s.mean_strength, s.assortativity) == (3, 0.0, None)
    own = nodes.withColumn("community", F.col("node"))
    assert graph.modularity(edges, own).first().modularity == 0
    runs = spark.createDataFrame([("n", 1.0, 0)], "network_id string, gamma double, seed int")
    assert {(r.node, r.community) for r in graph.louvain(nodes, edges, runs).collect()} == {(v, v) for v in "abc"}
    none = edges.limit(0)
    for out in (graph.clustering(nodes, none), graph.summary(nodes, none), graph.louvain(nodes, none, runs), graph.align_all(none), networks.node_changes(nodes, none)):
        out.collect()


def test_null_strata_are_strata(spark):
    rows = [(None, 1, "x"), (None, 1, "y"), (None, 2, "x"), ("s", 3, "x"), ("s", 3, "y"), ("s", 4, None), ("s", None, "x")]
    inc = spark.createDataFrame(rows, "stratum string, unit int, item string")
    want = [("s", "x", "y", 1, 0, 0, 0), (None, "x", "y", 1, 1, 0, 0)]
    for complete in (True, False):
        assert rows_of(contingency.pair_counts(inc, ["stratum"], complete), "stratum", "left_item", "right_item", "a", "b", "c", "d") == sorted(want, key=str)
    values = inc.withColumn("value", F.lit(1))
    assert rows_of(contingency.pair_counts_excluding(values, ["stratum"]), "stratum", "a", "n") == [("s", 1, 1), (None, 1, 1)]
    assert rows_of(contingency.rectangular_counts(inc, inc, ["stratum"]).filter("left_item = 'x' and right_item = 'y'"), "stratum", "a", "n") == [("s", 1, 1), (None, 1, 2)]
    assert {r.stratum for r in contingency.tfidf(inc, ["stratum"], cosine=True).collect()} == {"s", None}
    weighted = contingency.with_item_weights(contingency.pair_counts(inc, ["stratum"]), ["stratum"])
    assert {r.stratum for r in weighted.collect()} == {"s", None}
    units = spark.createDataFrame([(1, None), (2, None), (3, "s")], "unit int, g string")
    got = {(r.g, r["item"]): (r["count"], r.n) for r in coverage.rates(inc.filter("item is not null").select("unit", "item"), units, ["g"]).collect()}
    assert got == {(None, "x"): (2, 2), (None, "y"): (1, 2), ("s", "x"): (1, 1), ("s", "y"): (1, 1)}


@pytest.mark.parametrize("name", ["f", "items", "w", "_k", "a b"])
def test_strata_of_any_name(spark, name):
    inc = spark.createDataFrame([("p", 1, "x"), ("p", 1, "y"), ("q", 2, "x")], "stratum string, unit int, item string").withColumnRenamed("stratum", name)
    assert contingency.pair_counts(inc, [name]).count() == 1
    assert contingency.tfidf(inc, [name], cosine=True).count() == 1
    assert contingency.with_item_weights(contingency.pair_counts(inc, [name]), [name]).count() == 1
    with pytest.raises(ValueError):
        contingency.pair_counts(inc.withColumnRenamed(name, "n"), ["n"])


@pytest.mark.parametrize("strata", [[], ["stratum"]])
def test_pair_operators_of_no_rows(spark, strata):
    inc = spark.createDataFrame([], "stratum string, unit int, item string")
    for out in (contingency.pair_counts(inc, strata), contingency.tfidf(inc, strata), contingency.pair_counts_excluding(inc.withColumn("value", F.lit(1)), strata), contingency.rectangular_counts(inc, inc, strata)):
        assert out.collect() == []
    assert coverage.rates(inc, inc.select("unit", "stratum"), strata).collect() == []


def test_no_population(spark):
    r = spark.createDataFrame([("g", "x", 3, 4), ("h", "x", 1, 4)], "g string, item string, count long, n long")
    people = spark.createDataFrame([("g", 0)], "g string, population long")
    assert {x.g: x.per_100k for x in coverage.per_100k(r, people, "g").collect()} == {"g": None, "h": None}


# --- significance against loops
def tables(spark):
    rng, rows = random.Random(3), []
    for i in range(60):
        a, b, c, d = (rng.randrange(k) for k in (40, 60, 60, 200))
        rows.append(("f" if i % 3 else None, f"l{i:02}", "r", a, b, c, d, a + b, a + c, a + b + c + d, 0.5))
    rows += [("f", "tie", "r", 10, 10, 10, 10, 20, 20, 40, 0.5), ("f", "zero", "r", 0, 0, 0, 5, 0, 0, 5, 0.5)]
    return rows, spark.createDataFrame(rows, "network_id string, left_item string, right_item string, a long, b long, c long, d long, fl long, fr long, n long, similarity double")


def test_g_test_equals_loops(spark):
    rows, frame = tables(spark)
    got = {r.left_item: (r.p, r.q) for r in frame.select("left_item", significance.g_test_p("greater").alias("p"), significance.g_test_p().alias("q")).collect()}
    for _, name, _, a, b, c, d, *_ in rows:
        o = [x + 0.5 for x in (a, b, c, d)]
        n = sum(o)
        e = [(o[0] + o[1]) * (o[0] + o[2]) / n, (o[0] + o[1]) * (o[1] + o[3]) / n, (o[2] + o[3]) * (o[0] + o[2]) / n, (o[2] + o[3]) * (o[1] + o[3]) / n]
        p = math.erfc(math.sqrt(max(0.0, 2 * sum(x * math.log(x / y) for x, y in zip(o, e, strict=True))) / 2))
        assert got[name] == pytest.approx((p / 2 if a * d > b * c else 1 - p / 2, p))


def _pmf(l, r, n, tilt=0.0):
    k = range(max(0, l + r - n), min(l, r) + 1)
    w = [math.lgamma(l + 1) - math.lgamma(x + 1) - math.lgamma(l - x + 1) + math.lgamma(n - l + 1) - math.lgamma(r - x + 1) - math.lgamma(n - l - r + x + 1) + tilt * x for x in k]
    top = max(w)
    total = sum(math.exp(x - top) for x in w)
    return {x: math.exp(v - top) / total for x, v in zip(k, w, strict=True)}


def test_backbone_equals_loops(spark):
    rows, frame = tables(spark)
    got = {r.left_item: r for r in significance.backbone(frame, ["network_id"], alpha=0.2, tau=2.0).collect()}
    hard = {r.left_item: r.similarity for r in significance.through_backbone(frame, ["network_id"], alpha=0.2, tail="greater").collect()}
    soft = {r.left_item: r.similarity for r in significance.through_backbone(frame, ["network_id"], hard=False, soft=True, tau=2.0).collect()}
    for family in ("f", None):
        tests = []
        for f, name, _, a, _, _, _, l, r, n, _ in rows:
            if f == family and a >= 5 and l >= 20 and r >= 20:
                low, high = -20.0, 20.0
                for _ in range(80):
                    mid = (low + high) / 2
                    low, high = (mid, high) if sum(k * p for k, p in _pmf(l, r, n, mid).items()) < a else (low, mid)
                assert got[name].log_odds == pytest.approx(low, abs=1e-6)
                assert soft[name] == pytest.approx(0.5 / (1 + math.exp(-low / 2)))
                tests.append((sum(p for k, p in _pmf(l, r, n).items() if k >= a), name, low))
        tests.sort()
        best = 1.0
        for place in range(len(tests), 0, -1):
            p, name, odds = tests[place - 1]
            best = min(best, p * len(tests) / place)
            assert got[name].q_value == pytest.approx(best)
            assert got[name].gate == (best <= 0.2 and odds > 0) and hard[name] == (0.5 if got[name].gate else 0)
            assert got[name].weight == pytest.approx(1 / (1 + math.exp(-odds / 2)) if got[name].gate else 0)
    assert got["zero"].p_value is None and not got["zero"].gate and hard["zero"] == 0 and soft["zero"] == 0.5


def test_square_matrix_equals_loops(spark):
    edges = spark.createDataFrame([("s", "a", "b", 0.5), ("s", "b", "c", 0.2)], "stratum string, left_item string, right_item string, similarity double")
    got = {r["item"]: (r.a, r.b, r.c) for r in contingency.square(edges, ["stratum"], ["a", "b", "c"]).collect()}
    assert got == {"a": (1.0, 0.5, 0.0), "b": (0.5, 1.0, 0.2), "c": (0.0, 0.2, 1.0)}


def test_exact_intervals(spark):
    from weftline.functions.stats import clopper_pearson

    got = [(round(r.i.low, 4), round(r.i.high, 4)) for r in spark.createDataFrame([(0, 10), (10, 10), (3, 10), (1, 2)], "k long, n long").select(clopper_pearson("k", "n").alias("i")).collect()]
    assert got == [(0.0, 0.3085), (0.6915, 1.0), (0.0667, 0.6525), (0.0126, 0.9874)]


# --- series
def test_splits_equal_all_segmentations():
    rng = np.random.default_rng(4)

    def full(v, penalty, least):
        best, last = [-penalty] + [math.inf] * len(v), [0] * (len(v) + 1)
        for t in range(least, len(v) + 1):
            for s in range(0, t - least + 1):
                c = best[s] + ((v[s:t] - v[s:t].mean()) ** 2).sum() + penalty
                if c < best[t] - 1e-9:
                    best[t], last[t] = c, s
        out, t = [], len(v)
        while last[t] > 0:
            t = last[t]
            out.append(t)
        return out[::-1]

    for n, least in ((5, 3), (30, 3), (70, 2), (90, 6), (60, 1)):
        v = np.concatenate([rng.normal(rng.integers(-4, 5), 1, rng.integers(4, 15)) for _ in range(n)])[:n]
        assert temporal.split_points(v, 3 * math.log(n), least) == full(v, 3 * math.log(n), least)


def test_splits_of_a_long_series():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(6 * (k % 2), 1, 100) for k in range(1000)])
    began = time.time()
    found = temporal.split_points(v, 3 * math.log(len(v)), 3)
    assert time.time() - began < 30 and len(set(found) & set(range(100, len(v), 100))) > 950 and len(found) < 1050


def monthly_series(spark, keys=("a", "b")):
    rows = [(k, f"{2000 + m // 12}-{m % 12 + 1:02}-01", 10.0 + (m % 12) + 0.5 * m * (k == "a") + (30 if k == "b" and m >= 30 else 0)) for k in keys for m in range(60)]
    return rows, spark.createDataFrame(rows, "g string, month string, count double").withColumn("month", F.to_date("month"))


def test_volume_summary_equals_loops(spark):
    rows, series = monthly_series(spark)
    for r in temporal.volume_summary(series, ["g"]).collect():
        v = np.array([x for g, _, x in rows if g == r.g])
        assert r.months == 60 and r["mean"] == pytest.approx(v.mean()) and r.sd == pytest.approx(v.std(ddof=1))
        i, j = np.triu_indices(60, 1)
        s = np.sign(v[j] - v[i]).sum()
        assert r.tau == pytest.approx(s / (60 * 59 / 2))
        assert r.seasonal_z > 0
        shocks = 0
        for t in range(60):
            w = v[max(0, t - 11) : t + 1]
            shocks += len(w) >= 4 and w.std(ddof=1) > 0 and abs(v[t] - w.mean()) / w.std(ddof=1) > 2.5
        assert r.shocks == shocks
        at = temporal.split_points(v, 3 * math.log(60))
        assert [str(d) for d in r.breaks or []] == [rows[t - 1][1] for t in at]
        assert r.amplitude == pytest.approx(11, abs=3)


def test_stratified_trends_equal_single_ones(spark):
    days = [(k, q, f"{1999 + m // 12}-{m % 12 + 1:02}-15") for k in "ab" for q in "xy" for m in range(48) for _ in range(1 + (m // 6) * (k == "a") + (m % 12 == 0))]
    df = spark.createDataFrame(days, "g string, y string, d string").withColumn("d", F.to_date("d"))
    got = trend.stratified_trends(df, "d", ["g", "y"])
    names = [c for c in got.columns if c not in ("stratum_key", "stratum_level")]
    for key in ("g", "y"):
        one = trend.trend_table(temporal.monthly(df, "d", [key]).select(key, "month", "count"), [key])
        want = {r[key]: r for r in one.collect()}
        found = {r.stratum_level: r for r in got.filter(F.col("stratum_key") == key).collect()}
        assert found.keys() == want.keys()
        for level, r in found.items():
            assert all(r[c] == (pytest.approx(want[level][c]) if isinstance(r[c], float) else want[level][c]) for c in names if c in one.columns)


# --- folding, profiles, files
def test_folding_covers_letters_with_marks(spark):
    letters = [chr(c) for c in range(0xC0, 0x2000) if unicodedata.category(chr(c)) in ("Lu", "Ll") and len(unicodedata.normalize("NFD", chr(c))) > 1]
    assert len(letters) > 500
    bad = [r.t for r in spark.createDataFrame([(c,) for c in letters], "t string").select("t", encode.folded(F.col("t")).alias("f")).collect() if r.f != encode.fold(r.t)]
    assert not bad
    texts = [" Škoda ", "SKODA", "straße", "STRASSE", None, "étude", "ø"]
    got = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.f for r in got.select(encode.folded(F.col("t")).alias("f")).collect()] == ["skoda", "skoda", "strasse", "strasse", "", "etude", "ø"]
    assert filters.apply_filters(got, [{"column": "t", "values": ["skoda", "STRASSE", "Étude"]}]).count() == 5


def test_frequent_values(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aaab") if i % 10 else None, i, rng.randrange(400) if i % 3 else 7) for i in range(3000)]
    frame = spark.createDataFrame(rows, "kind string, id int, `x.y` int")
    got = {(r["column"], r.place): (r.value, r["count"]) for r in coverage.frequent_values(frame, 0.01, 3).collect()}
    for c, name in enumerate(("kind", "id", "x.y")):
        seen = {}
        for r in rows:
            if r[c] is not None:
                seen[str(r[c])] = seen.get(str(r[c]), 0) + 1
        want = sorted((-n, v) for v, n in seen.items() if n >= 30)[:3]
        assert [got.get((name, k + 1)) for k in range(3)] == [(v, -n) for n, v in want] + [None] * (3 - len(want))
    full = {r["column"]: r for r in coverage.full_profile(frame).collect()}
    assert full["id"].role == "id" and full["id"].top_value is None and full["kind"].top_value == "a" and full["kind"].nulls == 300
    assert coverage.frequent_values(frame.limit(0)).collect() == []


def test_many_files_are_few_scans(spark, tmp_path):
    paths = []
    for i in range(40):
        path = f"{tmp_path}/f{i}.parquet"
        df = spark.range(2).select(F.col("id").cast("int" if i % 2 else "long").alias("id"), F.lit(i).alias("n"), F.lit(None).cast("string").alias("nothing"))
        df.coalesce(1).write.parquet(path)
        paths.append(path)
    spark.range(1).selectExpr("'x' as id", "1.5 as z").coalesce(1).write.option("header", True).csv(f"{tmp_path}/a.csv")
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 no table PAR1")
    paths += [f"{tmp_path}/a.csv", f"{tmp_path}/broken.parquet", f"{tmp_path}/missing.parquet"]
    out, errors = io.load_with_errors(spark, paths, source_column="file")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 3
    assert out.columns == ["id", "n", "file", "z"] and out.count() == 81 and dict(out.dtypes)["id"] == "string"
    assert out.select("file").distinct().count() == 41 and out.filter("n = 7").first()["file"] == "f7.parquet"
    failed = {r.path.rpartition("/")[2]: r.error for r in errors.collect()}
    assert failed.keys() == {"broken.parquet", "missing.parquet"} and "PATH_NOT_FOUND" in failed["missing.parquet"]
    with pytest.raises(ValueError):
        io.load_many(spark, paths)
    assert io.load_many(spark, paths, strict=False).count() == 81
    assert io.load_with_errors(spark, [paths[-1]])[0] is None


def test_a_failed_replacement_keeps_the_old_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    io.replace_flat(spark.range(3).toDF("a"), path)
    real = io._file_system

    class Failing:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def move(self, a, b):
            if ".new-" in a:
                raise OSError("no space")
            return self.inner.move(a, b)

    monkeypatch.setattr(io, "_file_system", lambda p: (Failing(real(p)[0]), real(p)[1]))
    with pytest.raises(OSError):
        io.replace_flat(spark.range(9).toDF("a"), path)
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 3
    assert io.replace_flat(spark.range(5).toDF("a"), path)["rows"] == 5 and spark.read.parquet(path).count() == 5


@pytest.mark.parametrize("effect", [None, "stretch", "multiply"])
def test_domain_effect_equals_loops(spark, effect):
    rows = [("p", "q", 8, 2, 3, 30, 10, 11, 43), ("p", "r", 5, 5, 1, 32, 10, 6, 43)]
    frame = spark.createDataFrame([("s", *r) for r in rows], "stratum string, left_item string, right_item string, a long, b long, c long, d long, fl long, fr long, n long")
    factor = {"p": 1.5, "q": 0.0, "r": 1.2}
    weighted = contingency.with_item_weights(frame, ["stratum"], domain=spark.createDataFrame(list(factor.items()), "item string, factor double"))
    got = {r.right_item: r for r in weighted.withColumn("base", metrics.idf_cfws()).withColumn("x", metrics.idf_cfws(effect=effect)).collect()}
    for item in "qr":
        theta = ((factor["p"] + factor[item]) / 2) ** 0.35
        base = got[item].base
        want = {None: base, "stretch": 1 - (1 - base) ** max(theta, 1), "multiply": min(1, base * theta)}[effect]
        assert got[item].x == pytest.approx(want)


@pytest.mark.parametrize(("bins", "few"), [(16, 30), (1024, 4096)])
def test_quantiles_equal_percentile(spark, bins, few):
    from weftline.operators.quantiles import quantiles

    rng = random.Random(bins)
    rows = [(rng.choice(("a", "b", None)), rng.choice((rng.gauss(0, 1), rng.randrange(5), 1e6 * rng.random() ** 9))) for _ in range(1500)]
    rows += [("one", 3.0), ("tie", 2.0), ("tie", 2.0), ("none", None), ("nan", float("nan")), ("huge", -1.7e308), ("huge", 1.7e308), ("huge", 1.0)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    shares = (0.0, 0.1, 0.25, 0.5, 0.77, 1.0)
    got = {r.g: r.q for r in quantiles(df, ["g"], "v", shares, bins, few).collect()}
    assert got.keys() == {"a", "b", None, "one", "tie", "huge"} and got["huge"][3] == 1.0
    for g in ("a", "b", None, "one", "tie"):
        v = np.array([x for k, x in rows if k == g], float)
        assert got[g] == pytest.approx(np.quantile(v, shares).tolist(), rel=1e-12)


def test_variation_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 0.0), ("a", None)], "k string, v double")
    got = {r.k: r for r in coverage.variation(df, ["k"], "v", 2.0).collect()}
    assert (got[None].median, got[None].iqr, got[None].mad, got[None].gini, got[None].below) == (2.0, 1.0, 1.0, 0.25, 0.5)
    assert (got["a"].strata, got["a"].median, got["a"].gini, got["a"].cv) == (1, 0.0, 0.0, None)


def test_disparities_keep_units_without_a_cluster(spark):
    from weftline.operators import disparity

    units = spark.createDataFrame([(u, "ab"[u % 2], None if u % 3 == 0 else f"c{u % 3}") for u in range(60)], "unit int, level string, cluster string")
    inc = spark.createDataFrame([(u, "x") for u in range(60) if u % 5 < 2 + u % 2], "unit int, item string")
    counts = disparity.cluster_counts(inc, units, "level", "cluster")
    for r in counts.collect():
        inside = [u for u in range(60) if "ab"[u % 2] == r.level and (None if u % 3 == 0 else f"c{u % 3}") == r.cluster]
        assert (r.n, r.k) == (len(inside), sum(u % 5 < 2 + u % 2 for u in inside))
    got = disparity.estimates(counts, "a").filter("measure = 'RD'").first()
    share = [sum(u % 5 < 2 + u % 2 for u in range(s, 60, 2)) / 30 for s in (0, 1)]
    assert got.estimate == pytest.approx(share[1] - share[0]) and got.se >= 0
