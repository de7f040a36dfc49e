"""Disparities, decompositions, trends, name matching and network comparisons against brute force; counts that don't fit one task."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import domain, stats
from weftline.operators import compare, contingency, coverage, disparity, filters, graph, trend
from weftline.plans import networks, reports
from weftline.sources import io


def monthly(spark, values, key="a"):
    rows = [(key, i, float(x)) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "g string, i int, count double").select("g", F.add_months(F.lit("2015-01-01").cast("date"), F.col("i")).alias("month"), "count")


def test_exact_tests_against_whole_sums():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(5, 400)
        fl, fr = rng.randrange(n + 1), rng.randrange(n + 1)
        low, high = max(0, fl + fr - n), min(fl, fr)
        a = rng.randrange(low, high + 1)
        p = {k: math.comb(fl, k) * math.comb(n - fl, fr - k) / math.comb(n, fr) for k in range(low, high + 1)}
        assert stats.fisher_tail(a, fl, fr, n, "greater") == pytest.approx(min(1, sum(p[k] for k in p if k >= a)), rel=1e-6)
        assert stats.fisher_tail(a, fl, fr, n, "less") == pytest.approx(min(1, sum(p[k] for k in p if k <= a)), rel=1e-6)
        assert stats.fisher_tail(a, fl, fr, n, "two-sided") == pytest.approx(min(1, sum(x for x in p.values() if x <= p[a] * (1 + 1e-7))), rel=1e-6)
        odds = stats.tilted_odds(a, fl, fr, n)
        if low < a < high:
            logs = {k: math.log(p[k]) + odds * k for k in p}
            w = {k: math.exp(x - max(logs.values())) for k, x in logs.items()}
            assert sum(k * x for k, x in w.items()) / sum(w.values()) == pytest.approx(a, abs=1e-6)


def test_exact_tests_of_large_margins_are_quick():
    began = time.time()
    n = 10**9
    assert 0 < stats.fisher_tail(10**6 + 2000, 3 * 10**7, n // 30, n, "greater") < 0.05
    assert stats.fisher_tail(10**6, 3 * 10**7, n // 30, n, "two-sided") == pytest.approx(1, abs=0.02)
    assert stats.tilted_odds(10**6 + 2000, 3 * 10**7, n // 30, n) == pytest.approx(0.00213, abs=2e-4)
    assert time.time() - began < 5


def test_long_units_are_paired_whole(spark, monkeypatch):
    monkeypatch.setattr(contingency, "LONG", 3)
    rng = random.Random(5)
    units = [rng.sample("abcdefghijk", rng.randrange(1, 11)) for _ in range(30)]
    df = spark.createDataFrame([("s", u, i) for u, items in enumerate(units) for i in items], "stratum string, unit int, item string")
    got = {(r.left_item, r.right_item): r.a for r in contingency.pair_counts(df, ["stratum"]).collect()}
    assert got == {p: sum(set(p) <= set(u) for u in units) for p in itertools.combinations("abcdefghijk", 2)}
    values = df.withColumn("value", F.pmod(F.hash("unit", "item"), F.lit(2)))
    known = {(r.unit, r.item): r.value for r in values.collect()}
    for r in contingency.pair_counts_excluding(values, ["stratum"]).collect():
        both = [u for u, items in enumerate(units) if {r.left_item, r.right_item} <= set(items)]
        assert (r.a, r.n) == (sum(known[u, r.left_item] and known[u, r.right_item] for u in both), len(both))


def test_disparities_against_matrices(spark):
    rng = np.random.default_rng(0)
    rows = [(u, f"l{u % 3}", f"c{rng.integers(6)}", bool(rng.random() < (0.2, 0.4, 0.5)[u % 3])) for u in range(300)]
    units = spark.createDataFrame([(u, g, c) for u, g, c, _ in rows], "unit int, g string, c string")
    inc = spark.createDataFrame([(u, "x") for u, _, _, y in rows if y], "unit int, item string")
    counts = disparity.cluster_counts(inc, units, "g", "c")
    got = {(r.measure, r.level): r for r in disparity.estimates(counts, "l0").collect()}
    x = np.array([[g == f"l{k}" for k in range(3)] for _, g, _, _ in rows], float)
    x[:, 0] = 1  # an intercept and two contrasts
    y, cluster = np.array([r[3] for r in rows], float), [r[2] for r in rows]
    mean = np.array([y[[r[1] == f"l{k}" for r in rows]].mean() for k in range(3)])
    p = np.array([mean[int(r[1][1])] for r in rows])
    for measure, weight, beta in (("OR", p * (1 - p), np.log(mean / (1 - mean))), ("RR", p, np.log(mean)), ("RD", np.ones(300), mean)):
        bread = np.linalg.inv(x.T @ (x * weight[:, None]))
        scores = np.array([x[[c == k for c in cluster]].T @ (y - p)[[c == k for c in cluster]] for k in sorted(set(cluster))])
        g = len(scores)
        v = bread @ scores.T @ scores @ bread * (g / (g - 1)) * (299 / 297)
        for k in (1, 2):
            r = got[measure, f"l{k}"]
            assert r.estimate == pytest.approx(beta[k] - beta[0]) and r.se == pytest.approx(math.sqrt(v[k, k]))
        d = np.array([beta[1] - beta[0], beta[2] - beta[0]])
        joint = disparity.joint_test(counts, "l0", measure).first()
        assert joint.chi2 == pytest.approx(d @ np.linalg.inv(v[1:, 1:]) @ d) and joint.df == 2
    assert disparity.estimates(disparity.cluster_counts(inc.limit(0), units, "g", "c"), "l0").count() == 0


def test_decomposition_finds_line_and_season(spark):
    season = [3, -1, 0, 2, -4, 5, -3, 1, -2, 4, -6, 1]
    series = monthly(spark, [10 + 0.5 * i + season[i % 12] for i in range(48)])
    for r in trend.decompose(series, ["g"]).orderBy("month").collect():
        i = (r.month.year - 2015) * 12 + r.month.month - 1
        assert r.trend == pytest.approx(10 + 0.5 * i) and r.seasonal == pytest.approx(season[i % 12]) and r.residual == pytest.approx(0, abs=1e-9)
    d = trend.diagnostics(trend.decompose(series, ["g"]), ["g"]).first()
    assert d.explained == pytest.approx(1)
    factors = [1.5, 0.5, 1, 1, 1, 1, 1, 1, 1, 1, 0.75, 1.25]
    for r in trend.decompose(monthly(spark, [20 * factors[i % 12] for i in range(36)]), ["g"], model="multiplicative").collect():
        assert r.trend == pytest.approx(20) and r.seasonal == pytest.approx(factors[r.month.month - 1])
    assert trend.decompose(monthly(spark, range(10)), ["g"]).filter("trend is not null").count() == 0


def test_hamed_rao_against_loops(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(0, 1, 60)) + rng.normal(0, 0.5, 60)
    n = len(x)
    slope = np.median([(x[j] - x[i]) / (j - i) for i in range(n) for j in range(i + 1, n)])
    y = [v - slope * t for t, v in enumerate(x)]
    rank = [sum(b < a for b in y) + (sum(b == a for b in y) + 1) / 2 for a in y]
    m = sum(rank) / n
    total = 0.0
    for k in range(1, n - 2):
        rho = sum((rank[i] - m) * (rank[i + k] - m) for i in range(n - k)) / sum((r - m) ** 2 for r in rank)
        if abs(rho) > 1.959963984540054 / math.sqrt(n):
            total += (n - k) * (n - k - 1) * (n - k - 2) * rho
    assert trend.hamed_rao_factor(x) == pytest.approx(1 + 2 / (n * (n - 1) * (n - 2)) * total)
    both = monthly(spark, x).unionByName(monthly(spark, [5.0] * 20, "flat")).unionByName(monthly(spark, [1, 2, 3], "short"))
    got = {r.g: r for r in trend.hamed_rao(both, ["g"]).collect()}
    assert got["flat"].z is None and got["short"].z is None and 0 <= got["a"].p_value <= 1
    table = {r.g: r for r in trend.trend_table(both, ["g"]).collect()}
    assert table["a"].months == 60 and table["short"].amplitude is None


def test_rank_tests_of_two_groups(spark):
    a, b = [1, 1, 2, 3, 7], [2, 3, 3, 5]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, x int")
    r = compare.mann_whitney(df, "g", "x", "a", "b").first()
    assert r.u == sum((x > y) + (x == y) / 2 for x in a for y in b)
    z = compare.dunn(df, "g", "x").first()
    k = compare.kruskal(df, "g", "x").first()
    assert z.z**2 == pytest.approx(k.h) and z.p_value == pytest.approx(k.p_value, rel=1e-6) and z.q_value == pytest.approx(z.p_value)


def test_names_are_matched_in_three_steps(spark):
    known = spark.createDataFrame([("Amoxicillin", "P"), ("Ampicillin", "P"), ("Ciprofloxacin", "Q"), ("Colistin", "L")], "name string, label string")
    synonyms = spark.createDataFrame([("Cipro", "ciprofloxacin")], "synonym string, name string")
    items = ["AMOXICILLIN", "amoxicilin", "cipro", "colistine", "water", None, ""]
    got = {r.item: (r.name, r.label, r.how) for r in domain.enrich(spark.createDataFrame([(i,) for i in items], "item string"), known, synonyms).collect()}
    assert got["AMOXICILLIN"] == ("Amoxicillin", "P", "exact") and got["amoxicilin"] == ("Amoxicillin", "P", "similar")
    assert got["cipro"] == ("Ciprofloxacin", "Q", "synonym") and got["colistine"] == ("Colistin", "L", "similar") and got["water"] == (None, "Not Set", "none")


def test_domain_weights(spark):
    got = {r.item: (r.code, r.guideline, r.novelty) for r in domain.domain_weights(spark.createDataFrame([("COL - Colistin",), ("NOR - Norfloxacin_Tested",), ("FUS x",), ("ZZZ",)], "item string")).collect()}
    assert got == {"COL - Colistin": ("COL", 2, 3), "NOR - Norfloxacin_Tested": ("NOR", 2, 1), "FUS x": ("FUS", 0, 0), "ZZZ": ("ZZZ", 1, 1)}


def test_networks_compared_with_themselves(spark):
    rows = [(n, a, b, w) for n in ("p", "q") for a, b, w in (("a", "b", 0.9), ("a", "c", 0.5), ("b", "c", 0.3), ("c", "d", 0.7))]
    scored = spark.createDataFrame(rows, "network_id string, left_item string, right_item string, similarity double")
    nodes = spark.createDataFrame([(n, x) for n in ("p", "q") for x in "abcd"], "network_id string, node string")
    r = networks.compare_networks(scored, nodes, 0.4, top=2, communities=nodes.withColumn("community", F.lit("z"))).first()
    assert (r.first, r.second, r.edge_jaccard, r.top_edge_jaccard, r.top_node_jaccard, r.ari) == ("p", "q", 1, 1, 1, 1)
    assert r.spearman == pytest.approx(1) and r.degree_spearman == pytest.approx(1) and r.rmse == 0
    assert networks.node_changes(nodes, scored).filter("degree_change <> 0 or strength_change <> 0").count() == 0


def test_grid_scores(spark):
    rng = random.Random(1)
    rows = [("d", u, i) for u in range(60) for i in ("abc" if u % 2 else "xyz") if rng.random() < 0.8]
    labels = spark.createDataFrame([(i, "1" if i in "abc" else "2") for i in "abcxyz"], "item string, label string")
    grid = networks.Grid(metrics=("jaccard",), taus=(0.2,), gammas=(1.0,), seeds=(0, 1))
    r = networks.grid_search(spark.createDataFrame(rows, "ds string, unit int, item string"), "ds", {"fine": labels, "broad": labels}, grid).first()
    assert r.ari_fine_mean == r.nmi_broad_mean == r.hierarchical_mean == 1 and r.n_communities_mean == 2 and r.silhouette_mean > 0.3 and r.stability == 1


def test_no_cartesian_products(spark):
    from weftline.queries import QUERIES

    for name in ("a1_rates", "a12_variation", "a13_error_bars", "a26_pattern_matrix", "t5_kolmogorov_smirnov", "t7_cliffs_delta", "c1_pair_counts"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_rates_of_empty_tables(spark):
    units = spark.createDataFrame([], "unit int, g string")
    inc = spark.createDataFrame([], "unit int, item string")
    assert coverage.rates(inc, units, ["g"]).count() == 0 and coverage.metric(inc, units, ["g"], "coverage").count() == 0
    assert contingency.pair_counts(inc.withColumn("s", F.lit("x")), ["s"]).count() == 0


def test_weighted_paths_against_brute_force(spark):
    rng = random.Random(8)
    names = [f"n{i:02d}" for i in range(14)]
    weights = {p: round(rng.random() + 0.05, 3) for p in itertools.combinations(names, 2) if rng.random() < 0.18}
    edges = spark.createDataFrame([("x", a, b, w) for (a, b), w in weights.items()], "network_id string, left_item string, right_item string, similarity double")
    far = {(a, b): 0.0 if a == b else math.inf for a in names for b in names}
    for (a, b), w in weights.items():
        far[a, b] = far[b, a] = w
    for k, a, b in itertools.product(names, repeat=3):
        far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    found = graph.weighted_paths(edges)
    got = {(r.s, r.t): r.distance for r in found.collect()}
    assert got == pytest.approx({p: d for p, d in far.items() if p[0] != p[1] and d < math.inf})
    reach = {a: frozenset(b for b in names if far[a, b] < math.inf) for a in names}
    largest = min((r for r in reach.values() if len(r) > 1), key=lambda r: (-len(r), min(r)))
    inside = [far[a, b] for a, b in itertools.permutations(sorted(largest), 2)]
    row = graph.path_summary(found).first()
    assert (row["size"], row["mean"], row["longest"]) == (len(largest), pytest.approx(sum(inside) / len(inside)), pytest.approx(max(inside)))
    with pytest.raises(ValueError):
        graph.weighted_paths(edges.withColumn("similarity", -F.col("similarity")))
    assert graph.weighted_paths(edges.limit(0)).count() == 0


def test_correlation_p_values(spark):
    df = spark.createDataFrame([(0.5, 10), (-0.5, 10), (1.0, 5), (0.3, 2), (0.0, 8)], "r double, n long")
    got = [r.p for r in df.select(stats.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    # with 8 degrees of freedom t = 0.5 * sqrt(8 / 0.75) = 1.633, two-sided 0.1411
    assert got == [pytest.approx(0.1411, abs=1e-4), pytest.approx(0.1411, abs=1e-4), 0.0, None, pytest.approx(1.0)]


def test_stratum_report(spark):
    rows = [(t, v) for t, values in {"Critical": [1, 2, 2, 3], "High": [2, 3, 3, 4], "Other": [5, 6, 7, 7], "unheard of": [9]}.items() for v in values]
    df = spark.createDataFrame([*rows, (None, 4), ("High", None)], "tier string, v int")
    got = {(r.scope, r["name"], r.other, r.measure): r.value for r in reports.priority_alignment(df, "tier", "v").collect()}
    assert {k[1] for k in got if k[0] == "group"} == {"Critical", "High", "Other"}
    assert (got["group", "High", None, "n"], got["group", "High", None, "median"]) == (4, 3)
    assert got["pair", "Critical", "Other", "delta"] == -1 and got["pair", "Critical", "Other", "d"] == 1
    assert got["all", "all", None, "ascending"] == 1 and got["all", "all", None, "groups"] == 3
    free = {r["name"] for r in reports.stratum_report(df, "tier", "v").filter("scope = 'group'").collect()}
    assert free == {"Critical", "High", "Other", "unheard of"}


def test_outputs_are_replaced_and_found(spark):
    root = io.scratch(spark, "versions")
    assert io.latest_output(root, "a") is None
    one = io.save_version(spark.range(5), root, "a")
    assert io.latest_output(root, "a") == one
    spark.range(3).write.parquet(f"{root}/a/{10**19}-unfinished")  # no facts: not whole
    assert io.latest_output(root, "a") == one
    two = io.save_version(spark.range(7), root, "a", rows_per_file=1)
    assert io.latest_output(root, "a") == two and spark.read.parquet(two).count() == 7
    place = f"{root}/b"
    io.replace_flat(spark.range(4), place)
    facts = io.replace_flat(spark.read.parquet(place).filter("id < 2").withColumn("x", F.lit(1)), place)
    assert (facts["rows"], facts["cols"]) == (2, 2) and facts["files"] >= 1
    assert sorted(r.id for r in spark.read.parquet(place).collect()) == [0, 1]
    got = {r["name"]: (r.ready, r["rows"], r.columns) for r in io.dataset_facts(spark, {"b": place, "none": root + "/none"}).collect()}
    assert got == {"b": (True, 2, 2), "none": (False, 0, 0)}


def test_tables_with_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "g string, unit int")
    assert [(r.g, r.n) for r in coverage.counts_by(df, ["g"], 2).collect()] == [(None, 2), ("a", 2)]
    kept = spark.createDataFrame([("a",), ("a",), (None,)], "g string")
    assert filters.members(df, "g", kept).count() == 2 and filters.members(df, "g", kept, keep=False).count() == 3
    twice = spark.createDataFrame([("a", "x"), ("a", "x")], "g string, label string")
    assert sorted(r.label for r in filters.mapped(df, "g", twice, "Unknown").collect()) == ["Unknown"] * 3 + ["x"] * 2
    assert filters.renamed(df, {"g": "group", "absent": "z"}).columns == ["group", "unit"]
    inc = spark.createDataFrame([], "unit int, item string")
    assert coverage.box_table(coverage.rates(inc, df, ["g"])).count() == 0
    assert coverage.top_items(inc, df, ["g"], 3).count() == 0
    assert coverage.group_totals(inc, spark.createDataFrame([], "item string, item_group string"), 5).count() == 0
