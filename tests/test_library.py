"""Hand examples and invariants of the library, and agreement of registered queries with their SQL on the smallest tables."""

import itertools
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.functions import encode, stats
from weftline.functions.metrics import METRICS
from weftline.operators import compare, contingency, coverage, evaluate, filters, graph, significance, temporal
from weftline.plans import networks
from weftline.plans import rules as rules_of
from weftline.queries import ORACLES, QUERIES
from weftline.sources import io

ROOT, SF = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def three(spark):
    """Three units and three items, each pair together once."""
    rows = [("s", 1, "Amp"), ("s", 1, "Gen"), ("s", 2, "Amp"), ("s", 2, "Cip"), ("s", 3, "Gen"), ("s", 3, "Cip"), ("s", 3, "Cip")]
    return spark.createDataFrame(rows, "stratum string, unit int, item string")


def test_entry_reads_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert out.returncode == 0, out.stderr


def test_hand_example(three):
    for r in contingency.pair_counts(three, ["stratum"]).collect():
        assert (r.a, r.b, r.c, r.d, r.fl, r.fr, r.n) == (1, 1, 1, 0, 2, 2, 3)
    one = contingency.pair_counts(three, []).select(*[METRICS[m]().alias(m) for m in ("jaccard", "dice", "phi", "overlap", "cosine")]).first()
    assert one.jaccard == pytest.approx(1 / 3) and one.dice == 0.5 and one.phi == pytest.approx(-0.5)
    assert one.jaccard <= one.dice <= one.cosine <= one.overlap


def test_metrics_of_empty_and_full_margins(spark):
    cells = [(0, 5, 5, 5), (0, 0, 0, 4), (3, 0, 0, 0), (0, 0, 3, 1), (2, 0, 0, 2)]
    df = contingency.with_margins(spark.createDataFrame(cells, "a long, b long, c long, d long"))
    for r in df.select("a", "b", "c", "d", *[m().alias(k) for k, m in METRICS.items()]).collect():
        assert all(math.isfinite(r[k]) for k in METRICS), r
        assert 0 <= r.jaccard <= r.dice <= 1
    assert df.select(METRICS["yules_y"]().alias("y")).collect()[4].y == 1.0


def test_jensen_shannon_is_that_of_profiles(spark):
    r = contingency.with_margins(spark.createDataFrame([(2, 3, 1, 4)], "a long, b long, c long, d long")).select(METRICS["jensen_shannon"]().alias("x")).first()
    p, q = np.array([1] * 5 + [0] * 5) / 5, np.array([1, 1, 0, 0, 0, 1] + [0] * 4) / 3
    m = (p + q) / 2
    kl = lambda a: sum(x * math.log(x / y) for x, y in zip(a, m, strict=True) if x)
    assert r.x == pytest.approx(1 - math.sqrt((kl(p) + kl(q)) / 2 / math.log(2)))


def test_pooling_adds_counts(three):
    two = three.unionByName(three.withColumn("stratum", F.lit("t")))
    counts = contingency.pair_counts(two, ["stratum"])
    assert {(r.a, r.b, r.c, r.d) for r in contingency.pool(counts).collect()} == {(2, 2, 2, 0)}
    assert contingency.pool(counts, how="mean_similarity", metric=METRICS["jaccard"]()).first().similarity == pytest.approx(1 / 3)


def test_exclusion_of_unrecorded_values(spark):
    rows = [(1, "x", 1), (1, "y", 0), (2, "x", 1), (2, "y", None), (3, "x", 0), (3, "y", 2), (4, "x", 0), (4, "y", 0), (4, "z", None)]
    got = {(r.left_item, r.right_item): (r.a, r.b, r.c, r.d) for r in contingency.pair_counts_excluding(spark.createDataFrame(rows, "unit int, item string, value int"), []).collect()}
    assert got == {("x", "y"): (0, 1, 0, 1), ("x", "z"): (0, 0, 0, 0), ("y", "z"): (0, 0, 0, 0)}


def test_nested_cohorts_count_units_once(spark):
    rows = spark.createDataFrame([(1, "g", 1), (2, "g", 2), (3, "h", 1)], "unit int, g string, y int")
    specs = spark.createDataFrame([("broad", "g", None), ("narrow", "g", 1)], "cohort_id string, g string, y int")
    got = {r.cohort_id: r["count"] for r in filters.cohorts(rows, specs, ["g", "y"]).groupBy("cohort_id").count().collect()}
    assert got == {"broad": 2, "narrow": 1}


def test_long_cohort_lists_are_whole(spark):
    rows = [(u, f"g{u % 3}", u % 4 if u % 5 else None) for u in range(20)]
    df = spark.createDataFrame(rows, "unit int, g string, y int")
    specs = [(f"c{i:05}", f"g{i % 4}" if i % 2 else None, i % 5 if i % 3 else None) for i in range(10_200)]
    fits = [(c, u) for c, g, y in specs for u, rg, ry in rows if g in (None, rg) and (y is None or y == ry)]
    table = spark.createDataFrame(specs, "cohort_id string, g string, y int")
    out = filters.cohorts(df, table, ["g", "y"])
    assert set(out.columns) == {"unit", "g", "y", "cohort_id"} and sorted((r.cohort_id, r.unit) for r in out.collect()) == sorted(fits)
    assert {r.cohort_id for r in filters.cohorts(df, table, ["g", "y"], min_size=20).collect()} == {c for c, g, y in specs if g is None and y is None}


def test_result_tokens(spark):
    raw = {"R": "R", "resistant": "R", " s ": "S", "I": "I", "1": "R", "0": "S", "S/R": "R", "s\\i": "I", "": None, "NA": None, "-": None, ".": None, "x": None, "Sens": "S", None: None}
    df = spark.createDataFrame([(k,) for k in raw], "raw string")
    assert {r.raw: r.t for r in df.select("raw", encode.result_token(F.col("raw")).alias("t")).collect()} == raw


def test_filters_fold_case_and_accents(spark):
    df = spark.createDataFrame([("Élan",), ("elan ",), ("other",), (None,)], "x string")
    assert filters.apply_filters(df, [{"column": "x", "values": ["ELAN"]}]).count() == 2
    with pytest.raises(KeyError):
        filters.Cohort(where={"nothing": 1}).predicate(df)


def test_adjusted_p_values(spark):
    p = [0.01, 0.02, 0.03, 0.04, None]
    df = spark.createDataFrame([(f, x) for f in "ab" for x in p], "f string, p_value double")
    bh = sorted(r.q_value for r in significance.adjusted(df, ["f"]).filter("f = 'a' and p_value is not null").collect())
    assert bh == pytest.approx([0.04] * 4)
    by = [r.q_value for r in significance.adjusted(df, ["f"], method="by").filter("p_value = 0.04").collect()]
    assert by == pytest.approx([0.04 * (1 + 1 / 2 + 1 / 3 + 1 / 4)] * 2)
    assert significance.adjusted(df, ["f"], method="bonferroni").filter("p_value is null and q_value is not null").count() == 0


def test_tails_against_exact_sums():
    choose = lambda k: math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)
    assert stats.fisher_tail(4, 6, 5, 15, "greater") == pytest.approx(choose(4) + choose(5))
    assert stats.fisher_tail(4, 6, 5, 15, "two-sided") == pytest.approx(sum(choose(k) for k in range(6) if choose(k) <= choose(4) + 1e-12))
    assert stats._regularized_gamma_upper(0.5, 1.92) == pytest.approx(math.erfc(math.sqrt(1.92)), rel=1e-9)
    assert stats._regularized_gamma_upper(2.0, 7.0) == pytest.approx(math.exp(-7) * 8, rel=1e-9)
    assert stats.beta_share(0.3, 2, 3) == pytest.approx(sum(math.comb(4, k) * 0.3**k * 0.7 ** (4 - k) for k in range(2, 5)))
    assert stats.log_gamma(np.array([0.5, 1, 7.3, 400])) == pytest.approx([math.lgamma(x) for x in (0.5, 1, 7.3, 400)], abs=1e-9)


@pytest.fixture(scope="module")
def triangles(spark):
    """Two triangles joined by a weak edge, and a node alone."""
    nodes = spark.createDataFrame([("n", c) for c in "abcdefg"], "network_id string, node string")
    links = [("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0), ("d", "e", 1.0), ("d", "f", 1.0), ("e", "f", 1.0), ("c", "d", 0.1)]
    return nodes, spark.createDataFrame([("n", *x) for x in links], "network_id string, left_item string, right_item string, similarity double")


def test_graph_measures(triangles):
    nodes, edges = triangles
    assert graph.threshold(edges, 0.1).count() == 7 and graph.threshold(edges, 0.1, inclusive=False).count() == 6
    assert {r.component for r in graph.components(nodes, edges).collect()} == {"a", "g"}
    s = graph.summary(nodes, edges).first()
    assert (s.n_nodes, s.n_edges) == (7, 7)
    c = graph.clustering(nodes, edges).first().clustering
    assert c == pytest.approx((4 * 1 + 2 * (2 / 6)) / 7)
    hops = {(r.s, r.t): (r.hops, r.routes) for r in graph.paths(edges).collect()}
    assert hops["a", "f"] == (3, 1) and ("a", "g") not in hops
    b = {r.node: r.betweenness for r in graph.betweenness(nodes, edges).collect()}
    assert b["c"] == b["d"] == max(b.values()) and b["a"] == b["g"] == 0


def test_paths_of_a_long_chain(spark):
    """A chain of 24 nodes and a ring of 5: hops beyond any fixed bound, and betweenness by hand."""
    links = [("chain", f"n{i:02}", f"n{i + 1:02}") for i in range(23)] + [("ring", *sorted((f"n{i:02}", f"n{(i + 1) % 5:02}"))) for i in range(5)]
    edges = spark.createDataFrame([(*x, 1.0) for x in links], "network_id string, left_item string, right_item string, similarity double")
    nodes = spark.createDataFrame([("chain", f"n{i:02}") for i in range(24)] + [("ring", f"n{i:02}") for i in range(5)], "network_id string, node string")
    found = graph.paths(edges)
    got = {(r.network_id, r.s, r.t): (r.hops, r.routes) for r in found.collect()}
    chain = {("chain", f"n{i:02}", f"n{j:02}"): (abs(i - j), 1) for i in range(24) for j in range(24) if i != j}
    ring = {("ring", f"n{i:02}", f"n{j:02}"): (min((i - j) % 5, (j - i) % 5), 1) for i in range(5) for j in range(5) if i != j}
    assert got == chain | ring
    b = {(r.network_id, r.node): r.betweenness for r in graph.betweenness(nodes, edges).collect()}
    assert all(b["chain", f"n{i:02}"] == pytest.approx(2 * i * (23 - i) / (23 * 22)) for i in range(24))


def test_louvain_finds_the_triangles(spark, triangles):
    nodes, edges = triangles
    runs = spark.createDataFrame([("n", 1.0, 0), ("n", 1.0, 1)], "network_id string, gamma double, seed int")
    found = graph.louvain(nodes, edges, runs)
    for seed in (0, 1):
        groups = {}
        for r in found.filter(F.col("seed") == seed).collect():
            groups.setdefault(r.community, set()).add(r.node)
        assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["d", "e", "f"], ["g"]]
    one = found.filter("seed = 0")
    assert graph.modularity(edges, one).first().modularity > 0.4
    assert evaluate.stability(found, ["network_id"]).first().stability == 1.0


def test_louvain_moves_until_nothing_can(spark):
    """A ring of 48 nodes: one hashed round a level leaves communities that can be merged with gain."""
    ends = [sorted((f"n{i:02}", f"n{(i + 1) % 48:02}")) for i in range(48)]
    edges = spark.createDataFrame([("r", *e, 1.0) for e in ends], "network_id string, left_item string, right_item string, similarity double")
    nodes = spark.createDataFrame([("r", f"n{i:02}") for i in range(48)], "network_id string, node string")
    runs = spark.createDataFrame([("r", 1.0, 0), ("r", 1.0, 1)], "network_id string, gamma double, seed int")
    found = {}
    for r in graph.louvain(nodes, edges, runs, rounds=1).collect():
        found.setdefault(r.seed, {})[r.node] = r.community
    for of in found.values():
        size = {c: sum(x == c for x in of.values()) for c in of.values()}
        between = {tuple(sorted((of[a], of[b]))) for a, b in ends if of[a] != of[b]}
        assert between and all(1 - 2 * size[a] * 2 * size[b] / 96 <= 1e-9 for a, b in between)
    with pytest.raises(RuntimeError, match="still move"):
        graph.louvain(nodes, edges, runs, most_rounds=1)


def test_grid_query_runs_the_default_grid(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(networks, "grid_search", lambda inc, dataset, labels, grid: asked.append(grid))
    QUERIES["e8_grid"](spark, SF)
    assert asked == [networks.Grid()] and len(list(itertools.product(asked[0].metrics, asked[0].taus, asked[0].gammas, asked[0].seeds))) == 480


def test_power_clusters_of_every_network(spark):
    got = QUERIES["g5_power_iteration"](spark, SF)
    edges = QUERIES["g1_threshold_graph"](spark, SF)
    want = {(r.network_id, n) for r in edges.collect() for n in (r.left_item, r.right_item)}
    rows = [(r.network_id, r.node) for r in got.collect()]
    assert len({n for n, _ in want}) > 1 and len(rows) == len(set(rows)) and set(rows) == want
    assert got.agg(F.max("cluster")).first()[0] <= 3


def test_agreement(spark):
    rows = [("same", a, b) for a, b in ((1, 2), (1, 2), (2, 1), (2, 1))] + [("cross", a, b) for a, b in ((1, 1), (1, 2), (2, 1), (2, 2))]
    got = {r.k: (r.ari, r.nmi) for r in evaluate.agreement(spark.createDataFrame(rows, "k string, x int, y int"), ["k"]).collect()}
    assert got["same"] == pytest.approx((1, 1)) and got["cross"] == pytest.approx((-0.5, 0))


def test_rules_with_larger_consequents(spark):
    rows = [(u, i) for u in range(10) for i in ("x", "y", "z")] + [(11, "x"), (12, "w")]
    rules = rules_of.association_rules(spark.createDataFrame(rows, "unit int, item string"), 0.1, 0.3, 1.0).collect()
    r = next(r for r in rules if r.antecedent == ["x"] and r.consequent == ["y", "z"])
    assert r.support == pytest.approx(10 / 12) and r.confidence == pytest.approx(10 / 11)


def test_rules_of_all_sizes_against_brute_force(spark):
    baskets = ["abcdef"] * 6 + ["abc", "abd", "ef", "f", "g", "ag"]
    rules = rules_of.association_rules(spark.createDataFrame([(u, i) for u, b in enumerate(baskets) for i in b], "unit int, item string"), 0.1, 0.3, 1.0)
    n, got = len(baskets), {(tuple(r.antecedent), tuple(r.consequent)): (r.support, r.confidence, r.lift) for r in rules.collect()}
    share = {s: sum(set(s) <= set(b) for b in baskets) / n for k in range(1, 8) for s in itertools.combinations("abcdefg", k)}
    want = {}
    for s in (s for s, x in share.items() if x >= 0.1):
        for one in (c for k in range(1, len(s)) for c in itertools.combinations(s, k)):
            two = tuple(x for x in s if x not in one)
            r = share[s], share[s] / share[one], share[s] / (share[one] * share[two])
            if r[1] >= 0.3 and r[2] >= 1:
                want[one, two] = r
    assert max(len(a) + len(b) for a, b in want) == 6 and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_gini_and_wilson(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 1, 1, 1)] + [("b", float(x)) for x in (0, 0, 0, 4)] + [("c", 0.0)], "k string, v double")
    assert {r.k: round(r.gini, 6) for r in coverage.gini(df, ["k"], "v").collect()} == {"a": 0.0, "b": 0.75, "c": 0.0}
    low, high = coverage.wilson(F.lit(5.0), F.lit(10.0))
    assert tuple(round(x, 4) for x in spark.range(1).select(low, high).first()) == (0.2366, 0.7634)


def test_series(spark):
    dates = [(f"2020-{m:02d}-03",) for m in (1, 2, 2, 4) for _ in range(1)]
    got = temporal.monthly(spark.createDataFrame(dates, "d string").withColumn("d", F.to_date("d")), "d").orderBy("month").collect()
    assert [r["count"] for r in got] == [1, 2, 0, 1] and got[3].moving == 1.0
    up = spark.createDataFrame([(i, float(i)) for i in range(8)], "i int, count double").withColumn("month", F.add_months(F.lit("2020-01-01").cast("date"), F.col("i")))
    mk = temporal.mann_kendall(up, []).first()
    assert mk.s == 28 and mk.tau == 1.0 and mk.z > 3


def test_participation_types(spark):
    years = {"all": range(2000, 2004), "one": [2001], "late": [2002, 2003], "early": [2000, 2001], "gap": [2000, 2002]}
    df = spark.createDataFrame([(k, y) for k, v in years.items() for y in v], "o string, y int")
    got = {r.o: r.type for r in temporal.participation(df, "o", "y", 2000, 2003).collect()}
    assert got == {"all": "Continuous", "one": "Single Year", "late": "Entering", "early": "Leaving", "gap": "Intermittent"}


def test_rank_comparisons(spark):
    rows = [("a", x) for x in (1, 1, 2, 3)] + [("b", x) for x in (2, 3, 3, 5)]
    df = spark.createDataFrame(rows, "g string, x int")
    a, b = [1, 1, 2, 3], [2, 3, 3, 5]
    want = sum((x > y) - (x < y) for x in a for y in b) / 16
    assert compare.cliffs_delta(df, "g", "x").first().delta == pytest.approx(want)
    assert compare.kolmogorov_smirnov(df, "g", "x").first().d == pytest.approx(0.5)


def test_files_of_several_forms(spark):
    place = io.scratch(spark, "test")
    spark.createDataFrame([(1, "007")], "k int, code string").write.option("header", True).csv(place + "-a.csv")
    assert io.read_any(spark, place + "-a.csv", "k int, code string").first().code == "007"
    assert not io.is_ready(spark, place + "-none")
    with pytest.raises(ValueError):
        io.layout(spark.range(1))


SAMPLE = [n for i, n in enumerate(sorted(ORACLES)) if i % 5 == 0]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str) == want


def test_split_points_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x = np.concatenate([rng.normal(m, 1, rng.integers(3, 6)) for m in rng.choice([0, 6, 12], 3)])

        def loss(cuts, x=x):
            ends = [0, *cuts, len(x)]
            return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + 5 for a, b in zip(ends, ends[1:], strict=False))

        every = [c for k in range(4) for c in itertools.combinations(range(3, len(x) - 2), k) if all(b - a >= 3 for a, b in zip((0, *c), (*c, len(x)), strict=True))]
        assert loss(temporal.split_points(x, 5.0)) == pytest.approx(min(map(loss, every)))


def test_breaks_of_a_series(spark):
    rows = [("a", i, 10.0 if i < 12 else 40.0) for i in range(24)] + [("b", i, 5.0) for i in range(24)]
    df = spark.createDataFrame(rows, "g string, i int, count double").withColumn("month", F.add_months(F.lit("2020-01-01").cast("date"), F.col("i")))
    got = [(r.g, r.break_number, str(r.month)) for r in temporal.breaks(df, ["g"]).collect()]
    assert got == [("a", 1, "2020-12-01")]
