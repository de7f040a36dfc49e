"""From incidence to scored networks: pruned pairs of graphs, comparisons, the parameter grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.metrics import METRICS
from weftline.functions.stats import correlation, correlation_p
from weftline.operators import contingency, evaluate, filters, graph, significance
from weftline.operators.lineage import cut


def raw_and_pruned(scored: DataFrame, tau: float, alpha: float = 0.05) -> DataFrame:
    """Edges of each network at the threshold, and those of them that are significant."""
    out = significance.prune(scored, ["network_id"], alpha=alpha, tau=tau)
    return out.groupBy("network_id").agg(F.count_if(F.col("similarity") >= tau).alias("raw_edges"), F.count_if("keep").alias("pruned_edges"))


def compare_all(scored: DataFrame, tau: float, empty: float = 1.0) -> DataFrame:
    """Every two networks on the pairs that both score; ``empty`` as in ``graph.compare_edges``."""
    pick = lambda name, value: scored.select(F.col("network_id").alias(name), "left_item", "right_item", F.col("similarity").alias(value))
    both = pick("first", "x").join(pick("second", "y"), ["left_item", "right_item"]).filter("first < second")
    return graph.compare_edges(both, tau, ["first", "second"], empty)


@dataclass
class Grid:
    # The default grid.
    metrics: tuple[str, ...] = ("jaccard", "dice", "cosine", "phi")
    taus: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4)
    gammas: tuple[float, ...] = (0.5, 0.75, 1.0)
    seeds: tuple[int, ...] = tuple(range(10))
    #: Weights of the hierarchical score by label set; none: all alike.
    weights: dict[str, float] | None = None


def grid_search(inc: DataFrame, dataset: str, labels: DataFrame | dict[str, DataFrame], grid: Grid) -> DataFrame:
    """Scores of communities for every (dataset, metric, tau, gamma), means and deviations over seeds: number, cohesion, silhouette,
    agreement with each label set (``ari_<name>``, ``nmi_<name>``; a single frame is the set ``labels``), the hierarchical score and
    stability. Counts are made once, metrics are columns of one pass, and all graphs of the grid are clustered in the same jobs."""
    sets = labels if isinstance(labels, dict) else {"labels": labels}
    pairs = contingency.pair_counts(inc, [dataset])
    scores = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(METRICS[m](), 6).alias("similarity")) for m in grid.metrics])
    scored = cut(pairs.select(dataset, "left_item", "right_item", F.explode(scores).alias("s")).select(dataset, "left_item", "right_item", "s.*"))
    taus = F.explode(F.array(*[F.lit(t) for t in grid.taus])).alias("tau")
    network = F.concat_ws("|", dataset, "metric", F.col("tau").cast("string")).alias("network_id")
    full = scored.select("*", taus).select("*", network)
    edges = full.filter("similarity >= tau")
    items = inc.select(dataset, F.col("item").alias("node")).distinct()
    networks = full.select(dataset, "metric", "tau", "network_id").distinct()
    nodes = networks.join(items, dataset).select("network_id", "node")
    settings = [F.struct(F.lit(g).alias("gamma"), F.lit(s).alias("seed")) for g in grid.gammas for s in grid.seeds]
    runs = networks.select("network_id", F.explode(F.array(*settings)).alias("r")).select("network_id", "r.*")
    communities = cut(graph.louvain(nodes, edges.select("network_id", "left_item", "right_item", "similarity"), runs))
    keys = ["network_id", "gamma", "seed"]
    keyed = cut(full.select("network_id", "left_item", "right_item", "similarity").join(runs, "network_id"))
    per_seed = communities.groupBy(*keys).agg(F.count_distinct("community").alias("n_communities"))
    per_seed = per_seed.join(evaluate.cohesion(keyed, communities, keys).select(*keys, "ics"), keys, "left")
    per_seed = per_seed.join(evaluate.silhouette(keyed, communities, keys).select(*keys, "silhouette"), keys, "left")
    for name, one in sets.items():
        agree = evaluate.against_labels(communities, one, keys).select(*keys, F.col("ari").alias(f"ari_{name}"), F.col("nmi").alias(f"nmi_{name}"))
        per_seed = per_seed.join(agree, keys, "left")
    weights = grid.weights or dict.fromkeys(sets, 1.0)
    per_seed = evaluate.hierarchical(per_seed, {f"nmi_{name}": w for name, w in weights.items()})
    columns = ["n_communities", "ics", "silhouette", "hierarchical", *[f"{m}_{name}" for name in sets for m in ("ari", "nmi")]]
    out = evaluate.over_seeds(per_seed, ["network_id", "gamma"], columns)
    out = out.join(evaluate.stability(communities, ["network_id", "gamma"]), ["network_id", "gamma"], "left")
    return networks.join(out, "network_id").drop("network_id")


def _average_rank(value: str, over: list[str]):
    w = Window.partitionBy(*over)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*over, value)) - 1) / 2


def _top_jaccard(rows: DataFrame, keys: list[str], member: list[str], value: str, k: int, name: str) -> DataFrame:
    """(first, second, name): overlap of the ``k`` highest members of every two networks, over their union."""
    top = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), *member))).filter(F.col("_k") <= k).select(*keys, *member)
    top = cut(top)
    size = cut(top.groupBy(*keys).agg(F.count("*").alias("n")))
    one, two = (top.withColumnRenamed("network_id", s) for s in ("first", "second"))
    both = one.join(two, member).filter("first < second").groupBy("first", "second").agg(F.count("*").alias("both"))
    pairs = size.withColumnsRenamed({"network_id": "first", "n": "n1"}).join(size.withColumnsRenamed({"network_id": "second", "n": "n2"}), F.col("first") < F.col("second"))
    out = pairs.join(both, ["first", "second"], "left").fillna(0, ["both"])
    return out.select("first", "second", (F.col("both") / (F.col("n1") + F.col("n2") - F.col("both"))).alias(name))


def compare_networks(scored: DataFrame, nodes: DataFrame, tau: float, top: int = 100, communities: DataFrame | None = None) -> DataFrame:
    """Every two networks: edge Jaccard at tau, Pearson, Spearman and root mean square difference of the weights of pairs that both
    score, Spearman of node degrees and strengths, Jaccard of the ``top`` edges and nodes (by strength), and with ``communities``
    (network_id, node, community) the agreement of both partitions. Networks are compared in one job, on canonical pairs."""
    scored = cut(scored.select("network_id", "left_item", "right_item", "similarity"))
    edges = cut(scored.filter(F.col("similarity") >= tau))
    degrees = cut(graph.degrees(nodes, edges).select("network_id", "node", "degree", "strength"))
    pair = ["first", "second"]
    pick = lambda df, name, columns: df.select(F.col("network_id").alias(name), *columns)
    both = pick(scored, "first", ["left_item", "right_item", F.col("similarity").alias("x")]).join(pick(scored, "second", ["left_item", "right_item", F.col("similarity").alias("y")]), ["left_item", "right_item"]).filter("first < second")
    both = cut(both)
    out = graph.compare_edges(both, tau, pair)
    ranks = both.select(*pair, _average_rank("x", pair).alias("rx"), _average_rank("y", pair).alias("ry"))
    out = out.join(ranks.groupBy(*pair).agg(correlation("rx", "ry").alias("spearman")), pair)
    one, two = (pick(degrees, s, ["node", F.col("degree").alias(f"d{i}"), F.col("strength").alias(f"s{i}")]) for i, s in ((1, "first"), (2, "second")))
    same = one.join(two, "node").filter("first < second")
    same = same.select(*pair, *[_average_rank(c, pair).alias(c) for c in ("d1", "d2", "s1", "s2")])
    out = out.join(same.groupBy(*pair).agg(correlation("d1", "d2").alias("degree_spearman"), correlation("s1", "s2").alias("strength_spearman")), pair, "left")
    out = out.join(_top_jaccard(edges, ["network_id"], ["left_item", "right_item"], "similarity", top, "top_edge_jaccard"), pair, "left")
    out = out.join(_top_jaccard(degrees, ["network_id"], ["node"], "strength", top, "top_node_jaccard"), pair, "left")
    if communities is not None:
        a, b = pick(communities, "first", ["node", F.col("community").alias("x")]), pick(communities, "second", ["node", F.col("community").alias("y")])
        agree = evaluate.agreement(a.join(b, "node").filter("first < second"), pair).select(*pair, "ari", "nmi")
        out = out.join(agree, pair, "left")
    return out


def correlation_tests(scored: DataFrame) -> DataFrame:
    """(first, second, pairs, pearson, pearson_p, spearman, spearman_p) of every two networks over the item pairs that both score."""
    one, two = (scored.select(F.col("network_id").alias(name), "left_item", "right_item", F.col("similarity").alias(v)) for name, v in (("first", "x"), ("second", "y")))
    rows = cut(one.join(two, ["left_item", "right_item"]).filter("first < second and x is not null and y is not null"))
    ranked = rows.select("first", "second", "x", "y", _average_rank("x", ["first", "second"]).alias("rx"), _average_rank("y", ["first", "second"]).alias("ry"))
    out = ranked.groupBy("first", "second").agg(F.count("*").alias("pairs"), correlation("x", "y").alias("pearson"), correlation("rx", "ry").alias("spearman"))
    return out.select("first", "second", "pairs", "pearson", correlation_p(F.col("pearson"), F.col("pairs")).alias("pearson_p"), "spearman", correlation_p(F.col("spearman"), F.col("pairs")).alias("spearman_p"))


def node_changes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(first, second, node, degree_change, strength_change) of every node in every two networks; a missing node counts 0."""
    d = cut(graph.degrees(nodes, edges).select("network_id", "node", "degree", "strength"))
    names = cut(d.select("network_id").distinct())
    pairs = names.withColumnRenamed("network_id", "first").join(names.withColumnRenamed("network_id", "second"), F.col("first") < F.col("second"))
    rows = d.join(cut(pairs.select("first", "second", F.explode(F.array("first", "second")).alias("network_id"))), "network_id")
    sign = F.when(F.col("network_id") == F.col("second"), 1).otherwise(-1)
    return rows.groupBy("first", "second", "node").agg(F.sum(sign * F.col("degree")).alias("degree_change"), F.sum(sign * F.col("strength")).alias("strength_change"))


def compare_cohorts(rows: DataFrame, specs: DataFrame, keys: list[str], comparisons: DataFrame, tau: float, metric: str = "jaccard", min_units: int = 100) -> tuple[DataFrame, DataFrame]:
    """(summary, failures) of a list of comparisons (comparison, first, second) of cohorts (cohort_id, keys) as in ``filters.cohorts``.
    All cohorts are counted in one keyed job; a comparison with a cohort of fewer than ``min_units`` units fails."""
    tagged = cut(filters.cohorts(rows, specs, keys))
    size = cut(tagged.groupBy("cohort_id").agg(F.count_distinct("unit").alias("units")))
    wanted = comparisons
    for side in ("first", "second"):
        wanted = wanted.join(size.withColumnsRenamed({"cohort_id": side, "units": f"{side}_units"}), side, "left").fillna(0, [f"{side}_units"])
    wanted = cut(wanted.withColumn("_ok", (F.col("first_units") >= min_units) & (F.col("second_units") >= min_units)))
    used = wanted.filter("_ok").select(F.explode(F.array("first", "second")).alias("cohort_id")).distinct()
    scored = contingency.pair_counts(tagged.join(used, "cohort_id", "left_semi"), ["cohort_id"]).withColumn("similarity", F.round(METRICS[metric](), 6))
    scored = cut(scored.select("cohort_id", "left_item", "right_item", "similarity"))
    side = lambda name, value: scored.select(F.col("cohort_id").alias(name), "left_item", "right_item", F.col("similarity").alias(value))
    asked = wanted.filter("_ok").drop("_ok")
    x = asked.join(side("first", "x"), "first")
    y = asked.select("comparison", "second").join(side("second", "y"), "second").drop("second")
    both = x.join(y, ["comparison", "left_item", "right_item"], "left").fillna(0.0, ["y"])
    facts = graph.compare_edges(both, tau, ["comparison"])
    summary = asked.join(facts, "comparison", "left")
    return summary, wanted.filter("not _ok").select("comparison", "first", "second", "first_units", "second_units")


def grid_summary(results: DataFrame, by: list[str], scores: list[str]) -> DataFrame:
    """Means of score columns of a grid by any of its parameters, with the number of configurations."""
    return results.groupBy(*by).agg(*[F.avg(c).alias(c) for c in scores], F.count("*").alias("configurations"))


def trade_off(results: DataFrame, dataset: list[str], first: str, second: str, k: int = 10) -> DataFrame:
    """The ``k`` configurations of each dataset with the best mean rank by two scores; ties by the other columns."""
    w = Window.partitionBy(*dataset)
    place = lambda c: F.rank().over(w.orderBy(F.desc_nulls_last(c)))
    out = results.withColumn("mean_rank", (place(first) + place(second)) / 2)
    rest = [c for c in results.columns if c not in dataset]
    return out.withColumn("_k", F.row_number().over(w.orderBy("mean_rank", *rest))).filter(F.col("_k") <= k).drop("_k")
