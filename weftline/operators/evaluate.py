"""Scores of communities: agreement with labels, cohesion, stability, and the choice of a configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def _two(n):
    return n * (n - 1) / 2


def agreement(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of columns ``x`` and ``y``: one row per object and key. Two partitions
    that are both trivial agree fully."""
    cells = parts.groupBy(*keys, "x", "y").agg(F.count("*").alias("c"))
    xs, ys = (cells.groupBy(*keys, v).agg(F.sum("c").alias("c")) for v in ("x", "y"))
    pairs = lambda df, name: df.groupBy(*keys).agg(F.sum(_two(F.col("c"))).alias(name), F.sum("c").alias(f"{name}_n"), F.sum(F.col("c") * F.log("c")).alias(f"{name}_l"))
    t = pairs(cells, "both").join(pairs(xs, "px"), keys).join(pairs(ys, "py"), keys)
    n = F.col("both_n")
    expect = F.when(n > 1, F.col("px") * F.col("py") / _two(n)).otherwise(0.0)
    spread = (F.col("px") + F.col("py")) / 2 - expect
    h = lambda l: F.log(n) - F.col(l) / n
    mutual = h("px_l") + h("py_l") - h("both_l")
    mean = (h("px_l") + h("py_l")) / 2
    return t.select(*keys, F.when(F.abs(spread) < 1e-12, 1.0).otherwise((F.col("both") - expect) / spread).alias("ari"), F.when(mean < 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), mutual / mean)).alias("nmi"), n.alias("n_labelled"))


def against_labels(communities: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Communities (keys, node, community) against (item, label); nodes without a label don't count."""
    return agreement(communities.join(labels.select(F.col("item").alias("node"), F.col("label").alias("y")), "node").withColumnRenamed("community", "x"), keys)


def cohesion(pairs: DataFrame, communities: DataFrame, keys: list[str]) -> DataFrame:
    """Mean similarity within communities over the mean of all pairs; ``pairs`` is keyed alike and complete, zero pairs too."""
    side = lambda s: communities.select(*keys, F.col("node").alias(f"{s}_item"), F.col("community").alias(s))
    p = pairs.join(side("left"), [*keys, "left_item"]).join(side("right"), [*keys, "right_item"])
    same = F.col("left") == F.col("right")
    out = p.groupBy(*keys).agg(F.avg(F.when(same, F.col("similarity"))).alias("within"), F.avg("similarity").alias("overall"), F.count_if(same).alias("n_within"), F.count("*").alias("n_pairs"))
    return out.withColumn("ics", F.when(F.col("overall") > 0, F.col("within") / F.col("overall")))


def silhouette(pairs: DataFrame, communities: DataFrame, keys: list[str]) -> DataFrame:
    """Mean silhouette by distance 1 - similarity; null with fewer than two communities, 0 for a node alone in its own."""
    pairs, communities = cut(pairs), cut(communities)
    one = pairs.select(*keys, F.col("left_item").alias("node"), F.col("right_item").alias("other"), (1 - F.col("similarity")).alias("d"))
    both = one.unionByName(one.select(*keys, F.col("other").alias("node"), F.col("node").alias("other"), "d"))
    to = both.join(communities.select(*keys, F.col("node").alias("other"), F.col("community").alias("c_other")), [*keys, "other"]).join(communities, [*keys, "node"])
    mean = to.groupBy(*keys, "node", "community", "c_other").agg(F.avg("d").alias("d"))
    own = F.col("community") == F.col("c_other")
    per = mean.groupBy(*keys, "node").agg(F.max(F.when(own, F.col("d"))).alias("a"), F.min(F.when(~own, F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    count = communities.groupBy(*keys).agg(F.count_distinct("community").alias("k"))
    return per.groupBy(*keys).agg(F.avg(s).alias("silhouette")).join(count, keys).select(*keys, F.when(F.col("k") > 1, F.col("silhouette")).alias("silhouette"), F.col("k").alias("n_communities"))


def stability(communities: DataFrame, keys: list[str]) -> DataFrame:
    """Mean adjusted Rand index over all pairs of seeds."""
    one = communities.select(*keys, "node", F.col("seed").alias("s1"), F.col("community").alias("x"))
    two = communities.select(*keys, "node", F.col("seed").alias("s2"), F.col("community").alias("y"))
    return agreement(one.join(two, [*keys, "node"]).filter("s1 < s2"), [*keys, "s1", "s2"]).groupBy(*keys).agg(F.avg("ari").alias("stability"), F.count("*").alias("seed_pairs"))


def hierarchical(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of score columns, over those that are present."""
    total = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return scores.withColumn("hierarchical", F.when(total > 0, value / total))


def over_seeds(scores: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def best_configuration(scores: DataFrame, dataset: list[str], score: str | list[str], parameters: list[str]) -> DataFrame:
    """The row of the highest score of each dataset. Of several scores the first that has a value anywhere in a dataset decides, the
    next ones break ties; then the parameters do."""
    order = [F.desc_nulls_last(s) for s in ([score] if isinstance(score, str) else score)]
    return scores.withColumn("_k", F.row_number().over(Window.partitionBy(*dataset).orderBy(*order, *parameters))).filter("_k = 1").drop("_k")


def first_group(groups: DataFrame) -> DataFrame:
    """(item, label) from (label, items: array, position): an item's first group counts; names lose the ending ``List``."""
    rows = groups.select(F.regexp_replace("label", "List$", "").alias("label"), "position", F.explode("items").alias("item"))
    return rows.groupBy("item").agg(F.min(F.struct("position", "label"))["label"].alias("label"))


def composition(communities: DataFrame, keys: list[str], labels: DataFrame) -> DataFrame:
    """(keys, item, community, size, total, label)."""
    w = Window.partitionBy(*keys)
    out = communities.withColumn("size", F.count("*").over(Window.partitionBy(*keys, "community"))).withColumn("total", F.count("*").over(w))
    return out.withColumnRenamed("node", "item").join(labels, "item", "left").select(*keys, "item", "community", "size", "total", "label")
