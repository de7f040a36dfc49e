"""Comparisons of groups: distribution summaries, ranks, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.stats import chi2_sf, erfc, kolmogorov_p

from .keys import KEY, key_of
from .lineage import cut
from .ordered import in_ranges, ranks, running
from .quantiles import quantiles
from .significance import adjusted


def _beside(base: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Columns of two frames with a row for each group side by side; a null group is one."""
    found = found.withColumn("_of", key_of(by)).drop(*by)
    return base.withColumn(KEY, key_of(by)).join(found, F.col(KEY) == F.col("_of"), "left").drop(KEY, "_of")


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, median, iqr, p10, p90, mean, sd, min, max); quantiles interpolate and are exact."""
    basic = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(df, by, value, (0.1, 0.25, 0.5, 0.75, 0.9)).drop("n")
    out = _beside(basic, q, by)
    return out.select(*by, "n", F.col("q")[2].alias("median"), (F.col("q")[3] - F.col("q")[1]).alias("iqr"), F.col("q")[0].alias("p10"), F.col("q")[4].alias("p90"), "mean", "sd", "min", "max")


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, median)."""
    return quantiles(df.select(F.col(group).alias("g"), F.col(value).alias("_value")), ["g"], "_value", (0.5,)).select("g", F.col("q")[0].alias("median"))


def value_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, x, c): counts of each value. What follows works on these, so on distinct values and not on rows."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("x")).agg(F.count("*").alias("c"))


def _up_to(rows: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """Adds for each name the sum of a value over the group's rows up to this x, and as ``<name>_all`` over all of them."""
    rows = base = in_ranges(rows, by, "x")
    for name, value in values.items():
        rows = running(rows, by, "x", value, name)
    size = base.groupBy(key_of(by)).agg(*[F.sum(value).alias(f"{name}_all") for name, value in values.items()])
    return rows.withColumn(KEY, key_of(by)).join(size, KEY).drop(KEY, "_range")


def ecdf(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, x, share of values up to x)."""
    return _up_to(value_counts(df, group, value), ["g"], n=F.col("c")).select("g", "x", (F.col("n") / F.col("n_all")).alias("share"))


def lorenz(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, x, units, total): cumulative shares of units and of the value, smallest values first; of a group whose values add up to 0
    the total is that of equal values."""
    rows = _up_to(value_counts(df, group, value), ["g"], n=F.col("c"), m=F.col("c") * F.col("x"))
    units = F.col("n") / F.col("n_all")
    return rows.select("g", "x", units.alias("units"), F.when(F.col("m_all") == 0, units).otherwise(F.try_divide("m", "m_all")).alias("total"))


def _pairs(counts: DataFrame) -> DataFrame:
    """Values that either of two groups has, for every two groups: (g1, g2, x, c1, c2). Each count goes to the pairs of its group."""
    counts = cut(counts)
    other = cut(counts.select(F.col("g").alias("h")).distinct())
    first = F.col("g") < F.col("h")
    rows = counts.join(other, F.col("g") != F.col("h")).select(F.least("g", "h").alias("g1"), F.greatest("g", "h").alias("g2"), "x", F.when(first, F.col("c")).otherwise(0).alias("c1"), F.when(first, 0).otherwise(F.col("c")).alias("c2"))
    return rows.groupBy("g1", "g2", "x").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))


def kolmogorov_smirnov(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g1, g2, n1, n2, d, p_value) of every two groups."""
    rows = _up_to(_pairs(value_counts(df, group, value)), ["g1", "g2"], s1=F.col("c1"), s2=F.col("c2"))
    gap = F.abs(F.col("s1") / F.col("s1_all") - F.col("s2") / F.col("s2_all"))
    out = rows.groupBy("g1", "g2", F.col("s1_all").alias("n1"), F.col("s2_all").alias("n2")).agg(F.max(gap).alias("d"))
    return out.withColumn("p_value", kolmogorov_p(F.col("d"), F.col("n1"), F.col("n2")))


def cliffs_delta(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g1, g2, delta): P(first > second) - P(first < second)."""
    rows = _up_to(_pairs(value_counts(df, group, value)), ["g1", "g2"], s1=F.col("c1"), s2=F.col("c2"))
    below, above = F.col("s2") - F.col("c2"), F.col("s2_all") - F.col("s2")
    return rows.groupBy("g1", "g2").agg((F.sum(F.col("c1") * (below - above)) / (F.sum("c1") * F.sum("c2"))).alias("delta"))


def _ranked(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of value counts: (g, k, r) sizes and rank sums, ties at their mean rank; and (n, ties)."""
    counts = cut(counts)
    values = cut(ranks(counts.groupBy("x").agg(F.sum("c").alias("t")), "x", "t"))
    size = values.agg(F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("n"), F.sum(F.expr("double(t) * t * t - t")).alias("ties"))
    return counts.join(values, "x").groupBy("g").agg(F.sum("c").alias("k"), F.sum(F.col("rank") * F.col("c")).alias("r")), size


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """(groups, n, h, p_value), ties corrected; ranks come from value counts. Values that are all alike differ in nothing: h is 0 and
    p 1; without values, or with one group, both are null."""
    sums, size = _ranked(value_counts(df, group, value))
    out = sums.agg(F.count("*").alias("groups"), F.sum(F.col("r") * F.col("r") / F.col("k")).alias("q")).join(size, F.lit(True))
    n = F.col("n")
    untied = 1 - F.try_divide("ties", n * n * n - n)
    h = F.when(untied > 0, F.try_divide(12 * F.col("q"), n * (n + 1)) / untied - 3 * (n + 1) / untied).otherwise(F.when(n > 0, 0.0))
    h = F.when(F.col("groups") > 1, h)
    return out.select("groups", n.cast("long").alias("n"), h.alias("h")).withColumn("p_value", chi2_sf(F.col("h"), F.col("groups").cast("double") - 1))


def welch(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """(t, df, cohens_d) of two groups; null where what they divide by is 0 (no spread) or a group has fewer than two values."""
    side = lambda g, s: df.filter(F.col(group) == g).agg(F.avg(value).alias(f"m{s}"), F.var_samp(value).alias(f"v{s}"), F.count(value).cast("double").alias(f"n{s}"))
    both = side(first, 1).join(side(second, 2), F.lit(True))
    both = both.selectExpr("m1", "m2", "v1", "v2", "n1", "n2", "try_divide(v1, n1) as e1", "try_divide(v2, n2) as e2")
    return both.selectExpr("try_divide(m1 - m2, sqrt(e1 + e2)) as t", "try_divide(pow(e1 + e2, 2), try_divide(e1 * e1, n1 - 1) + try_divide(e2 * e2, n2 - 1)) as df", "try_divide(m1 - m2, sqrt(try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))) as cohens_d")


def dunn(df: DataFrame, group: str, value: str, method: str = "bh") -> DataFrame:
    """(g1, g2, z, p_value, q_value) of every two groups after a rank test over all groups; ties corrected, q over all pairs. Where
    all values are alike z is 0."""
    sums, size = _ranked(value_counts(df, group, value))
    sums = cut(sums)
    one, two = (sums.select(F.col("g").alias(f"g{i}"), F.col("k").alias(f"k{i}"), (F.col("r") / F.col("k")).alias(f"m{i}")) for i in (1, 2))
    rows = one.join(two, F.col("g1") < F.col("g2")).join(size, F.lit(True))
    spread = F.expr("sqrt(greatest(0D, n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1 / k1 + 1 / k2))")
    rows = rows.withColumn("z", F.coalesce(F.try_divide(F.col("m1") - F.col("m2"), spread), F.lit(0.0))).withColumn("p_value", erfc(F.abs("z") / 2**0.5))
    return adjusted(rows.withColumn("_all", F.lit(0)), ["_all"], method=method).select("g1", "g2", "z", "p_value", "q_value")


def ordered_dunn_trend(df: DataFrame, order: DataFrame, group: str, value: str) -> DataFrame:
    """(ascending, min_adjacent_p): whether medians rise in the given order (group, place), and the least Dunn p of neighbours."""
    df = cut(df.select(group, value))
    middle = medians(df, group, value).join(order.select(F.col(group).alias("g"), "place"), "g")
    w = Window.orderBy("place")
    steps = cut(middle.select("g", "median", F.lag("median").over(w).alias("before"), F.lag("g").over(w).alias("h")))
    pairs = dunn(df, group, value)
    near = steps.filter("h is not null").select(F.least("g", "h").alias("g1"), F.greatest("g", "h").alias("g2")).join(pairs, ["g1", "g2"])
    return steps.agg(F.coalesce(F.bool_and(F.col("median") >= F.col("before")), F.lit(True)).alias("ascending")).join(near.agg(F.min("p_value").alias("min_adjacent_p")), F.lit(True))


def decisions(df: DataFrame, group: str, value: str, min_median: float = 1.0, min_share: float = 0.5, min_delta: float = 0.147, alpha: float = 0.05) -> DataFrame:
    """(median_range, ks_share, max_delta, median_ok, ks_ok, delta_ok): the range of group medians, the share of group pairs whose
    distributions differ, and the largest absolute Cliff's delta, each against its limit."""
    df = cut(df.select(group, value))
    middle = medians(df, group, value).agg((F.max("median") - F.min("median")).alias("median_range"))
    ks = kolmogorov_smirnov(df, group, value).agg(F.avg((F.col("p_value") < alpha).cast("int")).alias("ks_share"))
    delta = cliffs_delta(df, group, value).agg(F.max(F.abs("delta")).alias("max_delta"))
    out = middle.join(ks, F.lit(True)).join(delta, F.lit(True))
    return out.select("*", (F.col("median_range") >= min_median).alias("median_ok"), (F.col("ks_share") >= min_share).alias("ks_ok"), (F.col("max_delta") >= min_delta).alias("delta_ok"))


def mann_whitney(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """(n1, n2, u, z, p_value) of two groups; ties corrected, with continuity correction. u counts pairs in which the first is larger,
    ties half. Where all values are alike z is 0; where a group has no values u, z and p are null."""
    sums, size = _ranked(value_counts(df.filter(F.col(group).isin(first, second)), group, value))
    both = sums.agg(*[F.max(F.when(F.col("g") == g, F.col(c))).cast("double").alias(f"{c}{i}") for i, g in ((1, first), (2, second)) for c in ("k", "r")]).join(size, F.lit(True))
    both = both.withColumn("u", F.expr("r1 - k1 * (k1 + 1) / 2")).withColumn("away", F.expr("u - k1 * k2 / 2"))
    spread = F.expr("sqrt(greatest(0D, k1 * k2 / 12 * (n + 1 - try_divide(ties, n * (n - 1)))))")
    z = F.when(F.col("away").isNotNull(), F.coalesce(F.try_divide(F.signum("away") * F.greatest(F.abs("away") - 0.5, F.lit(0.0)), spread), F.lit(0.0)))
    return both.select(F.col("k1").cast("long").alias("n1"), F.col("k2").cast("long").alias("n2"), "u", z.alias("z"), erfc(F.abs(z) / 2**0.5).alias("p_value"))
