"""Disparity of a 0/1 outcome between the levels of a group, by item: odds ratios, risk ratios and risk differences against a
reference level, with standard errors that are robust to clusters.

With one categorical predictor the models are saturated, so a level's mean is its estimate, and the sandwich needs only the sum of
residuals of each (item, level, cluster): everything is aggregates over counts. What is small enough for Python is one row per item
and measure, for the joint test of all levels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.stats import chi2_sf, erfc

from .lineage import cut
from .significance import adjusted

MEASURES = ("OR", "RR", "RD")


def cluster_counts(inc: DataFrame, units: DataFrame, group: str, cluster: str) -> DataFrame:
    """(item, level, cluster, k, n): units of a level and cluster that have the item, and all its units. ``units`` has one row per unit;
    those without a level are left out, those without a cluster are a cluster."""
    units = units.select("unit", F.col(group).alias("level"), F.col(cluster).alias("cluster")).filter("level is not null")
    n = cut(units.groupBy("level", "cluster").agg(F.count("*").alias("n")))
    k = cut(inc.select("unit", "item").distinct().join(units, "unit", "left").groupBy("item", "level", "cluster").agg(F.count("*").alias("k")))
    items = cut(k.select("item").distinct())  # those of units without a level too, whose counts match no level
    k = k.select(F.col("item").alias("_i"), F.col("level").alias("_l"), F.col("cluster").alias("_c"), "k")
    on = (F.col("item") == F.col("_i")) & (F.col("level") == F.col("_l")) & F.col("cluster").eqNullSafe(F.col("_c"))
    return n.join(items, F.lit(True)).join(k, on, "left").select("item", "level", "cluster", F.coalesce("k", F.lit(0)).alias("k"), "n")


def estimates(counts: DataFrame, reference, min_clusters: int = 2, alpha: float = 0.05) -> DataFrame:
    """(item, measure, level, estimate, se, z, p_value, q_value, significant) against the reference level; OR and RR are logs.

    A level without or only with outcomes gets half an outcome more and one unit more. q is by Benjamini and Hochberg within a
    measure. Levels in fewer than ``min_clusters`` clusters are left out; an item without the reference level has no rows.
    """
    counts = cut(counts)
    per = counts.groupBy("item", "level").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("clusters"))
    edge = (F.col("k") == 0) | (F.col("k") == F.col("n"))
    per = cut(per.withColumn("p", F.when(edge, (F.col("k") + 0.5) / (F.col("n") + 1)).otherwise(F.col("k") / F.col("n"))))
    kept = per.filter(F.col("clusters") >= min_clusters)
    size = per.groupBy("item").agg(F.sum("n").alias("units"), F.count("*").alias("levels")).join(counts.groupBy("item").agg(F.count_distinct(F.struct("cluster")).alias("g")), "item")
    away = counts.join(kept.select("item", "level", "p"), ["item", "level"]).select("item", "level", F.struct("cluster").alias("of"), (F.col("k") - F.col("n") * F.col("p")).alias("u"))
    base = away.filter(F.col("level") == reference).select("item", "of", F.col("u").alias("ur"))
    sums = away.join(base, ["item", "of"], "left").groupBy("item", "level").agg(F.sum(F.col("u") * F.col("u")).alias("uu"), F.coalesce(F.sum(F.col("u") * F.col("ur")), F.lit(0.0)).alias("ur"))
    rows = cut(kept.join(sums, ["item", "level"]).join(size, "item"))
    ref = rows.filter(F.col("level") == reference).select("item", *[F.col(c).alias(f"{c}0") for c in ("n", "p", "uu")])
    rows = rows.filter(F.col("level") != reference).join(ref, "item")
    link = {"OR": (lambda p: F.log(p / (1 - p)), lambda n, p: n * p * (1 - p)), "RR": (F.log, lambda n, p: n * p), "RD": (lambda p: p, lambda n, p: n)}
    small = F.when(F.col("g") > 1, F.col("g") / (F.col("g") - 1) * (F.col("units") - 1) / F.greatest(F.col("units") - F.col("levels"), F.lit(1)))
    entries = []
    for name, (value, weight) in link.items():
        a, a0 = weight(F.col("n"), F.col("p")), weight(F.col("n0"), F.col("p0"))
        variance = small * (F.col("uu") / (a * a) + F.col("uu0") / (a0 * a0) - 2 * F.col("ur") / (a * a0))
        entries.append(F.struct(F.lit(name).alias("measure"), (value(F.col("p")) - value(F.col("p0"))).alias("estimate"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("se")))
    out = rows.select("item", "level", F.explode(F.array(*entries)).alias("e")).select("item", "e.measure", "level", "e.estimate", "e.se")
    out = out.withColumn("z", F.when(F.col("se") > 0, F.col("estimate") / F.col("se"))).withColumn("p_value", erfc(F.abs("z") / 2**0.5))
    return adjusted(out, ["measure"]).withColumn("significant", F.coalesce(F.col("q_value") <= alpha, F.lit(False)))


def joint_test(counts: DataFrame, reference, measure: str = "OR") -> DataFrame:
    """(item, chi2, df, p_value): Wald test that all levels of an item equal the reference. An item's clusters are pre-aggregated, so
    a group has one row for each level and cluster; items are many and run in parallel."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        table_k, table_n = (pdf.pivot_table(index="cluster", columns="level", values=c, aggfunc="sum", fill_value=0) for c in ("k", "n"))
        levels = [reference, *[c for c in table_k.columns if c != reference]]
        if reference not in table_k.columns or len(levels) < 2:
            return pd.DataFrame([[pdf["item"].iloc[0], None, 0]], columns=["item", "chi2", "df"])
        k, n = table_k[levels].to_numpy(float), table_n[levels].to_numpy(float)
        total, units = k.sum(0), n.sum(0)
        edge = (total == 0) | (total == units)
        p = np.where(edge, (total + 0.5) / (units + 1), total / units)
        a = {"OR": units * p * (1 - p), "RR": units * p, "RD": units}[measure]
        beta = {"OR": np.log(p / (1 - p)), "RR": np.log(p), "RD": p}[measure]
        u = (k - n * p) / a
        g, rows = len(u), units.sum()
        v = u.T @ u * (g / max(g - 1, 1)) * (rows - 1) / max(rows - len(levels), 1)
        c = np.concatenate([-np.ones((len(levels) - 1, 1)), np.eye(len(levels) - 1)], axis=1)
        d, m = c @ beta, c @ v @ c.T
        return pd.DataFrame([[pdf["item"].iloc[0], float(d @ np.linalg.pinv(m) @ d), int(np.linalg.matrix_rank(m))]], columns=["item", "chi2", "df"])

    out = counts.groupBy("item").applyInPandas(test, "item string, chi2 double, df int")
    return out.withColumn("p_value", F.when(F.col("df") > 0, chi2_sf(F.col("chi2"), F.col("df").cast("double"))))
