"""Significance of item pairs and false-discovery control, per family of tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.stats import erfc, fisher_p, log_odds_mle

from .keys import key_of
from .lineage import cut
from .ordered import in_ranges, running


def g_statistic(eps: float = 0.5) -> Column:
    """Likelihood ratio statistic of a 2x2 table with ``eps`` added to every cell."""
    a, b, c, d = (F.col(x) + eps for x in "abcd")
    n = a + b + c + d
    cells = [(a, (a + b) * (a + c)), (b, (a + b) * (b + d)), (c, (c + d) * (a + c)), (d, (c + d) * (b + d))]
    return F.greatest(F.lit(0.0), 2 * sum((o * F.log(o * n / e) for o, e in cells), F.lit(0.0)))


def g_test_p(tail: str = "two-sided", eps: float = 0.5) -> Column:
    p = erfc(F.sqrt(g_statistic(eps) / 2))
    if tail == "two-sided":
        return p
    with_it = (F.col("a") * F.col("d") > F.col("b") * F.col("c")) if tail == "greater" else (F.col("a") * F.col("d") < F.col("b") * F.col("c"))
    return F.when(with_it, p / 2).otherwise(1 - p / 2)


def fisher(tail: str = "two-sided") -> Column:
    return fisher_p(tail)(F.col("a"), F.col("fl"), F.col("fr"), F.col("n"))


def hypergeometric_sf() -> Column:
    return fisher("greater")


def adjusted(df: DataFrame, family: list[str], p: str = "p_value", method: str = "bh", out: str = "q_value") -> DataFrame:
    """q-values by ``bh``, ``by`` or ``bonferroni`` within a family; rows with a null p are not tests and stay null. A null family is
    a family.

    Distinct p are counted first; their places and the least of what follows come from running totals over ranges, so a family may
    hold all rows.
    """
    df = cut(df.withColumn("_of", key_of(family)))
    tests = df.filter(F.col(p).isNotNull()).groupBy("_of", F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    size = tests.groupBy("_of").agg(F.sum("_c").alias("_m"))
    if method == "bonferroni":
        found = tests.join(size, "_of").select("_of", "_p", F.least(F.lit(1.0), F.col("_p") * F.col("_m")).alias(out))
    else:
        rows = running(in_ranges(tests, ["_of"], "_p"), ["_of"], "_p", F.col("_c"), "_i").join(size, "_of")
        m = F.col("_m").cast("double")
        few = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least("_m", F.lit(1000))), F.lit(0.0), lambda s, k: s + 1 / k)
        harmonic = F.when(m <= 1000, few).otherwise(F.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m))
        rows = rows.withColumn("_q", F.col("_p") * m / F.col("_i") * (harmonic if method == "by" else F.lit(1.0)))
        rows = running(cut(rows), ["_of"], "_p", F.col("_q"), "_least", "min", backwards=True)
        found = rows.select("_of", "_p", F.least(F.lit(1.0), "_least").alias(out))
    return _joined(df, found, p, out)


def _joined(df: DataFrame, found: DataFrame, p: str, out: str) -> DataFrame:
    found = found.withColumnRenamed("_of", "_family")
    return df.join(found, (F.col("_of") == F.col("_family")) & (F.col(p) == F.col("_p")), "left").select(*[F.col(f"`{c}`") for c in df.columns if c != "_of"], F.col(out))


def fdr(edges: DataFrame, family: list[str], p: Column, alpha: float = 0.05, method: str = "bh", mode: str = "hard", min_weight: float = 0.0) -> DataFrame:
    """p_value, q_value, keep and similarity_pruned of edges with a similarity: kept edges keep it (``hard``) or have it shrunk by
    1 - q/alpha (``soft``), others lose it. Edges under ``min_weight`` are not tested."""
    tested = F.col("similarity") >= min_weight
    out = adjusted(edges.withColumn("p_value", F.when(tested, p)), family, method=method)
    keep = F.coalesce(F.col("q_value") <= alpha, F.lit(False))
    value = F.col("similarity") if mode == "hard" else F.col("similarity") * F.greatest(F.lit(0.0), 1 - F.col("q_value") / alpha)
    return out.withColumn("keep", keep).withColumn("similarity_pruned", F.when(keep, value).otherwise(0.0))


def prune(edges: DataFrame, family: list[str], alpha: float = 0.05, min_total: int = 20, min_both: int = 3, tau: float | None = None) -> DataFrame:
    """Exact tests with BH only where there is enough support (and the similarity reaches tau); the others stay untested."""
    enough = (F.col("n") >= min_total) & (F.col("a") >= min_both)
    if tau is not None:
        enough &= F.col("similarity") >= tau
    a, fl, fr, n = (F.when(enough, F.col(c)) for c in ("a", "fl", "fr", "n"))
    out = adjusted(edges.withColumn("p_value", fisher_p()(a, fl, fr, n)), family)
    return out.withColumn("keep", F.coalesce(F.col("q_value") <= alpha, F.lit(False)))


def retention(pruned: DataFrame, by: list[str], tau: float) -> DataFrame:
    """Of edges with a similarity of at least tau: how many could be tested, and which share of those is significant."""
    edges = pruned.filter(F.col("similarity") >= tau)
    out = edges.groupBy(*by).agg(F.count("*").alias("n_edges"), F.count("p_value").alias("n_testable"), F.count_if("keep").alias("n_significant"))
    return out.withColumn("retention", F.when(F.col("n_testable") > 0, F.col("n_significant") / F.col("n_testable")))


def backbone(edges: DataFrame, family: list[str], alpha: float = 0.05, min_support: int = 5, min_margin: int = 20, tau: float = 1.0, tail: str = "greater", method: str = "bh") -> DataFrame:
    """log_odds (maximum likelihood), p_value, q_value, gate and weight 1/(1+exp(-log_odds/tau)) of screened edges; edges that the
    screen leaves out are not tested and have no gate."""
    screened = (F.col("a") >= min_support) & (F.col("fl") >= min_margin) & (F.col("fr") >= min_margin)
    cells = [F.when(screened, F.col(c)) for c in ("a", "fl", "fr", "n")]
    out = adjusted(edges.withColumn("log_odds", log_odds_mle(*cells)).withColumn("p_value", fisher_p(tail)(*cells)), family, method=method)
    gate = F.coalesce((F.col("q_value") <= alpha) & (F.col("log_odds") > 0), F.lit(False))
    return out.withColumn("gate", gate).withColumn("weight", F.when(gate, 1 / (1 + F.exp(-F.col("log_odds") / tau))).otherwise(0.0))


def through_backbone(edges: DataFrame, family: list[str], hard: bool = True, soft: bool = False, tau: float = 1.0, alpha: float = 0.05, tail: str = "two-sided", **options) -> DataFrame:
    """``backbone`` with its effect on the similarity: ``hard`` sets edges without a gate to 0, ``soft`` multiplies the tested ones by
    the logistic of their log odds."""
    out = backbone(edges, family, alpha=alpha, tau=tau, tail=tail, **options)
    value = F.col("similarity") * F.when(F.col("log_odds").isNotNull(), 1 / (1 + F.exp(-F.col("log_odds") / tau))).otherwise(1.0) if soft else F.col("similarity")
    return out.withColumn("similarity", F.when(F.col("gate"), value).otherwise(0.0) if hard else value)
