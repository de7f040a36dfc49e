"""Trends of monthly series: decomposition and its diagnostics, trend tables, participation layers, stratifiers, recovery.

A series has (keys, month, value) with a row for every month. Work is windows and aggregates over keys; only the variance correction
of Hamed and Rao takes a series (some hundred months at most) as one group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.stats import chi2_sf, erfc

from .filters import continuous_entities, stratify
from .lineage import cut
from .temporal import breaks, mann_kendall, monthly


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal value."""
    return erfc(F.abs(z) / math.sqrt(2))


def decompose(series: DataFrame, keys: list[str], value: str = "count", model: str = "additive", period: int = 12) -> DataFrame:
    """Adds trend, seasonal and residual. The trend is the centred moving mean over ``period``; its ends continue the line through
    the ``period`` nearest known values. The season is the mean deviation (``multiplicative``: ratio) of a month of the year,
    centred. Series shorter than two periods have null parts."""
    half = period // 2
    w = Window.partitionBy(*keys).orderBy("month")
    x = F.col(value).cast("double")
    inner, outer = F.avg(x).over(w.rowsBetween(-half, half - 1)), F.avg(x).over(w.rowsBetween(1 - half, half))
    rows = series.withColumn("_i", F.row_number().over(w).cast("double"))
    rows = rows.withColumn("_m", F.when(F.count(x).over(w.rowsBetween(-half, half)) == 2 * half + 1, (inner + outer) / 2))
    known = Window.partitionBy(*keys)
    rows = cut(rows.withColumn("_a", F.min(F.when(F.col("_m").isNotNull(), F.col("_i"))).over(known)).withColumn("_b", F.max(F.when(F.col("_m").isNotNull(), F.col("_i"))).over(known)))
    near = {"f": F.col("_i") < F.col("_a") + period, "l": F.col("_i") > F.col("_b") - period}
    lines = rows.groupBy(*keys).agg(*[f(F.when(c, F.col("_m")), F.when(c, F.col("_i"))).alias(f"_{e}{n}") for e, c in near.items() for n, f in (("s", F.regr_slope), ("c", F.regr_intercept))], F.count(x).alias("_n"))
    rows = rows.join(lines, keys) if keys else rows.join(lines, F.lit(True))
    end = lambda e: F.col(f"_{e}c") + F.col(f"_{e}s") * F.col("_i")
    rows = rows.withColumn("trend", F.coalesce("_m", F.when(F.col("_i") < F.col("_a"), end("f")).when(F.col("_i") > F.col("_b"), end("l"))))
    rows = rows.withColumn("trend", F.when(F.col("_n") >= 2 * period, F.col("trend")))
    times = model == "multiplicative"
    away = F.when(F.col("trend") != 0, x / F.col("trend")) if times else x - F.col("trend")
    of_month = Window.partitionBy(*keys, F.pmod(F.col("_i") - 1, F.lit(period)))
    rows = rows.withColumn("_e", F.avg(F.when(F.col("_m").isNotNull(), away)).over(of_month))
    first = F.avg(F.when(F.col("_i") <= period, F.col("_e"))).over(known)
    rows = rows.withColumn("seasonal", F.try_divide("_e", first) if times else F.col("_e") - first)
    rest = F.try_divide(x, F.col("trend") * F.col("seasonal")) if times else x - F.col("trend") - F.col("seasonal")
    return rows.withColumn("residual", rest).select(*series.columns, "trend", "seasonal", "residual")


def diagnostics(parts: DataFrame, keys: list[str], value: str = "count", lags: tuple[int, ...] = (6, 12)) -> DataFrame:
    """Of a decomposed series: explained (1 - variance of residuals over that of values), ljung_box_<lag> with its p, the residuals'
    slope by month number and their mean."""
    w = Window.partitionBy(*keys).orderBy("month")
    rows = parts.withColumn("_i", F.row_number().over(w).cast("double")).withColumn("_e", F.col("residual") - F.avg("residual").over(Window.partitionBy(*keys)))
    for k in range(1, max(lags) + 1):
        rows = rows.withColumn(f"_r{k}", F.col("_e") * F.lag("_e", k).over(w))
    e = F.col("_e")
    n = F.count(e).cast("double")
    q = lambda most: n * (n + 2) * sum((F.try_divide(F.pow(F.try_divide(F.sum(f"_r{k}"), F.sum(e * e)), F.lit(2.0)), n - k) for k in range(1, most + 1)), F.lit(0.0))
    out = rows.groupBy(*keys).agg((1 - F.try_divide(F.var_pop("residual"), F.var_pop(value))).alias("explained"), F.regr_slope("residual", "_i").alias("residual_slope"), F.avg("residual").alias("residual_mean"), *[F.when(n > k, q(k)).alias(f"ljung_box_{k}") for k in lags])
    return out.select("*", *[chi2_sf(F.col(f"ljung_box_{k}"), F.lit(float(k))).alias(f"ljung_box_p_{k}") for k in lags])


def hamed_rao_factor(x: np.ndarray) -> float:
    """What the variance of Mann-Kendall's S is multiplied with: from the autocorrelations of the ranks of the values about their
    Theil-Sen line that lie outside the 95 % band of white noise."""
    n, t = len(x), np.arange(len(x))
    i, j = np.triu_indices(n, 1)
    x = x - np.median((x[j] - x[i]) / (j - i)) * t
    rank = pd.Series(x).rank().to_numpy()
    c = rank - rank.mean()
    if not c.any():
        return 1.0
    k = np.arange(1, n - 2)
    rho = np.array([(c[:-m] * c[m:]).sum() for m in k]) / (c * c).sum()
    rho[np.abs(rho) <= 1.959963984540054 / math.sqrt(n)] = 0
    return float(1 + 2 / (n * (n - 1) * (n - 2)) * ((n - k) * (n - k - 1) * (n - k - 2) * rho).sum())


def hamed_rao(series: DataFrame, keys: list[str], value: str = "count") -> DataFrame:
    """mann_kendall with a variance corrected for autocorrelation where that leaves it positive; z and p are null for series of fewer
    than five values or of one value throughout."""
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.dropna(subset=[value]).sort_values("month")[value].to_numpy(float)
        f = hamed_rao_factor(x) if len(x) >= 5 and len(set(x)) > 1 else None
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), f]], columns=[*keys, "factor"])

    plain = mann_kendall(series, keys, value)
    found = series.select(*keys, "month", value).groupBy(*keys).applyInPandas(factor, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "factor double"]))
    out = plain.join(found, keys, "left") if keys else plain.join(found, F.lit(True), "left")
    out = out.withColumn("variance", F.when(F.col("factor") > 0, F.col("variance") * F.col("factor")).otherwise(F.col("variance")))
    z = F.when(F.col("factor").isNotNull() & (F.col("variance") > 0), (F.col("s") - F.signum("s")) / F.sqrt("variance"))
    return out.withColumn("z", z).withColumn("p_value", normal_p(z)).drop("factor")


def trend_table(series: DataFrame, keys: list[str], value: str = "count") -> DataFrame:
    """One row per series: months, mean, sd, tau and p (Hamed-Rao), seasonal tau and p, amplitude of the season, break months."""
    series = cut(series)
    base = series.groupBy(*keys).agg(F.count(value).alias("months"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    plain = hamed_rao(series, keys, value).select(*keys, "tau", "p_value")
    seasonal = mann_kendall(series, keys, value, F.month("month")).select(*keys, F.col("tau").alias("seasonal_tau"), normal_p(F.col("z")).alias("seasonal_p"))
    swing = decompose(series, keys, value).groupBy(*keys).agg((F.max("seasonal") - F.min("seasonal")).alias("amplitude"))
    found = breaks(series, keys, value).groupBy(*keys).agg(F.sort_array(F.collect_list("month")).alias("breaks"))
    out = base
    for part in (plain, seasonal, swing, found):
        out = out.join(part, keys, "left") if keys else out.join(part, F.lit(True), "left")
    return out


def layers(df: DataFrame, entity: str | None, year: str, first: int, last: int) -> DataFrame:
    """Rows of the span tagged with ``layer``: ``full``, and once more ``continuous`` for entities present in every year. Without an
    entity column only ``full``."""
    full = df.filter(F.col(year).between(first, last)).withColumn("layer", F.lit("full"))
    if entity is None or entity not in df.columns:
        return full
    return full.unionByName(continuous_entities(df, entity, year, first, last).withColumn("layer", F.lit("continuous")))


def layered_series(df: DataFrame, date: str, entity: str | None, year: str, first: int, last: int, keys: list[str] = ()) -> DataFrame:
    """Monthly series of each participation layer."""
    return monthly(layers(df, entity, year, first, last), date, ["layer", *keys])


def stratified_series(df: DataFrame, date: str, stratifiers: list[str], keys: list[str] = ()) -> DataFrame:
    """Monthly series of every level of every stratifier (and of ``keys`` within it), all in one job."""
    return monthly(stratify(df, stratifiers), date, ["stratum_key", "stratum_level", *keys])


def stratified_trends(df: DataFrame, date: str, stratifiers: list[str], keys: list[str] = ()) -> DataFrame:
    return trend_table(stratified_series(df, date, stratifiers, keys), ["stratum_key", "stratum_level", *keys])


def recovery(series: DataFrame, keys: list[str], baseline: tuple[int, int], value: str = "count", drop: float = -10.0) -> DataFrame:
    """Years against a baseline span: (keys, year, mean, baseline_mean, percent, months_below, worst_month, worst_change). A month's
    change is in percent of the mean of the same month of the year in the baseline; ``months_below`` have one under ``drop``."""
    years = F.year("month")
    base = series.filter(years.between(*baseline)).groupBy(*keys, F.month("month").alias("_m")).agg(F.avg(value).alias("_base"))
    rows = series.withColumn("_m", F.month("month")).join(base, [*keys, "_m"], "left")
    rows = rows.withColumn("_change", F.when(F.col("_base") > 0, (F.col(value) - F.col("_base")) * 100 / F.col("_base")))
    per = rows.groupBy(*keys, years.alias("year")).agg(F.avg(value).alias("mean"), F.count_if(F.col("_change") < drop).alias("months_below"), F.min(F.when(F.col("_change").isNotNull(), F.struct(F.col("_change").alias("c"), F.col("month").alias("m")))).alias("_w"))
    over = series.filter(years.between(*baseline)).groupBy(*keys).agg(F.avg(value).alias("baseline_mean"))
    out = per.join(over, keys, "left") if keys else per.join(over, F.lit(True), "left")
    percent = F.when(F.col("baseline_mean") > 0, F.col("mean") * 100 / F.col("baseline_mean"))
    return out.select(*keys, "year", "mean", "baseline_mean", percent.alias("percent"), "months_below", F.col("_w.m").alias("worst_month"), F.col("_w.c").alias("worst_change"))
