"""Monthly series: gap filling, moving statistics, shocks, trends, participation, baselines. Series are keyed by any columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar(df: DataFrame, date: str) -> DataFrame:
    """(month): every month from the first to the last of the data."""
    span = df.agg(F.trunc(F.min(date), "month").alias("a"), F.trunc(F.max(date), "month").alias("b")).filter("a is not null")
    return span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))


def monthly(df: DataFrame, date: str, keys: list[str] = (), window: int = 3) -> DataFrame:
    """(keys, month, count, moving): rows by month over the whole calendar, a month without rows counts 0; trailing mean."""
    counts = df.groupBy(*keys, F.trunc(date, "month").alias("month")).agg(F.count("*").alias("count"))
    grid = calendar(df, date)
    if keys:
        grid = grid.join(df.select(*keys).distinct(), F.lit(True))
    out = grid.join(counts, [*keys, "month"], "left").fillna(0, ["count"])
    return out.withColumn("moving", F.avg("count").over(Window.partitionBy(*keys).orderBy("month").rowsBetween(1 - window, 0)))


def monthly_items(inc: DataFrame, date: str, by: list[str] = (), top: int | None = None) -> DataFrame:
    """(by, month, item, count, n, rate): units with each item, all units of the month (and group), and their share in percent;
    ``top`` keeps the items of most units. Months without the item are not filled."""
    rows = inc.filter(F.col(date).isNotNull()).withColumn("month", F.trunc(date, "month")).select(*by, "month", "unit", "item").distinct()
    size = rows.groupBy(*by, "month").agg(F.count_distinct("unit").alias("n"))
    counts = rows.groupBy(*by, "month", "item").agg(F.count("*").alias("count"))
    if top is not None:
        most = counts.groupBy("item").agg(F.sum("count").alias("_k")).orderBy(F.desc("_k"), "item").limit(top).select("item")
        counts = counts.join(most, "item", "left_semi")
    return counts.join(size, [*by, "month"]).select(*by, "month", "item", "count", "n", (F.col("count") * 100 / F.col("n")).alias("rate"))


def shocks(series: DataFrame, keys: list[str], value: str = "count", window: int = 12, least: int = 4, limit: float = 2.5) -> DataFrame:
    """Adds z (against the trailing window, the month itself included) and shock; null before ``least`` months."""
    w = Window.partitionBy(*keys).orderBy("month").rowsBetween(1 - window, 0)
    mean, sd, n = F.avg(value).over(w), F.stddev_samp(value).over(w), F.count(value).over(w)
    z = F.when((n >= least) & (sd > 0), (F.col(value) - mean) / sd)
    return series.withColumn("z", z).withColumn("shock", F.coalesce(F.abs(z) > limit, F.lit(False)))


def mann_kendall(series: DataFrame, keys: list[str], value: str = "count", season: Column | None = None) -> DataFrame:
    """(keys, n, s, tau, variance, z) of monotone trend; with ``season`` only months of the same season are compared, and the
    sums of all seasons count. Series are short: each is joined with itself."""
    rows = series.select(*keys, (F.lit(0) if season is None else season).alias("_g"), F.col("month").alias("t"), F.col(value).alias("x")).filter("x is not null")
    by = [*keys, "_g"]
    pairs = rows.withColumnsRenamed({"t": "t1", "x": "x1"}).join(rows, by).filter("t1 < t").groupBy(*by).agg(F.sum(F.signum(F.col("x") - F.col("x1"))).alias("s"))
    ties = rows.groupBy(*by, "x").agg(F.count("*").alias("c")).groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.expr("c * (c - 1) * (2 * c + 5)")).alias("tied"))
    out = ties.join(pairs, by, "left").fillna(0.0, ["s"]).withColumn("v", F.expr("(n * (n - 1) * (2 * n + 5) - tied) / 18")).withColumn("p", F.expr("n * (n - 1) / 2"))
    out = out.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.try_divide(F.sum("s"), F.sum("p")).alias("tau"), F.sum("v").alias("variance"))
    return out.withColumn("z", F.when(F.col("variance") > 0, (F.col("s") - F.signum("s")) / F.sqrt("variance")).otherwise(0.0))


def summary(series: DataFrame, keys: list[str], value: str = "count") -> DataFrame:
    return series.groupBy(*keys).agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count("*").alias("months"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def participation(df: DataFrame, entity: str, year: str, first: int, last: int) -> DataFrame:
    """(entity, year, type): Continuous in every year of the span, Single Year, Entering late and staying, Leaving early, else Intermittent."""
    years = df.filter(F.col(year).between(first, last)).select(entity, year).distinct()
    facts = years.groupBy(entity).agg(F.min(year).alias("a"), F.max(year).alias("b"), F.count("*").alias("k"))
    whole = F.col("b") - F.col("a") + 1 == F.col("k")
    kind = F.when(F.col("k") == last - first + 1, "Continuous").when(F.col("k") == 1, "Single Year").when(whole & (F.col("b") == last), "Entering").when(whole & (F.col("a") == first), "Leaving").otherwise("Intermittent")
    return years.join(facts.select(entity, kind.alias("type")), entity)


def year_over_year(series: DataFrame, keys: list[str], value: str = "count") -> DataFrame:
    """Adds before and change (percent) against the same month a year earlier; null without one or where it was 0."""
    before = series.select(*keys, F.add_months("month", 12).alias("month"), F.col(value).alias("before"))
    out = series.join(before, [*keys, "month"], "left")
    return out.withColumn("change", F.when(F.col("before") > 0, (F.col(value) - F.col("before")) * 100 / F.col("before")))


def seasonal_means(series: DataFrame, keys: list[str], value: str = "count") -> DataFrame:
    """(keys, month_of_year, effect): mean deviation from the centred moving mean of twelve months (ends left out), centred."""
    w = Window.partitionBy(*keys).orderBy("month")
    inner, outer = F.avg(value).over(w.rowsBetween(-6, 5)), F.avg(value).over(w.rowsBetween(-5, 6))
    full = F.count(value).over(w.rowsBetween(-6, 6)) == 13
    rows = series.withColumn("d", F.when(full, F.col(value) - (inner + outer) / 2)).groupBy(*keys, F.month("month").alias("month_of_year")).agg(F.avg("d").alias("e"))
    return rows.select(*keys, "month_of_year", (F.col("e") - F.avg("e").over(Window.partitionBy(*keys))).alias("effect"))


def split_points(values: np.ndarray, penalty: float, least: int = 3) -> list[int]:
    """Ends of segments (but for the last) that minimise squared deviations from segment means plus a penalty for each segment,
    segments having at least ``least`` values.

    A start s is dropped once a later end t is cheaper even without the penalty of a new segment, as every segmentation through s is
    then beaten by one through t; as a segment from t needs ``least`` values, s stays for so many steps more.
    """
    n = len(values)
    if n < 2 * least:
        return []
    s1, s2 = np.concatenate([[0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(values**2)])
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    room = 1e-9 * max(float(s2[-1]), 1.0)
    starts, beaten = np.zeros(0, int), np.zeros(0, int)
    for t in range(least, n + 1):
        if t == least or t >= 2 * least:
            starts, beaten = np.append(starts, t - least), np.append(beaten, n + least)
        cost = best[starts] + s2[t] - s2[starts] - (s1[t] - s1[starts]) ** 2 / (t - starts)
        k = int(cost.argmin())
        best[t], last[t] = cost[k] + penalty, starts[k]
        beaten = np.minimum(beaten, np.where(cost > best[t] + room, t, n + least))
        stay = beaten > t + 1 - least
        starts, beaten = starts[stay], beaten[stay]
    out, t = [], n
    while last[t] > 0:
        t = last[t]
        out.append(int(t))
    return out[::-1]


def breaks(series: DataFrame, keys: list[str], value: str = "count", least: int = 3, most: int | None = None) -> DataFrame:
    """(keys, break_number, month) of the level shifts of each series (the first ``most``): the last month before the shift.

    A group is one monthly series, some hundred rows at most; the penalty is three times the log of its length.
    """
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "break_number int", "month date"])

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values("month")
        at = split_points(pdf[value].to_numpy(float), 3 * np.log(max(len(pdf), 2)), least)[:most]
        out = pdf.iloc[[t - 1 for t in at]][[*keys, "month"]].copy()
        out.insert(len(keys), "break_number", range(1, len(at) + 1))
        return out

    return series.select(*keys, "month", value).groupBy(*keys).applyInPandas(find, schema)


def volume_summary(series: DataFrame, keys: list[str], value: str = "count") -> DataFrame:
    """One row per series: span, months, mean, deviation, trend and seasonal trend, shocks, breaks, seasonal amplitude."""
    trend = mann_kendall(series, keys, value).select(*keys, "tau", F.col("z").alias("trend_z"))
    seasonal = mann_kendall(series, keys, value, F.month("month")).select(*keys, F.col("z").alias("seasonal_z"))
    jolts = shocks(series, keys, value).groupBy(*keys).agg(F.count_if("shock").alias("shocks"))
    dates = breaks(series, keys, value).groupBy(*keys).agg(F.sort_array(F.collect_list("month")).alias("breaks"))
    swing = seasonal_means(series, keys, value).groupBy(*keys).agg((F.max("effect") - F.min("effect")).alias("amplitude"))
    out = summary(series, keys, value)
    for part in (trend, seasonal, jolts, dates, swing):
        out = out.join(part, keys, "left")
    return out
