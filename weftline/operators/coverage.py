"""Rates, intervals, variation and tables of items by group. Incidence frames as in contingency; groups are columns of units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import KEY, columns_of, key_of, refuse
from .lineage import cut
from .ordered import in_ranges, running
from .quantiles import quantiles


def group_sizes(units: DataFrame, groups: list[str]) -> DataFrame:
    return units.groupBy(*groups).agg(F.count_distinct("unit").alias("n"))


def rates(inc: DataFrame, units: DataFrame, groups: list[str], complete: bool = True) -> DataFrame:
    """(groups, item, count, n, rate): units of the group with the item, all its units, their ratio. ``units`` has one row per
    unit with its groups; a null group is one. ``complete`` also gives items that a group lacks, so groups x items rows. The result
    is written once, as what follows reads it more than once."""
    refuse(groups, ["unit", "item", "count", "n", "rate"])
    units = units.select(key_of(groups), "unit")
    sizes = cut(units.groupBy(KEY).agg(F.count_distinct("unit").alias("n")))
    counts = inc.select("unit", "item").distinct().join(units, "unit", "left" if complete else "inner").groupBy(KEY, "item").agg(F.count("*").alias("count"))
    if complete:
        counts = cut(counts)  # units of no group (the key is null) count for the list of items only
        grid = sizes.join(cut(counts.select("item").distinct()), F.lit(True))  # tables of known size: the smaller is broadcast
        counts = counts.withColumnRenamed("item", "_item")
        out = grid.join(counts.withColumnRenamed(KEY, "_of"), (F.col(KEY) == F.col("_of")) & F.col("item").eqNullSafe(F.col("_item")), "left").fillna(0, ["count"])
    else:
        out = counts.join(sizes, KEY)
    return cut(out.select(*columns_of(groups), "item", "count", "n", (F.col("count") / F.col("n")).alias("rate")))


def metric(inc: DataFrame, units: DataFrame, groups: list[str], how: str, population: DataFrame | None = None) -> DataFrame:
    """(groups, item, numerator, denominator, value): ``sum`` (units with the item), ``mean`` (their share), ``percentage`` and
    ``coverage`` (in percent; of an empty group 0), or ``per_100k`` of a population (groups, population)."""
    r = rates(inc, units, groups)
    if how == "per_100k":
        out = per_100k(r, population, groups)
        return out.select(*groups, "item", F.col("count").alias("numerator"), F.col("population").alias("denominator"), F.col("per_100k").alias("value"))
    share = F.col("count") / F.greatest(F.col("n"), F.lit(1))
    value = {"sum": F.col("count").cast("double"), "mean": share, "percentage": share * 100, "coverage": share * 100}[how]
    return r.select(*groups, "item", F.col("count").alias("numerator"), F.col("n").alias("denominator"), value.alias("value"))


def group_comparison(inc: DataFrame, units: DataFrame, group: str, classes: DataFrame | None = None, min_size: int = 0, how: str = "coverage") -> DataFrame:
    """(scope, name, group, numerator, denominator, value, place): items, and item classes (item, item_group) if given, by groups of
    at least ``min_size`` units; ``place`` ranks a name's groups, highest first."""
    sizes = units.groupBy(group).agg(F.count_distinct("unit").alias("_n")).filter(F.col("_n") >= min_size).select(group)
    kept = units.join(sizes, group, "left_semi")
    parts = [metric(inc, kept, [group], how).withColumn("scope", F.lit("item"))]
    if classes is not None:
        whole = inc.select("unit", "item").join(classes.select("item", "item_group"), "item").select("unit", F.col("item_group").alias("item")).distinct()
        parts.append(metric(whole, kept, [group], how).withColumn("scope", F.lit("class")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    place = F.row_number().over(Window.partitionBy("scope", "item").orderBy(F.desc("value"), group))
    return out.select("scope", F.col("item").alias("name"), group, "numerator", "denominator", "value", place.alias("place"))


def per_100k(rates_: DataFrame, population: DataFrame, key: str | list[str]) -> DataFrame:
    """Counts per 100,000 of a population (key, population), so by sex if sex is among the keys; a group without one takes the mean
    of all, and of a population of 0 the value is null."""
    mean = population.agg(F.avg("population").alias("_mean"))
    out = rates_.join(population, key, "left").join(mean, F.lit(True))
    return out.withColumn("per_100k", F.try_divide(F.col("count") * 100_000, F.coalesce("population", "_mean"))).drop("_mean")


def population_of(regions: DataFrame, exact: DataFrame, fallback: DataFrame) -> DataFrame:
    """Population by region and year, where missing by region alone."""
    out = regions.join(exact.withColumnRenamed("population", "_p"), ["region", "year"], "left").join(fallback.withColumnRenamed("population", "_q"), "region", "left")
    return out.withColumn("population", F.coalesce("_p", "_q")).drop("_p", "_q")


def wilson(count: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's interval of a share; (0, 0) without trials."""
    p = count / n
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), middle + half)).otherwise(0.0)


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, gini) of a non-negative value; 0 where the sum is. Places come from running totals of value counts."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key_of(by), F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    rows = running(in_ranges(counts.withColumnRenamed(KEY, "_g"), ["_g"], "_x"), ["_g"], "_x", F.col("_c"), "_up").withColumnRenamed("_g", KEY)
    n, total = F.sum("_c").cast("double"), F.sum(F.col("_c") * F.col("_x"))
    places = F.sum((F.col("_up") * F.col("_c") - F.col("_c") * (F.col("_c") - 1) / 2) * F.col("_x"))
    g = F.when(total > 0, 2 * places / (n * total) - (n + 1) / n).otherwise(0.0)
    return rows.groupBy(KEY).agg(g.alias("gini")).select(*columns_of(by), "gini")


def _beside(base: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    found = found.withColumn("_of", key_of(by)).drop(*by)
    return base.withColumn(KEY, key_of(by)).join(found, F.col(KEY) == F.col("_of"), "left").drop(KEY, "_of")


def variation(df: DataFrame, by: list[str], value: str, threshold: float | None = None) -> DataFrame:
    """Spread of a value over the strata of each key: quantiles, mean, deviation, coefficient, median absolute deviation, Gini. A null
    key is a key."""
    refuse(by, ["strata", "median", "iqr", "mean", "sd", "min", "max", "below", "mad", "gini", "cv", "relative_iqr"])
    df = cut(df.select(*[F.col(f"`{b}`") for b in by], F.col(value).alias("_value")))
    basic = df.groupBy(*by).agg(F.count("_value").alias("strata"), F.avg("_value").alias("mean"), F.stddev_samp("_value").alias("sd"), F.min("_value").alias("min"), F.max("_value").alias("max"), *([F.avg((F.col("_value") < threshold).cast("int")).alias("below")] if threshold is not None else []))
    q = cut(quantiles(df, by, "_value", (0.25, 0.5, 0.75)).drop("n"))  # read twice
    middle = q.select(key_of(by).alias("_of"), F.col("q")[1].alias("_m"))
    away = df.withColumn(KEY, key_of(by)).join(middle, F.col(KEY) == F.col("_of")).select(*by, F.abs(F.col("_value") - F.col("_m")).alias("_away"))
    mad = quantiles(away, by, "_away", (0.5,)).drop("n").withColumnRenamed("q", "_mad")
    out = _beside(_beside(_beside(basic, q, by), mad, by), gini(df, by, "_value"), by)
    out = out.select(*by, "strata", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "mean", "sd", "min", "max", *(["below"] if threshold is not None else []), F.col("_mad")[0].alias("mad"), "gini")
    return out.withColumn("cv", F.when(F.col("mean") != 0, F.col("sd") / F.col("mean"))).withColumn("relative_iqr", F.when(F.col("median") != 0, F.col("iqr") / F.col("median")))


def error_bars(df: DataFrame, by: list[str], value: str, mode: str) -> DataFrame:
    """(by, mean, low, high) by iqr, stddev, sem, ci, minmax, mad (mean absolute deviation about the mean) or none."""
    v, mean = F.col(value), F.avg(value)
    if mode == "mad":
        centred = df.join(df.groupBy(*by).agg(mean.alias("_m")), by)
        half = F.avg(F.abs(v - F.col("_m")))
        return centred.groupBy(*by).agg(mean.alias("mean"), (mean - half).alias("low"), (mean + half).alias("high"))
    half = {"stddev": F.stddev_samp(value), "sem": F.stddev_samp(value) / F.sqrt(F.count(value)), "ci": 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))}
    if mode == "iqr":
        out = _beside(df.groupBy(*by).agg(mean.alias("mean")), quantiles(df, by, value, (0.25, 0.75)).drop("n"), by)
        return out.select(*by, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    low, high = {"minmax": (F.min(value), F.max(value)), "none": (mean, mean)}.get(mode) or (mean - half[mode], mean + half[mode])
    return df.groupBy(*by).agg(mean.alias("mean"), low.alias("low"), high.alias("high"))


def extremes(rates_: DataFrame, group: str) -> DataFrame:
    """Per item the range of its rates over groups, and the groups at either end (ties: the smaller name)."""
    order = lambda sign: F.struct((sign * F.col("rate")).alias("v"), F.col(group).alias("g"))
    out = rates_.groupBy("item").agg(F.min(order(1)).alias("lo"), F.min(order(-1)).alias("hi"), F.avg("rate").alias("mean"), F.count("*").alias("groups"))
    return out.select("item", F.col("lo.v").alias("min_rate"), F.col("lo.g").alias("bottom"), (-F.col("hi.v")).alias("max_rate"), F.col("hi.g").alias("top"), (-F.col("hi.v") - F.col("lo.v")).alias("range"), "mean", "groups")


def top_values(df: DataFrame, column: str, n: int, stack: str | None = None) -> DataFrame:
    """Counts of the n most frequent values (null is one) with their share of all rows; optionally split by a second column."""
    by = [column] if stack is None else [column, stack]
    counts = df.groupBy(*by).agg(F.count("*").alias("count"))
    total = df.agg(F.count("*").alias("_t"))
    first = df.groupBy(column).agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), F.asc_nulls_first(column)).limit(n)
    kept = counts.withColumnRenamed(column, "_v").join(first.select(column), F.col("_v").eqNullSafe(F.col(column))).drop("_v")
    return kept.join(total, F.lit(True)).select(*by, "count", (F.col("count") * 100 / F.col("_t")).alias("share"))


def counts_by(df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """(columns, n): rows of each combination, null ones too; the ``top`` largest (ties: smallest values, nulls first)."""
    out = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), *[F.asc_nulls_first(c) for c in columns]).limit(top)


def box_table(rates_: DataFrame, by: str = "item", order: str = "median") -> DataFrame:
    """(by, groups, low, q1, median, q3, high, mean, iqr, place) of rates over groups; ``place`` counts from the largest ``order``
    (median, mean or iqr; ties: the smaller name)."""
    q = [F.percentile("rate", F.lit(p)) for p in (0.25, 0.5, 0.75)]
    out = rates_.groupBy(by).agg(F.count("rate").alias("groups"), F.min("rate").alias("low"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max("rate").alias("high"), F.avg("rate").alias("mean"), (q[2] - q[0]).alias("iqr"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round(order, 12)), by)))


def group_totals(inc: DataFrame, classes: DataFrame, top: int | None = None) -> DataFrame:
    """(item_group, item, n): units with each item, for items of the ``top`` groups that have most in all."""
    counts = inc.select("unit", "item").distinct().groupBy("item").agg(F.count("*").alias("n")).join(classes.select("item", "item_group"), "item")
    if top is not None:
        most = counts.groupBy("item_group").agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), "item_group").limit(top).select("item_group")
        counts = counts.join(most, "item_group", "left_semi")
    return counts.select("item_group", "item", "n")


def top_items(inc: DataFrame, units: DataFrame, groups: list[str], top: int, min_rate: float = 0.0) -> DataFrame:
    """(groups, item, n, rank): the ``top`` items of each group by units, of those in a share of at least ``min_rate`` of its units."""
    r = rates(inc, units, groups, complete=False).filter(F.col("rate") >= min_rate)
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("count"), "item"))
    return r.select(*groups, "item", F.col("count").alias("n"), rank.alias("rank")).filter(F.col("rank") <= top)


def ordered_grid(rates_: DataFrame, group: str, levels: list | None = None) -> DataFrame:
    """(group, item, rate, order_key): rates of the chosen levels, with the item's mean rate over them to sort by."""
    rows = rates_ if levels is None else rates_.filter(F.col(group).isin(*levels))
    return rows.select(group, "item", "rate", F.avg("rate").over(Window.partitionBy("item")).alias("order_key"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, present, percent) in one pass."""
    n = F.count("*")
    one = df.agg(*[F.struct(F.count(c).alias("present"), (F.count(c) * 100 / n).alias("percent")).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "v").select("column", "v.present", "v.percent")


def crosstab(df: DataFrame, row: str, column: str, levels: list) -> DataFrame:
    """Counts by row with one column for each level, those without rows too."""
    return df.groupBy(row).pivot(column, levels).count().fillna(0)


def with_percent_cells(df: DataFrame, columns: list[str], total: str) -> DataFrame:
    """Counts as text cells ``n (percent)`` of a total column."""
    return df.select(*[F.format_string("%d (%.1f)", F.col(c), F.round(F.col(c) * 100.0 / F.col(total), 1)).alias(c) if c in columns else F.col(c) for c in df.columns])


def keep_items(rates_: DataFrame, threshold: float, policy: str = "any") -> DataFrame:
    """Rows of items whose rate reaches the threshold in any group, in all groups, or over all units (``global``)."""
    over = Window.partitionBy("item")
    value = {"any": F.max("rate"), "all": F.min("rate"), "global": F.sum("count")}[policy].over(over)
    if policy == "global":
        value = value / F.sum("n").over(over)
    return rates_.withColumn("_v", value).filter(F.col("_v") >= threshold).drop("_v")


def pattern_matrix(rates_: DataFrame, groups: list[str], min_mean: float = 0.0) -> DataFrame:
    """(groups, item, rate, mean, tier): items with any count and a mean rate of at least ``min_mean``, in four tiers by the
    quartiles of the items' means."""
    items = rates_.groupBy("item").agg(F.avg("rate").alias("mean"), F.sum("count").alias("_s")).filter((F.col("_s") > 0) & (F.col("mean") >= min_mean))
    cuts = items.agg(*[F.percentile("mean", F.lit(q)).alias(f"_q{k}") for k, q in enumerate((0.25, 0.5, 0.75))])
    m = F.col("mean")
    tier = F.when(m >= F.col("_q2"), "Critically").when(m >= F.col("_q1"), "Highly").when(m >= F.col("_q0"), "Mediumly").otherwise("Lowly")
    items = items.join(cuts, F.lit(True)).select("item", "mean", tier.alias("tier"))
    return rates_.join(items, "item").select(*groups, "item", "rate", "mean", "tier")


def column_profile(df: DataFrame, rsd: float | None = None) -> DataFrame:
    """(column, type, role, rows, nulls, distinct, min, max, mean, q25, median, q75) in one pass: ``distinct`` is exact, or an estimate
    of relative error ``rsd``. Roles: id (as many values as rows), constant, date, number, category (at most 50 values), text."""
    number = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")
    entries = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        some = t.startswith(number)
        q = [F.percentile_approx(x.cast("double"), p, 10_000) if some else F.lit(None).cast("double") for p in (0.25, 0.5, 0.75)]
        count = F.count_distinct(x) if rsd is None else F.approx_count_distinct(x, rsd)
        entries.append(F.struct(F.lit(t).alias("type"), F.count("*").alias("rows"), (F.count("*") - F.count(x)).alias("nulls"), count.alias("distinct"), F.min(x).cast("string").alias("min"), F.max(x).cast("string").alias("max"), (F.avg(x) if some else F.lit(None).cast("double")).alias("mean"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75")).alias(c))
    out = df.agg(*entries).unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "v").select("column", "v.*")
    d, t = F.col("distinct"), F.col("type")
    role = F.when(d <= 1, "constant").when((d == F.col("rows")) & ~t.isin("double", "float"), "id").when(t.startswith("date") | t.startswith("timestamp"), "date").when(t.rlike("^(" + "|".join(number) + ")"), "number").when(d <= 50, "category").otherwise("text")
    return out.select("column", "type", role.alias("role"), *[c for c in out.columns if c not in ("column", "type")])


def frequent_values(df: DataFrame, share: float = 0.01, most: int = 10) -> DataFrame:
    """(column, place, value, count, share): of every column the values, as text, that at least ``share`` of the rows have, the ``most``
    frequent ones (ties by value). Nulls are no values, but count as rows.

    One pass keeps a summary of bounded size a column, which misses no value of that share; its candidates, at most some 1/share a
    column, are then counted exactly.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    candidates = int(2 / share) + 10
    tracked = max(8 * candidates, 1024)
    text = {c: F.col(f"`{c}`").cast("string") for c in df.columns}
    tops = df.agg(F.count("*").alias("_rows"), *[F.call_function("approx_top_k", text[c], F.lit(candidates), F.lit(tracked)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    tops = cut(tops)
    likely = reduce(DataFrame.unionByName, [tops.select(F.lit(c).alias("column"), F.explode(f"c{i}").alias("v")) for i, c in enumerate(df.columns)])
    likely = cut(likely.select("column", F.col("v.item").alias("value")).filter("value is not null"))
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text[c].alias("value")) for c in df.columns])).alias("v")).select("v.*")
    counted = rows.join(likely, ["column", "value"]).groupBy("column", "value").agg(F.count("*").alias("count"))
    out = counted.join(tops.select("_rows"), F.lit(True)).filter(F.col("count") >= share * F.col("_rows"))
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))).filter(F.col("place") <= most)
    return out.select("column", "place", "value", "count", (F.col("count") / F.col("_rows")).alias("share"))


def full_profile(df: DataFrame, share: float = 0.01, rsd: float = 0.01) -> DataFrame:
    """``column_profile`` with distinct values by a mergeable sketch of relative error ``rsd`` (a column whose estimate is within twice
    that of its rows counts as an id), and the top value of each column with its count, where one has at least ``share`` of the rows.
    Scans keep one row a task for all columns; nothing is sorted or expanded but the candidates."""
    base = column_profile(df, rsd)
    whole = F.abs(F.col("distinct") - F.col("rows")) <= 2 * rsd * F.col("rows")
    top = frequent_values(df, share, 1).select("column", F.col("value").alias("top_value"), F.col("count").alias("top_count"))
    role = F.when(whole & (F.col("nulls") == 0) & (F.col("distinct") > 50) & ~F.col("type").isin("double", "float"), "id").otherwise(F.col("role"))
    return base.withColumn("role", role).join(top, "column", "left")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(rows, duplicates): rows, and how many of them repeat an earlier one."""
    names = [F.col(f"`{c}`") for c in df.columns]
    return df.groupBy(*names).agg(F.count("*").alias("_n")).agg(F.sum("_n").alias("rows"), (F.sum("_n") - F.count("*")).alias("duplicates"))


def profile(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls, distinct, constant, key): every column in one exact pass."""
    n = F.count("*")
    one = df.agg(*[F.struct(F.lit(t).alias("type"), n.alias("rows"), (n - F.count(F.col(f"`{c}`"))).alias("nulls"), F.count_distinct(F.col(f"`{c}`")).alias("distinct")).alias(c) for c, t in df.dtypes])
    out = one.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "v").select("column", "v.*")
    return out.withColumn("constant", F.col("distinct") <= 1).withColumn("key", (F.col("distinct") == F.col("rows")) & (F.col("nulls") == 0))
