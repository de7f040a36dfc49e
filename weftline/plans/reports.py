"""Batches of tables: publication tables, scenarios, classes by stratifier, lists of descriptive questions. A batch is keyed by the
name of its part, so it is one frame and not one for each part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import compare, coverage, filters
from weftline.operators.lineage import cut


def publication_counts(df: DataFrame, row: str, columns: list[str], top: int | None = None, restrict: filters.Cohort | None = None) -> DataFrame:
    """(row, total, table, level, count, cell): units of each row (of the ``top`` largest) by the levels of every column, with a cell
    ``n (percent)`` of the row's units; null levels are ``Unknown``. One table for each column, all in one job."""
    if restrict is not None:
        df = df.filter(restrict.predicate(df))
    totals = df.groupBy(row).agg(F.count("*").alias("total"))
    if top is not None:
        totals = totals.orderBy(F.desc("total"), F.asc_nulls_first(row)).limit(top)
    entries = F.array(*[F.struct(F.lit(c).alias("table"), F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias("level")) for c in columns])
    counts = df.select(F.col(row).alias("_r"), F.explode(entries).alias("e")).groupBy("_r", "e.table", "e.level").agg(F.count("*").alias("count"))
    out = counts.join(totals, F.col("_r").eqNullSafe(F.col(row)))
    return out.select(row, "total", "table", "level", "count", F.format_string("%d (%.1f)", F.col("count"), F.round(F.col("count") * 100.0 / F.col("total"), 1)).alias("cell"))


def item_totals(inc: DataFrame, units: DataFrame, row: str, top: int | None = None) -> DataFrame:
    """(row, item, count, cell): units of each row with an item, as ``n (percent)`` of the row's units; the ``top`` items of a row."""
    r = coverage.rates(inc, units, [row], complete=False)
    if top is not None:
        r = r.withColumn("_k", F.row_number().over(Window.partitionBy(row).orderBy(F.desc("count"), "item"))).filter(F.col("_k") <= top)
    return r.select(row, "item", "count", F.format_string("%d (%.1f)", F.col("count"), F.round(F.col("rate") * 100, 1)).alias("cell"))


def scenario_units(units: DataFrame, scenarios: dict[str, tuple[filters.Cohort, str]]) -> DataFrame:
    """(scenario, level, unit): units of each scenario's cohort with the level of the column that it compares."""
    parts = [units.filter(spec.predicate(units)).select(F.lit(name).alias("scenario"), F.col(column).cast("string").alias("level"), "unit") for name, (spec, column) in scenarios.items()]
    return reduce(DataFrame.unionByName, parts).filter("level is not null")


def scenario_rates(inc: DataFrame, units: DataFrame, scenarios: dict[str, tuple[filters.Cohort, str]]) -> DataFrame:
    """(scenario, level, item, count, n, rate)."""
    tagged = scenario_units(units, scenarios)
    size = tagged.groupBy("scenario", "level").agg(F.count("*").alias("n"))
    counts = inc.select("unit", "item").distinct().join(tagged, "unit").groupBy("scenario", "level", "item").agg(F.count("*").alias("count"))
    return counts.join(size, ["scenario", "level"]).select("scenario", "level", "item", "count", "n", (F.col("count") / F.col("n")).alias("rate"))


def class_by_stratifier(inc: DataFrame, units: DataFrame, classes: DataFrame, stratifiers: list[str]) -> DataFrame:
    """(stratum_key, stratum_level, item_group, count, n, rate): any item of a class, by every level of every stratifier."""
    grouped = filters.group_items(inc.select("unit", "item"), classes)
    strata = filters.stratify(units, stratifiers).select("unit", "stratum_key", "stratum_level")
    out = coverage.rates(grouped, strata, ["stratum_key", "stratum_level"], complete=False)
    return out.withColumnRenamed("item", "item_group")


def stratum_report(df: DataFrame, group: str, value: str, order: list | None = None, restrict: filters.Cohort | None = None) -> DataFrame:
    """(scope, name, other, measure, value): one stratum's comparison of groups. Scope ``group`` has the summary and Gini of each
    group, ``pair`` distance, delta and p-values of every two groups, ``all`` the rank test over all groups and, where ``order`` names
    levels from first to last, whether medians rise and the least p of neighbours. Rows of other levels, null groups and null values
    are left out."""
    if restrict is not None:
        df = df.filter(restrict.predicate(df))
    df = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    if order is not None:
        df = df.filter(F.col(group).isin(*order))
    df = cut(df.select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v")))

    def tall(frame, scope, name, other, measures):
        entries = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("e")
        return frame.select(F.lit(scope).alias("scope"), name.alias("name"), other.alias("other"), entries).select("scope", "name", "other", "e.*")

    none, all_ = F.lit(None).cast("string"), F.lit("all")
    groups = compare.describe(df, ["g"], "v").join(coverage.gini(df, ["g"], "v"), "g")
    pairs = compare.kolmogorov_smirnov(df, "g", "v").withColumnRenamed("p_value", "ks_p").join(compare.cliffs_delta(df, "g", "v"), ["g1", "g2"])
    pairs = pairs.join(compare.dunn(df, "g", "v").select("g1", "g2", F.col("q_value").alias("dunn_q")), ["g1", "g2"])
    parts = [
        tall(groups, "group", F.col("g"), none, ["n", "median", "iqr", "p10", "p90", "mean", "sd", "min", "max", "gini"]),
        tall(pairs, "pair", F.col("g1"), F.col("g2"), ["d", "ks_p", "delta", "dunn_q"]),
        tall(compare.kruskal(df, "g", "v"), "all", all_, none, ["groups", "h", "p_value"]),
    ]
    if order is not None:
        places = df.sparkSession.createDataFrame([(str(level), i) for i, level in enumerate(order)], "g string, place int")
        parts.append(tall(compare.ordered_dunn_trend(df, places, "g", "v"), "all", all_, none, ["ascending", "min_adjacent_p"]))
    return reduce(DataFrame.unionByName, parts)


#: Priority tiers from first to last.
TIERS = ["Critical", "High", "Medium", "Other"]


def priority_alignment(df: DataFrame, tier: str, value: str) -> DataFrame:
    """``stratum_report`` over the four priority tiers."""
    return stratum_report(df, tier, value, TIERS)


def questions(df: DataFrame, specs: list[dict]) -> DataFrame:
    """(question, value, stack, count, share) of a list of descriptive questions: ``name``, ``field``, ``top``, and optionally ``stack``
    (a second column) and ``among`` (column, n): only rows of the n most frequent values of that column."""
    parts = []
    for q in specs:
        rows = df
        if among := q.get("among"):
            column, n = among
            most = df.groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), F.asc_nulls_first(column)).limit(n)
            rows = df.join(most.select(column), column, "left_semi")
        out = coverage.top_values(rows, q["field"], q["top"], q.get("stack"))
        stack = F.col(q["stack"]).cast("string") if q.get("stack") else F.lit(None).cast("string")
        parts.append(out.select(F.lit(q["name"]).alias("question"), F.col(q["field"]).cast("string").alias("value"), stack.alias("stack"), "count", "share"))
    return reduce(DataFrame.unionByName, parts)
