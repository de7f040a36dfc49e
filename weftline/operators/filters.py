"""Row filters, strata and cohorts as predicates on plain DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.encode import fold, folded


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))


def condition(column: str, values=None, regex: str | None = None, case_insensitive: bool = True) -> Column:
    """A list means membership (strings without regard to case and accents), a string a pattern, else equality."""
    c = F.col(column)
    if values is not None and not isinstance(values, str):
        if not isinstance(values, (list, tuple, set)):
            return c == values
        values = list(values)
        if all(isinstance(v, str) for v in values):
            return folded(c).isin([fold(v) for v in values])
        return c.isin(values)
    return F.coalesce(c.cast("string").rlike(("(?i)" if case_insensitive else "") + (regex if values is None else values)), F.lit(False))


def apply_filters(df: DataFrame, filters: list[dict]) -> DataFrame:
    """All of the filters; one on a column that isn't there is an error."""
    return df.filter(_all(condition(**f) for f in filters))


def prefilter(df: DataFrame, rules: list[tuple[str, object, str]]) -> DataFrame:
    """(column, values, ``in`` or ``not in``) rules; a callable value gets the column and gives a Column. Null is not in."""
    out = []
    for column, value, how in rules:
        c = F.col(column)
        hit = value(c) if callable(value) else c.isin(list(value)) if isinstance(value, (list, tuple, set)) else c == value
        out.append(hit if how == "in" else ~F.coalesce(hit, F.lit(False)))
    return df.filter(_all(out))


def chain(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def stratify(df: DataFrame, keys: list[str], keep_null: bool = False) -> DataFrame:
    """Every row once for each key: columns stratum_key and stratum_level. One frame, not one for each level."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys])
    out = df.withColumn("_s", F.explode(entries)).withColumn("stratum_key", F.col("_s.k")).withColumn("stratum_level", F.col("_s.v")).drop("_s")
    return out if keep_null else out.filter("stratum_level is not null")


@dataclass
class Cohort:
    """A cohort: column -> value, list of values, or (low, high) range; patterns by column; and the least number of units."""

    where: dict = field(default_factory=dict)
    patterns: dict = field(default_factory=dict)
    ranges: dict = field(default_factory=dict)
    min_size: int = 0

    def predicate(self, df: DataFrame) -> Column:
        known = set(df.columns)
        if missing := {*self.where, *self.patterns, *self.ranges} - known:
            raise KeyError(f"no columns {sorted(missing)}")
        out = [condition(c, v if isinstance(v, (list, tuple, set)) else [v]) for c, v in self.where.items()]
        out += [condition(c, regex=p) for c, p in self.patterns.items()]
        out += [F.col(c).between(*r) for c, r in self.ranges.items()]
        return _all(out)


def cohort(df: DataFrame, spec: Cohort, unit: str = "unit") -> DataFrame:
    """The cohort's rows; none if it has fewer units than its least number."""
    rows = df.filter(spec.predicate(df))
    if not spec.min_size:
        return rows
    size = rows.agg((F.count_distinct(unit) >= spec.min_size).alias("_enough"))
    return rows.join(size, F.lit(True)).filter("_enough").drop("_enough")


def cohorts(df: DataFrame, specs: DataFrame, keys: list[str], min_size: int = 0, unit: str = "unit", few: int = 10_000) -> DataFrame:
    """Rows tagged with cohort_id for each spec (cohort_id, keys) that they fit; a null key fits any value. One row a cohort. Up to
    ``few`` specs are compared with every row in one pass; more are joined on their keys, one join for each set of keys that are
    not null. A unit may be in many cohorts, nested ones included, once in each."""
    specs = specs.select("cohort_id", *[F.col(k).alias(f"_{k}") for k in keys])
    if specs.limit(few + 1).count() <= few:
        out = df.join(F.broadcast(specs), _all(F.col(f"_{k}").isNull() | (F.col(f"_{k}") == F.col(k)) for k in keys))
    else:
        out = None
        for used in specs.select(*[F.col(f"_{k}").isNotNull().alias(k) for k in keys]).distinct().collect():
            named = [k for k in keys if used[k]]
            alike = specs.filter(_all(F.col(f"_{k}").isNotNull() == used[k] for k in keys))
            part = df.join(alike, _all(F.col(f"_{k}") == F.col(k) for k in named)) if named else df.crossJoin(alike)
            out = part if out is None else out.unionByName(part)
    out = out.drop(*[f"_{k}" for k in keys])
    if min_size:
        out = out.join(out.groupBy("cohort_id").agg(F.count_distinct(unit).alias("_n")).filter(F.col("_n") >= min_size).select("cohort_id"), "cohort_id", "left_semi")
    return out


def continuous_entities(df: DataFrame, entity: str, year: str, first: int, last: int) -> DataFrame:
    """Rows of entities that are present in every year of the span."""
    span = df.filter(F.col(year).between(first, last))
    steady = span.groupBy(entity).agg(F.count_distinct(year).alias("_y")).filter(F.col("_y") == last - first + 1).select(entity)
    return span.join(steady, entity, "left_semi")


def members(df: DataFrame, column: str, values: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose value of ``column`` is among ``values`` (a table with that column), or with ``keep`` off those whose isn't; a null
    value is among none."""
    return df.join(values.select(column).distinct(), column, "left_semi" if keep else "left_anti").select(*[f"`{c}`" for c in df.columns])


def tested_units(units: DataFrame, inc: DataFrame, unit: str = "unit") -> DataFrame:
    """Units with at least one test."""
    return members(units, unit, inc)


def mapped(df: DataFrame, key: str, dimension: DataFrame, default: str | None = None) -> DataFrame:
    """The dimension's other columns joined by key, one row of it for each key; where it has none, text columns are ``default``."""
    out = df.join(dimension.dropDuplicates([key]), key, "left")
    return out if default is None else out.fillna(default, [c for c, kind in dimension.dtypes if c != key and kind == "string"])


def renamed(df: DataFrame, names: DataFrame | dict[str, str]) -> DataFrame:
    """Columns renamed after a mapping: a dict, or a table (old, new), read on the driver as it has at most one row of use a column."""
    if isinstance(names, DataFrame):
        names = {r.old: r.new for r in names.filter(F.col("old").isin(*df.columns)).select("old", "new").distinct().collect()}
    return df.withColumnsRenamed(names)


def recoded(levels: dict[str, Column], other: str = "Other") -> Column:
    """The name of the first condition that holds; ``other`` where none does."""
    out = F.lit(other)
    for name, holds in reversed(levels.items()):
        out = F.when(holds, name).otherwise(out)
    return out


def restrict_pairs(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs whose both ends are in ``items`` (item)."""
    left, right = items.withColumnRenamed("item", "left_item"), items.withColumnRenamed("item", "right_item")
    return pairs.join(left.select("left_item"), "left_item", "left_semi").join(right.select("right_item"), "right_item", "left_semi")


def drop_rare_items(inc: DataFrame, min_share: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(rows of items on at least that share of units, facts (item, units, percent, status) of all items)."""
    rows = inc.select("unit", "item").distinct()
    facts = rows.groupBy("item").agg(F.count("*").alias("units")).join(rows.agg(F.count_distinct("unit").alias("n")), F.lit(True))
    share = F.col("units") / F.col("n")
    facts = facts.select("item", "units", F.round(share * 100, 2).alias("percent"), F.when(share >= min_share, "Kept").otherwise("Dropped").alias("status"))
    return inc.join(facts.filter("status = 'Kept'").select("item"), "item", "left_semi"), facts


def drop_sparse_columns(df: DataFrame, most_missing: float = 0.6) -> DataFrame:
    """Without columns whose share of nulls is above the limit, and without columns that are null throughout; one pass decides."""
    shares = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if shares[c] is not None and shares[c] <= most_missing and shares[c] < 1])


def group_items(inc: DataFrame, groups: DataFrame) -> DataFrame:
    """Incidence of item groups: (…, item=group), one row per unit and group with any member. ``groups`` is (item, item_group)."""
    keep = [c for c in inc.columns if c != "item"]
    return inc.join(groups.select("item", "item_group"), "item").select(*keep, F.col("item_group").alias("item")).distinct()
