"""Running totals over long orders: rows are dealt by ranges of (group, order), totals of the ranges give what comes before each, and
within a range a window does the rest. No task sorts more than a range, whatever share of the rows a group holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import KEY, key_of
from .lineage import cut

_RANGE = "_range"


def in_ranges(df: DataFrame, by: list[str], order: str, ranges: int | None = None) -> DataFrame:
    """The rows with the number of their range, written once: equal (by, order) are in the same range, and numbers rise with order.
    Without a number of ranges it follows the size of the rows."""
    columns = [*[F.col(b) for b in by], F.col(order)]
    dealt = df.repartitionByRange(*columns) if ranges is None else df.repartitionByRange(ranges, *columns)
    return cut(dealt.withColumn(_RANGE, F.spark_partition_id()))


def running(rows: DataFrame, by: list[str], order: str, value: Column, name: str, how: str = "sum", backwards: bool = False) -> DataFrame:
    """Adds ``name``: the sum (or ``min``) of a value over all rows of the group up to this one's order, rows of equal order included;
    ``backwards`` from this one's order on. Rows come from ``in_ranges``."""
    total = {"sum": F.sum, "min": F.min}[how]
    rows = rows.withColumn("_v", value).withColumn(KEY, key_of(by))
    by_range = rows.groupBy(KEY, _RANGE).agg(total("_v").alias("t"))
    around = by_range.groupBy(KEY).agg(F.collect_list(F.struct(F.col(_RANGE).alias("r"), "t")).alias("_ranges"))
    w = Window.partitionBy(KEY, _RANGE).orderBy(F.desc(order) if backwards else F.asc(order))
    others = F.filter("_ranges", lambda x: x["r"] > F.col(_RANGE) if backwards else x["r"] < F.col(_RANGE))
    if how == "sum":
        before = F.aggregate(others, F.lit(0).cast(rows.schema["_v"].dataType), lambda s, x: s + F.coalesce(x["t"], F.lit(0)).cast(rows.schema["_v"].dataType))
        whole = F.coalesce(F.sum("_v").over(w), F.lit(0)) + before
    else:
        whole = F.least(F.min("_v").over(w), F.array_min(F.transform(others, lambda x: x["t"])))
    return rows.join(around, KEY).withColumn(name, whole).drop("_v", KEY, "_ranges")


def ranks(rows: DataFrame, order: str, weight: str) -> DataFrame:
    """Adds ``rank`` to distinct values with counts: the mean place of a value's rows in the order of all."""
    out = running(in_ranges(rows, [], order), [], order, F.col(weight), "_up_to").drop(_RANGE)
    return out.withColumn("rank", F.col("_up_to") - (F.col(weight) - 1) / 2).drop("_up_to")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Adds ``name``: the place, from 1, in the order of a column of distinct values."""
    return running(in_ranges(rows, [], order), [], order, F.lit(1).cast("long"), name).drop(_RANGE)


def anonymised(df: DataFrame, entity: str, order: str, prefix: str) -> DataFrame:
    """(entity, alias): entities numbered by their first appearance (least ``order``, ties by name) behind a prefix. Null is none."""
    first = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(order).alias("_first")).withColumn("_at", F.struct("_first", entity))
    return numbered(first, "_at", "_n").select(entity, F.concat(F.lit(prefix), F.col("_n").cast("string")).alias("alias"))
