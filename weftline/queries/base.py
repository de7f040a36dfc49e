"""Roles of the driver's tables: a unit is an order, its items are the brands on it, strata and times come from the order."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRATUM = ["stratum"]
#: Rows of a source that a task gets where they are dealt by a key.
ROWS = 250_000


class Registry:
    """Queries by name, and their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def take(f):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return take


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key to as many tasks as their source has ``ROWS`` rows, or cores if those are more. Tasks that the planner
    joins to 64 MB of compressed rows hold millions of rows, and what follows keeps several hash tables and sorts of them at once."""
    tasks = max(math.ceil(source.count() / ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, key)


def incidence(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(stratum, unit, item, more order columns), one row for each brand on an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("stratum"), *more)
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("unit"), "item")
    rows = dealt(rows, lines, "unit").distinct()
    return rows.join(orders, "unit").select("stratum", "unit", "item", *more)


INC = """inc AS (SELECT DISTINCT o_orderpriority AS stratum, o_orderkey AS unit, p_brand AS item, o_orderstatus, o_orderdate, o_custkey
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""

#: t: every pair of items of a stratum with its 2x2 table.
TWO_BY_TWO = INC + """,
f AS (SELECT stratum, item, count(*) AS f FROM inc GROUP BY ALL),
u AS (SELECT stratum, count(DISTINCT unit) AS n FROM inc GROUP BY ALL),
m AS (SELECT x.stratum, x.item AS left_item, y.item AS right_item, count(*) AS a
  FROM inc x JOIN inc y ON x.unit = y.unit AND x.item < y.item GROUP BY ALL),
t AS (SELECT l.stratum, l.item AS left_item, r.item AS right_item, coalesce(m.a, 0) AS a, l.f - coalesce(m.a, 0) AS b,
    r.f - coalesce(m.a, 0) AS c, u.n - l.f - r.f + coalesce(m.a, 0) AS d, l.f AS fl, r.f AS fr, u.n
  FROM f l JOIN f r ON l.stratum = r.stratum AND l.item < r.item JOIN u ON u.stratum = l.stratum
  LEFT JOIN m ON m.stratum = l.stratum AND m.left_item = l.item AND m.right_item = r.item)"""
