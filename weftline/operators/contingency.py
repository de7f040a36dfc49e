"""Co-occurrence of items on units as 2x2 tables per stratum.

``incidence`` frames have strata columns, ``unit`` and ``item``, one row for each item present. A unit's items are gathered into one
sorted array (a shuffle by unit) and written as a table, from which pairs, margins and sizes are read; counts are pre-aggregated
before the second shuffle. Margins and sizes are joined to the pairs; both have one row per stratum and item. A unit with more than
``LONG`` items is cut into chunks, and pairs of chunks are dealt to many tasks.

A null stratum is a stratum. Strata may have any names but those of the result. Null items and units are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.metrics import lift

from .keys import KEY, columns_of, key_of, refuse
from .lineage import cut

CELLS = ("a", "b", "c", "d", "fl", "fr", "n")
LONG = 2000


def incidence_from_wide(wide: DataFrame, unit: str, suffix: str = "_Tested", strata: list[str] = (), keep_absent: bool = False) -> DataFrame:
    """Columns ending in ``suffix`` become (strata, unit, item, value) rows; only positive ones, unless ``keep_absent``."""
    items = [c for c in wide.columns if c.endswith(suffix)]
    long = wide.unpivot([F.col(unit).alias("unit"), *[F.col(s) for s in strata]], [F.col(f"`{c}`").cast("double").alias(c) for c in items], "item", "value")
    return long if keep_absent else long.filter("value > 0").drop("value")


def margins(inc: DataFrame, strata: list[str]) -> tuple[DataFrame, DataFrame]:
    """(strata, item, f) and (strata, n): units with the item, and units with any item."""
    rows = inc.select(*strata, "unit", "item").distinct()
    return rows.groupBy(*strata, "item").agg(F.count("*").alias("f")), rows.groupBy(*strata).agg(F.count_distinct("unit").alias("n"))


def _fill(pairs: DataFrame) -> DataFrame:
    a = F.coalesce(F.col("a"), F.lit(0))
    pairs = pairs.withColumn("a", a).withColumn("b", F.col("fl") - F.col("a")).withColumn("c", F.col("fr") - F.col("a"))
    return pairs.withColumn("d", F.col("n") - F.col("fl") - F.col("fr") + F.col("a"))


def _left_items(sets: DataFrame, keep: list[str], items: str = "items") -> DataFrame:
    """(keep, items, i, left_item) of every item of a unit, to be paired with what stands right of place i. Units of more than
    ``LONG`` items are cut into chunks, and every two chunks are dealt to a task of their own."""
    short, long = sets.filter(F.size(items) <= LONG), sets.filter(F.size(items) > LONG)
    chunk = lambda c: F.slice(items, F.col(c) * LONG + 1, F.lit(LONG))
    last = F.floor((F.size(items) - 1) / LONG).cast("int")
    two = long.withColumn("_c", F.explode(F.sequence(F.lit(0), last))).withColumn("_d", F.explode(F.sequence(F.col("_c"), last)))
    two = two.select(*keep, chunk("_c").alias("_l"), chunk("_d").alias("_r"), (F.col("_c") == F.col("_d")).alias("_same")).repartition(F.xxhash64("_l", "_r"))
    two = two.select(*keep, "_l", "_r", "_same", F.posexplode("_l").alias("_p", "left_item"))
    rest = F.when(F.col("_same"), F.slice("_l", F.col("_p") + 1, F.lit(LONG))).otherwise(F.concat(F.array("left_item"), "_r"))
    return short.select(*keep, items, F.posexplode(items).alias("i", "left_item")).unionByName(two.select(*keep, rest.alias(items), F.lit(0).alias("i"), "left_item"))


def _rows(inc: DataFrame, strata: list[str], *more: Column) -> DataFrame:
    return inc.filter("unit is not null and item is not null").select(key_of(strata), "unit", "item", *more)


def pair_counts(inc: DataFrame, strata: list[str], complete: bool = True) -> DataFrame:
    """(strata, left_item, right_item, CELLS) with left_item < right_item.

    ``complete`` also gives pairs that never meet: item x item within a stratum, as many rows as the result has.
    """
    refuse(strata, ["left_item", "right_item", *CELLS])
    sets = cut(_rows(inc, strata).groupBy(KEY, "unit").agg(F.sort_array(F.collect_set("item")).alias("items")))
    left = _left_items(sets, [KEY])
    met = left.select(KEY, "left_item", F.explode(F.slice("items", F.col("i") + 2, F.greatest(F.size("items") - F.col("i") - 1, F.lit(0)))).alias("right_item"))
    met = met.groupBy(KEY, "left_item", "right_item").agg(F.count("*").alias("a"))
    f = cut(sets.select(KEY, F.explode("items").alias("item")).groupBy(KEY, "item").agg(F.count("*").alias("f")))
    n = cut(sets.groupBy(KEY).agg(F.count("*").alias("n")))
    fl, fr = f.withColumnRenamed("item", "left_item").withColumnRenamed("f", "fl"), f.withColumnRenamed("item", "right_item").withColumnRenamed("f", "fr")
    if complete:
        pairs = fl.join(fr, KEY).filter("left_item < right_item").join(met, [KEY, "left_item", "right_item"], "left")
    else:
        pairs = met.join(fl, [KEY, "left_item"]).join(fr, [KEY, "right_item"])
    return _fill(pairs.join(n, KEY)).select(*columns_of(strata), "left_item", "right_item", *CELLS)


def rectangular_counts(left: DataFrame, right: DataFrame, strata: list[str]) -> DataFrame:
    """Items of one incidence frame against items of another on the same units; every observed pair."""
    refuse(strata, ["left_item", "right_item", *CELLS])
    left, right = (cut(_rows(df, strata).distinct()) for df in (left, right))
    n = left.select(KEY, "unit").unionByName(right.select(KEY, "unit")).distinct().groupBy(KEY).agg(F.count("*").alias("n"))
    fl = left.groupBy(KEY, F.col("item").alias("left_item")).agg(F.count("*").alias("fl"))
    fr = right.groupBy(KEY, F.col("item").alias("right_item")).agg(F.count("*").alias("fr"))
    met = left.withColumnRenamed("item", "left_item").join(right.withColumnRenamed("item", "right_item"), [KEY, "unit"])
    met = met.groupBy(KEY, "left_item", "right_item").agg(F.count("*").alias("a"))
    pairs = met.join(fl, [KEY, "left_item"]).join(fr, [KEY, "right_item"]).join(n, KEY)
    return _fill(pairs).select(*columns_of(strata), "left_item", "right_item", *CELLS)


def category_counts(inc: DataFrame, units: DataFrame, category: str, keep_null: bool = True) -> DataFrame:
    """Items against one-hot levels of a unit column: (left_item, right_item, CELLS). ``units`` has one row per unit."""
    units = units.select("unit", F.col(category).alias("right_item"))
    if not keep_null:
        units = units.filter("right_item is not null")
    units = units.withColumn("right_item", F.coalesce(F.col("right_item").cast("string"), F.lit("<null>")))
    rows = inc.select("unit", F.col("item").alias("left_item")).distinct().join(units, "unit")
    met = rows.groupBy("left_item", "right_item").agg(F.count("*").alias("a"))
    fl = rows.groupBy("left_item").agg(F.count("*").alias("fl"))
    fr = units.groupBy("right_item").agg(F.count("*").alias("fr"))
    n = units.agg(F.count("*").alias("n"))
    pairs = fl.join(fr, F.lit(True)).join(met, ["left_item", "right_item"], "left").join(n, F.lit(True))
    return _fill(pairs).select("left_item", "right_item", *CELLS)


def pair_counts_excluding(values: DataFrame, strata: list[str]) -> DataFrame:
    """2x2 counts over units where both items have a recorded 0 or 1: values is (strata, unit, item, value), one row each.

    Other values and nulls exclude the pair on that unit. Every pair of items of a stratum appears.
    """
    refuse(strata, ["left_item", "right_item", *CELLS])
    values = values.withColumn("value", F.col("value").cast("double"))
    rows = _rows(values.filter(F.col("value").isin(0.0, 1.0)), strata, F.col("value").cast("int").alias("value"))
    sets = rows.groupBy(KEY, "unit").agg(F.sort_array(F.collect_set(F.struct("item", "value"))).alias("s"))
    left = _left_items(cut(sets), [KEY], "s").withColumnRenamed("left_item", "l")
    met = left.select(KEY, F.col("l.item").alias("left_item"), F.col("l.value").alias("x"), F.explode(F.slice("s", F.col("i") + 2, F.greatest(F.size("s") - F.col("i") - 1, F.lit(0)))).alias("r"))
    cell = lambda x, y: F.count_if((F.col("x") == x) & (F.col("r.value") == y))
    met = met.groupBy(KEY, "left_item", F.col("r.item").alias("right_item")).agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"))
    items = cut(_rows(values, strata).select(KEY, "item").distinct())
    grid = items.withColumnRenamed("item", "left_item").join(items.withColumnRenamed("item", "right_item"), KEY).filter("left_item < right_item")
    out = grid.join(met, [KEY, "left_item", "right_item"], "left").fillna(0, ["a", "b", "c", "d"])
    return with_margins(out.select(*columns_of(strata), "left_item", "right_item", "a", "b", "c", "d"))


def with_margins(pairs: DataFrame) -> DataFrame:
    """fl, fr and n from the four cells."""
    return pairs.withColumn("fl", F.col("a") + F.col("b")).withColumn("fr", F.col("a") + F.col("c")).withColumn("n", F.expr("a + b + c + d"))


def pool(pairs: DataFrame, keys: list[str] = (), how: str = "sum_counts", metric: Column | None = None) -> DataFrame:
    """Pairs over all strata but ``keys``: cells summed, or (``mean_similarity``) the mean of a metric of each stratum."""
    by = [*keys, "left_item", "right_item"]
    if how == "sum_counts":
        return with_margins(pairs.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("a", "b", "c", "d")]))
    return pairs.withColumn("similarity", metric).groupBy(*by).agg(F.avg("similarity").alias("similarity"))


def check_binary(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(column, bad): values other than 0, 1 and null, for columns that have any; exact, in one pass."""
    counts = wide.agg(*[F.count_if(~F.col(f"`{c}`").cast("double").isin(0.0, 1.0)).alias(c) for c in columns])
    return counts.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "bad").filter("bad > 0")


def with_item_weights(pairs: DataFrame, strata: list[str], domain: DataFrame | None = None, beta: float = 20.0, kappa: float = 1.0, unit_norm: bool = False) -> DataFrame:
    """Adds wl, wr (robust inverse frequency: 1 + kappa tanh of its deviation from the stratum's median in MADs), il, ir (smooth
    inverse frequency, of unit length over the stratum's items if ``unit_norm``) and gl, gr (``domain``: item, factor; else 1)."""
    refuse(strata, ["wl", "wr", "il", "ir", "gl", "gr"])
    pairs = cut(pairs.withColumn(KEY, key_of(strata)))
    items = pairs.select(KEY, F.col("left_item").alias("item"), F.col("fl").alias("f"), "n").unionByName(pairs.select(KEY, F.col("right_item").alias("item"), F.col("fr").alias("f"), "n")).distinct()
    items = items.withColumn("x", F.log((F.col("n") + beta) / (F.col("f") + beta))).withColumn("i", F.log((F.col("n") + 1) / (F.col("f") + 1)) + 1)
    over = Window.partitionBy(KEY)
    items = items.withColumn("middle", F.percentile("x", F.lit(0.5)).over(over)).withColumn("away", F.abs(F.col("x") - F.col("middle")))
    items = items.withColumn("w", 1 + kappa * F.tanh((F.col("x") - F.col("middle")) / (F.percentile("away", F.lit(0.5)).over(over) + 1e-9)))
    if unit_norm:
        items = items.withColumn("i", F.col("i") / F.sqrt(F.sum(F.col("i") * F.col("i")).over(over)))
    if domain is not None:
        items = items.join(domain.select("item", F.col("factor").alias("g")), "item", "left").withColumn("g", F.coalesce("g", F.lit(1.0)))
    else:
        items = items.withColumn("g", F.lit(1.0))
    items = cut(items)
    for side in ("left", "right"):
        s = side[0]
        pairs = pairs.join(items.select(KEY, F.col("item").alias(f"{side}_item"), F.col("w").alias(f"w{s}"), F.col("i").alias(f"i{s}"), F.col("g").alias(f"g{s}")), [KEY, f"{side}_item"])
    return pairs.drop(KEY)


def tfidf(inc: DataFrame, strata: list[str], smooth: bool = True, cosine: bool = False) -> DataFrame:
    """Items as documents, units as terms: (strata, left_item, right_item, similarity), the dot product or cosine of their rows.

    A unit's weight depends on how many items it has, so it is known before pairs are made.
    """
    refuse(strata, ["left_item", "right_item", "similarity"])
    rows = _rows(inc, strata).distinct()
    count = cut(rows.groupBy(KEY).agg(F.count_distinct("item").alias("items")))
    sets = rows.groupBy(KEY, "unit").agg(F.sort_array(F.collect_set("item")).alias("s")).join(count, KEY)
    df = F.size("s")
    idf = F.log((1 + F.col("items")) / (1 + df)) + 1 if smooth else F.log(F.col("items") / df) + 1
    sets = cut(sets.withColumn("w", idf * idf))
    left = _left_items(sets, [KEY, "w"], "s")
    pairs = left.select(KEY, "w", "left_item", F.explode(F.slice("s", F.col("i") + 2, F.greatest(F.size("s") - F.col("i") - 1, F.lit(0)))).alias("right_item"))
    pairs = pairs.groupBy(KEY, "left_item", "right_item").agg(F.sum("w").alias("similarity"))
    if cosine:
        length = cut(sets.select(KEY, "w", F.explode("s").alias("left_item")).groupBy(KEY, "left_item").agg(F.sqrt(F.sum("w")).alias("length")))
        for side in ("left", "right"):
            pairs = pairs.join(length.withColumnRenamed("left_item", f"{side}_item").withColumnRenamed("length", side), [KEY, f"{side}_item"])
        pairs = pairs.withColumn("similarity", F.col("similarity") / (F.col("left") * F.col("right")))
    return pairs.select(*columns_of(strata), "left_item", "right_item", "similarity")


def scaled_lift(pairs: DataFrame, strata: list[str]) -> DataFrame:
    """log1p(lift) over the largest of the stratum, items with themselves included (their lift is n / f)."""
    own = F.greatest(F.when(F.col("fl") > 0, F.col("n") / F.col("fl")).otherwise(0.0), F.when(F.col("fr") > 0, F.col("n") / F.col("fr")).otherwise(0.0))
    most = F.max(F.greatest(F.log1p(lift()), F.log1p(own))).over(Window.partitionBy(*strata))
    return pairs.withColumn("similarity", F.when(most > 0, F.log1p(lift()) / most).otherwise(0.0))


def edge_list(pairs: DataFrame, similarity: Column, strata: list[str], threshold: float | None = None, topk: int | None = None, digits: int | None = None) -> DataFrame:
    """Long edges, best first within a stratum by ``rank``; ties by item names."""
    out = pairs.withColumn("similarity", similarity if digits is None else F.round(similarity, digits))
    if threshold is not None:
        out = out.filter(F.col("similarity") >= threshold)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*strata).orderBy(F.desc("similarity"), "left_item", "right_item")))
    return out if topk is None else out.filter(F.col("rank") <= topk)


def square(edges: DataFrame, strata: list[str], items: list[str], diagonal: float = 1.0) -> DataFrame:
    """Edges as a labelled square matrix: (strata, item, one column per item), missing pairs 0."""
    both = edges.select(*strata, F.col("left_item").alias("item"), F.col("right_item").alias("other"), "similarity").unionByName(edges.select(*strata, F.col("right_item").alias("item"), F.col("left_item").alias("other"), "similarity"))
    own = both.select(*strata, "item", F.col("item").alias("other"), F.lit(diagonal).alias("similarity")).distinct()
    return both.unionByName(own).groupBy(*strata, "item").pivot("other", items).agg(F.first("similarity")).fillna(0.0)
